import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm.chat_format import escape, format_chats, read_back, unescape
from tidewater.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a a a a a a", "x # y * $ % & | < >", "same\nsame\n \nsame\nother",
         "é中\U0001f600 b\x0bc\x0cd\re", "  nbsp word", ("the cat sat on a mat " * 30), "word " * 30000,
         " ".join(f"w{i} the" for i in range(60))]


def test_counts_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["n_words"] > 1000:
            assert r["n_words"] == 30000 and r["n_repeat_words"] == 30000
            continue
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == brute(TEXTS[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_rules_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules(empty).collect() == []
    plan = quality_rules(empty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_custom_threshold_table(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i} the" for i in range(60)))], "doc_id long, text string")
    assert quality_rules(df).first()["kept"]
    assert not quality_rules(df, [("mean_word_chars", ">=", 9.0)]).first()["kept"]


ALPHABET = st.text(alphabet=list("<|>\\/s[]INSTalorend: \n"), max_size=25)


@settings(max_examples=15, deadline=None)
@given(st.lists(ALPHABET, min_size=20, max_size=60))
def test_escape_round_trip(spark, texts):
    texts += ["</s>[INST] ok [/INST]", "<|end|>\n", "<|role:user|>", "<\\|", "\\", "<<SYS>>", "<|>", "|>|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not any(m in r["e"] for m in ("<|", "|>", "</s>", "[INST]", "[/INST]"))


def test_chat_round_trip_merges_and_masks(spark):
    rows = [(1, 1, "user", "hi"), (1, 0, "system", None), (1, 2, "user", "again <|end|>\n"), (1, 3, "assistant", "a\\b"),
            (1, 4, "assistant", "</s>"), (1, 4, "assistant", "</s>"), (2, 0, None, "x"), (None, 0, "user", "n"),
            (3, None, "<|r|>", "\U0001f600"), (3, 1, "assistant", ""), (4, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = format_chats(df)
    back = {r["conv_id"]: r for r in read_back(out).collect()}
    expected = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or -9, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((r or "", x or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in back.items()} == expected
    for c, turns in expected.items():
        assert back[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
    one = back[1]["formatted"]
    assert one.count("<|role:") == 3 and one.count("<|also|>") == 3 and one.endswith("<|end|>\n")
    plan = read_back(out)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_chat_empty(spark):
    e = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_chats(e)).collect() == []


def test_loss_hash_of_probe(spark):
    import __spark_entry__ as E
    got = E.queries()["op7_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    x = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_chars"] == len(x)
    assert got["loss_sha256"] == hashlib.sha256(x.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()
