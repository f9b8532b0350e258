import collections
import re

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline as P
from pyspark.sql import functions as F

from tidewater.llm.decontaminate import normalise
from tidewater.llm.q_line_dedup import rows_sql

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in rows], COLUMNS)


def brute_lines(rows):
    con = duckdb.connect()
    con.register("d", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    return con.sql(f"""WITH {rows_sql('d')} SELECT doc_id, string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone)
                       FROM chunks GROUP BY r, doc_id""").fetchall()


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [grams(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(a), root(b)
                    low[max(x, y)] = min(x, y)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root(n)] = min(least.get(root(n), i), i)
    return [(i, len(sets[n]), least[root(n)]) for n, (i, _) in enumerate(rows)]


BASE = [f"line {k} of a passage with words w{k} x{k * 7} and some more text to be long enough" for k in range(40)]
COPY = "\n".join(BASE)
ROWS = [(1, COPY), (2, COPY), (3, "head\n" + "\n".join(BASE[5:30]) + "\ntail"), (4, None), (5, ""), (6, "\n \n"), (7, "a\x01b\x02c\nd"),
        (8, "own first line\n" + "own words only " * 30), (9, "own words only " * 30 + "\nother"), (10, "x " * 60_000), (11, "Of."), (12, "Of."),
        (2, COPY)]


def test_line_stage_matches_sql(spark):
    out = P.drop_repeated_lines(spark, frame(spark, ROWS), SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r["doc_id"]: r for r in out.collect()}
    expected = {i: t for i, t in brute_lines(ROWS[:-1]) if t is not None}
    assert {i: r["text"] for i, r in got.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == f"s{i}" for i, r in got.items())
    assert 2 not in got and got[1]["text"] == COPY and got[5]["text"] == "" and got[7]["text"] == "a\x01b\x02c\nd"
    assert len(got[3]["text"]) < len(ROWS[2][1]) and got[9]["text"] == "other"


def test_ngram_stage_matches_brute_force(spark):
    rows = [(i, t) for i, t in ROWS[:-1] if i != 10]
    words = COPY.split()
    for k in range(30):
        w = list(words)
        for j in range(k % 5):
            w[(k * 31 + j * 97) % len(w)] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, "one two three"), (201, "ONE\ttwo  three"), (202, "one two"), (203, "a b c d e f g h i j"), (204, "a b c d e f g h i j k")]
    from tidewater.llm.ngram_join import ngram_join
    got = sorted(tuple(r) for r in ngram_join(frame(spark, rows)).collect())
    assert got == sorted(brute_groups(rows))
    stays = {i for i, _, c in got if i == c}
    out = P.keep_one_of_each_group(spark, frame(spark, rows + [(8, dict(ROWS)[8])]), SF).collect()
    assert collections.Counter(r["doc_id"] for r in out) == {i: 1 for i in stays}


def test_two_texts_under_one_id(spark):
    """Links and rows go by id and text: another text under an id that goes stays, and its links count."""
    from tidewater.llm.ngram_join import ngram_join
    a, b = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (None, a + " z"), (None, "c " * 9), (7, None), (7, None), (8, " ")]
    got = sorted(map(str, map(tuple, ngram_join(frame(spark, rows)).collect())))
    n = len(grams(a))
    assert got == sorted(map(str, [(1, n, 1), (1, n, 1), (2, n + 1, 1), (3, n + 1, 1), (None, n + 1, 1), (None, 1, None), (7, 0, 7), (7, 0, 7), (8, 0, 8)]))
    kept = P.keep_one_of_each_group(spark, frame(spark, rows), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == sorted([("1", a), ("1", b), ("None", "c " * 9), ("8", " ")])
    assert [r["doc_id"] for r in kept if r["text"] is None] == [7]
    rows = [(0, a), (1, a), (1, "an unrelated text of some words")]
    assert {(r["doc_id"], r["text"]) for r in P.keep_one_of_each_group(spark, frame(spark, rows), SF).collect()} == {rows[0], rows[2]}


@pytest.mark.parametrize("stage", [name for name, _ in P.STAGES[:-1]])
def test_clashing_columns_and_repeated_rows(spark, stage):
    """Extra columns named like internal ones come back as they were; rows that repeat id and text keep their own columns."""
    names = "k1 k2 c0 c1 th sig rep component n h at chunk chunks kept removed key stays again odd row".split()
    rows = [(1, "some clean words " * 9), (2, "other clean words, quite a few of them, " * 5), (None, "no id at all"), (3, "")]
    docs = frame(spark, rows).selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in names])
    out = dict(P.STAGES)[stage](spark, docs, SF)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    twice = docs.unionByName(docs.withColumn("source", F.lit("z later")))
    got = dict(P.STAGES)[stage](spark, twice, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, (docs if stage == "ngram_join" else twice).collect()))


def test_ngram_stage_uses_five_words(spark):
    """One word of 49 changed: 5-grams 40 of 50 alike, 4-grams 42 of 50 (under 0.85)."""
    words = [f"w{k}" for k in range(49)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:24] + ["edit"] + words[25:])), (3, " ".join(words[:24] + ["two", "edits"] + words[26:]))]
    assert [c for _, _, c in brute_groups(rows)] == [1, 2, 3]
    assert sorted(r["doc_id"] for r in dict(P.STAGES)["ngram_join"](spark, frame(spark, rows), SF).collect()) == [1, 3]


def repeated_passages(rows):
    """Documents in which a run of lines of over 50 words stands that is in another document, too."""
    seen = collections.defaultdict(set)
    for i, t in rows:
        lines = [x for x in (t or "").split("\n") if x.split()]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) > 50:
                    seen["\n".join(lines[a:b])].add(i)
                    break
    return {i for held in seen.values() if len(held) > 1 for i in held}


def test_no_passage_stays_in_two_documents(spark):
    long, half = " ".join(f"s{k}" for k in range(60)), [" ".join(f"{h}{k}" for k in range(30)) for h in "ab"]
    assert len(long) < 300
    around = lambda i, t: f"begin {i} " + "own words " * 40 + f"\n{t}\n" + f"end {i} " + "last words " * 40
    rows = [(i, around(i, long)) for i in range(5)] + [(10, long), (11, f"short\nbefore\n{long}"), (12, long[:-4])]
    rows += [(i, around(i, f"{half[0]}\n \n{half[1]}")) for i in (20, 21)]
    assert {0, 1, 2, 3, 4, 10, 11} <= repeated_passages(brute_lines(rows))
    got = {r["doc_id"]: r["text"] for r in dict(P.STAGES)["line_dedup"](spark, frame(spark, rows), SF).collect()}
    assert not repeated_passages(got.items())
    assert 10 not in got and got[11] == "short\nbefore" and all(got[i] == dict(rows)[i] for i in (0, 12, 20))
    assert all(got[i] == around(i, "").replace("\n\n", "\n") for i in range(1, 5)) and half[0] not in got[21] and half[1] not in got[21]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    left = [(r["doc_id"], r["text"]) for r in dict(P.STAGES)["line_dedup"](spark, docs, SF).collect()]
    assert repeated_passages(brute_lines(sorted(before))) and not repeated_passages(left)


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).collect() == []


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage on the smallest tables."""
    from tidewater.llm.common import staged, table
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_on_the_smallest_tables(spark, stages):
    before, toxic, lines, groups, leaks, packed = stages
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    for df in stages[:5]:
        assert df.columns == before.columns
    assert set(rows(toxic)) <= set(rows(before))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {i for i, _ in rows(toxic)}
    clean = [i for i, _ in rows(before) if labels.get(i) == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    assert sorted(rows(lines)) == sorted((i, t) for i, t in brute_lines(rows(toxic)) if t is not None)
    assert sorted(i for i, _ in rows(groups)) == sorted(i for i, _, c in brute_groups(rows(lines)) if i == c)
    items = [normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hold = {i for i, t in rows(groups) if any(x in normalise(t) for x in items)}
    kept = {i for i, _ in rows(leaks)}
    assert not hold & kept and len({i for i, _ in rows(groups)} - kept - hold) <= 2
    by = collections.defaultdict(list)
    for r in packed.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept


def test_shingles_and_blocks_take_little_memory():
    """A worker's arrays are bounded by slices of text and of n-grams, with the sets and links of a whole pass."""
    import tracemalloc

    import numpy as np

    from tidewater.llm.ngram_join import block_links, shingle_sets

    texts = [" ".join(f"w{i * 31 % 977}x{j}" for j in range(300)).encode() for i in range(1000)]
    rng = np.random.default_rng(5)
    sets = [(f"{i:016d}".encode(), 400, np.unique(rng.integers(0, 5_000, 600))[:400]) for i in range(600)]
    peaks = []
    for job in (lambda: shingle_sets(texts), lambda: block_links(sets[:300], sets[300:], 85)):
        tracemalloc.start()
        got = job()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if len(peaks) == 1:
            assert all((g == shingle_sets([t])[0]).all() for g, t in zip(got[::199], texts[::199]))
    print(peaks)
    assert peaks[0] < 30e6 and peaks[1] < 20e6
