import hashlib
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.pii import KINDS, _add, _harder, base_spans, candidates, covered, cuts, features, find_pii, labelled, labels, redact

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    odd, even = d[::-1][::2], d[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def brute(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in s.split("."))
                or kind == "card" and 13 <= len(d) <= 19 and plain_luhn(d) or kind == "phone" and 9 <= len(d) <= 15)
    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=list("019a.@+- ()%é\U0001f600-5"), max_size=60))
def test_base_spans_match_patterns(text):
    assert base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", "1.2.3.4", "256.1.1.1", "a@b.c",
                                 "a@b", "x.y@z-1.co.uk@q.r", "00000255.1.1.1", "1.2.3.4.5.6.7.8", " ", "-", ".", "+", "word"]), max_size=8))
def test_base_spans_match_patterns_on_parts(parts):
    text = "".join(parts)
    assert base_spans(text) == brute(text)
    for a, b, k in candidates(text):
        assert 0 <= a < b <= len(text) and 0 <= k < 4


def rows_for_training():
    out = []
    for i in range(400):
        card = f"4{(i * 7919 + 123456789) % 10 ** 14:014d}"
        card += str(next(c for c in range(10) if plain_luhn(card + str(c))))
        kind = i % 4
        s = [f"user{i}.{i % 50}@mail{i % 9}.example.com", f"{i % 200 + 1}.{i * 3 % 250}.{i % 99}.{i * 11 % 254}", card,
             f"+1 ({200 + i % 700}) 555-{1000 + i * 17 % 9000}"][kind]
        out.append((i, f"some words here {s} and more in {1900 + i % 120} or 12.5 and 3-4 the end"))
    return out


def test_find_pii_end_to_end(spark):
    train = rows_for_training()
    card, phone = "4111111111111111", "+1 (269) 555-3296"
    assert brute("x" * 3_000 + " a@b.co")["email"] == [(3_001, 3_007)]
    extra = [(1000, f"call {phone} {card} now"), (1001, None), (1002, ""), (1003, "clean text, 42 things on 2024-01-31."),
             (1004, "x" * 300_000 + " a@b.co"), (1004, "x" * 300_000 + " a@b.co"), (1005, "write bob.42 (at) mail3.example.com soon")]
    df = spark.createDataFrame([(*r, "c") for r in train + extra], "doc_id long, text string, spans string")
    got = find_pii(df).collect()
    assert len(got) == len(train + extra)
    texts = dict(train + extra)
    by = {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        by[r["doc_id"]] = r
        # The plain patterns take a time that grows with the square of such a run; it holds one address, at its end.
        b = brute(t) if len(t) < 10_000 else {"email": [(300_001, 300_007)], "ip": [], "card": [], "phone": []}
        assert [r[f"n_{k}"] for k in KINDS] == [len(b[k]) for k in KINDS]
        line = ",".join(f"{k}:{a}:{e}" for k in KINDS for a, e in b[k])
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))
    # a phone and a card that run into each other: no base rule finds either, the model finds both
    assert by[1000]["n_phone"] == by[1000]["n_card"] == 0
    assert redact(texts[1000], by[1000]["spans"]) == "call <phone> <card> now"
    assert by[1003]["spans"] == ""
    assert sum(by[i]["n_added"] for i, _ in train) <= 4


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "nothing"), (2, None)], "doc_id long, text string")
    assert [r["spans"] for r in find_pii(df).collect()] == ["", ""]
    assert find_pii(df.limit(0)).collect() == []
    assert covered([(0, 1, 5), (1, 3, 9), (2, 20, 21)]) == 9


def test_all_documents_train(spark):
    """Personal data in none of the first 8,000 documents by hash (once a sample that the trees were fitted on)."""
    from pyspark.sql import functions as F

    ids = [r[0] for r in spark.range(8_400).orderBy(F.xxhash64("id"), "id").collect()]
    train = dict(zip(ids[8_000:], (text for _, text in rows_for_training())))
    docs = [(i, train.get(i, "clean words")) for i in ids]
    df = spark.createDataFrame([*docs, (8_001_000, "call +1 (269) 555-3296 4111111111111111 now")], "doc_id long, text string")
    last = find_pii(df).where("doc_id = 8001000").first()
    assert redact("call +1 (269) 555-3296 4111111111111111 now", last["spans"]) == "call <phone> <card> now"


def test_labels_count_every_document_and_cuts_equal_sorting(spark):
    docs = [(i if i % 7 else None, text) for i, text in rows_for_training()[:200]] * 2
    got = labels(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = Counter((i is not None and i % 5 == 0, float(y), tuple(map(int, x))) for i, t in docs for x, y in labelled(t))
    assert {(r["held"], r["label"], tuple(r["x"])): r["n"] for r in got} == want
    # A stump: margins of the digits' number, so that many candidates share one.
    stump = {"feature": np.array([2, -1, -1]), "threshold": np.array([12.0, 0, 0]), "left": np.array([1, 1, 2]), "right": np.array([2, 1, 2]),
             "value": np.array([0.0, 0.25, 2.0])}
    rows = [([k, *[d] * 23], float(d > 12 or k == 1 or d == 5), 1 + d % 3) for k in (0, 1, 2) for d in range(5, 20)]
    for precision in (0.3, 0.98, 1.1):
        want = []
        for k in range(4):
            own = [(2.0 if x[2] > 12 else 0.25, y, n) for x, y, n in rows if x[0] == k]
            ok = [m for m, _, _ in own if sum(n * y for s, y, n in own if s >= m) >= precision * sum(n for s, _, n in own if s >= m)]
            want.append(min(ok) if ok else 1.0)
        assert cuts(spark.createDataFrame(rows, "x array<int>, label double, n long"), [stump], precision) == want


def one_by_one(base, scored):
    taken, out = [x for spans in base.values() for x in spans], []
    for _, a, b, k in sorted(scored, key=lambda x: (-x[0], x[1], -x[2], x[3])):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((k, a, b))
    return out


spans = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)).map(lambda x: (x[0], x[0] + x[1])), max_size=8)


@settings(max_examples=300, deadline=None)
@given(spans, spans, st.lists(st.tuples(st.integers(0, 5), spans.filter(len), st.integers(0, 3)), max_size=12))
def test_added_spans_equal_comparing_one_by_one(emails, cards, more):
    base = {"email": emails, "ip": [], "card": cards, "phone": []}
    scored = [(float(s), *own[0], k) for s, own, k in more]
    assert _add(base, scored) == one_by_one(base, scored)


def test_labels_equal_comparing_with_every_span():
    """Whether a candidate beside a companion is true does not depend on how the companion's spans are looked up."""
    text = "a@b.co 4111111111111111 1.2.3.4 +1 (988) 555-2485 x@y.zz 4111111111111111 a@b.co 10.20.30.40 " * 3
    base = base_spans(text)
    true = {(a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind]}
    want = [(features(text, a, b, k), int((a, b, k) in true)) for a, b, k in candidates(text)]
    for a, b, kind in sorted(true):
        s = text[a:b]
        others = [text[x:y] for x, y, _ in true if (x, y) != (a, b)] + [str(len(text)), "2024-01-31", "12 7 1999"]
        for k in range(a, a + 4):
            t, good = _harder(kind, s, k, others[k % len(others)])
            truth = {(x, y, kind) for x, y in good}
            truth |= {(t.find(text[x:y]), t.find(text[x:y]) + y - x, q) for x, y, q in true if text[x:y] in t}
            want += [(features(t, x, y, q), int((x, y, q) in truth)) for x, y, q in candidates(t)]
        odd = (f"no {s[:-1]}{(int(s[-1]) + 1 + a % 8) % 10} x" if kind == 2 else
               f"v {s.rsplit('.', 1)[0]}.{300 + a % 600} x" if kind == 1 else "")
        want += [(features(odd, x, y, q), 0) for x, y, q in candidates(odd)]
    assert labelled(text) == want


def addresses(n):
    line = "bob.{0}@mail{1}.example.com 4111 1111 1111 1111 7{0:06d} +1 (269) 555-{1:04d} 10.0.{2}.9 "
    return "".join(line.format(i, i % 9999, i % 250) for i in range(n))


def test_labels_of_many_spans_in_linear_time():
    start = time.time()
    assert len(labelled(addresses(1500))) > 60_000
    assert time.time() - start < 60


def test_spans_of_a_megabyte_in_linear_time():
    text = addresses(13_000)
    assert len(text) > 1_000_000
    start = time.time()
    base = base_spans(text)
    scored = [(float(a % 7), a, b, k) for a, b, k in candidates(text)]
    more = sorted(_add(base, scored))
    assert time.time() - start < 60
    assert len(base["email"]) == 13_000 and len(scored) > 400_000 and more
    assert covered(more) == sum(b - a for _, a, b in more)      # none overlap
