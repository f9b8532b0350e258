import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm.packing import default_vocabulary, encoder, fill_window, pack, pack_documents, plan_windows


def brute_best(counts, capacity):
    sums = {0}
    for k, c in counts.items():
        sums = {s + k * i for s in sums for i in range(c + 1) if s + k * i <= capacity}
    return max(sums)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6), st.integers(1, 60))
def test_fill_window_is_closest_to_capacity(counts, capacity):
    used = fill_window(counts, capacity)
    assert all(0 < c <= counts[k] for k, c in used.items())
    assert sum(k * c for k, c in used.items()) == brute_best(counts, capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_covers_histogram(h):
    got = {}
    for used, times in plan_windows(h, 64):
        assert sum(k * c for k, c in used.items()) <= 64
        for k, c in used.items():
            got[k] = got.get(k, 0) + c * times
    assert got == h


TEXTS = ["", " ", "a", "two  spaces\n\n end ", "tab\t\tx", "don't we'll été 123 a_b", "x <|endoftext|> y",
         "emoji \U0001f600‍", "  nb", "　wide  中文", "a\r\n b", "'s 's''s", "\n\n\n", "lots of words " * 900]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_tokenizer_file(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_vocabulary())
    assert encoder(default_vocabulary())(text) == t.encode(text, add_special_tokens=False).ids


def check_layout(rows, capacity=2048):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return by_seq, by_doc


def test_pack_whole_documents(spark):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("start", F.lit(1))
    rows = pack_documents(df).collect()
    _, by_doc = check_layout(rows)
    assert set(by_doc) == {d for d, _ in data}
    for d, text in data:
        ids = np.array([*encoder(default_vocabulary())(text or ""), 1], dtype="<u4")
        at = 0
        for start, n, total in sorted(by_doc[d]):
            assert start == at and total == len(ids)
            crc = [r["ids_crc32"] for r in rows if r["doc_id"] == d and r["start"] == start]
            assert crc == [zlib.crc32(ids[start:start + n].tobytes())]
            at += n
        assert at == len(ids)


def test_pack_common_length_and_repeats(spark):
    # a third of the pieces share one length, some rows repeat
    data = [(i, 0, 700 if i % 3 == 0 else 1 + i * 37 % 900, 5, 9) for i in range(3000)] + [(1, 0, 38, 5, 9)] * 5
    df = spark.createDataFrame(data, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    rows = pack(df.repartition(5)).collect()
    by_seq, _ = check_layout(rows)
    assert len(rows) == len(data)
    assert len(by_seq) <= 1.1 * sum(d[2] for d in data) / 2048


def test_pack_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
