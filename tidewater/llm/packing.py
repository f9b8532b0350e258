"""Packing by minimum bin slack: token sequences of a fixed window, filled as close to capacity as counts allow.

``token_pieces``: tokenises each document where it is read and cuts it into pieces of at most one window; only
narrow piece rows (no texts, no ids) move on.  ``plan_windows``: from the histogram of piece lengths (at most
``capacity`` entries whatever the data size) a bitset subset-sum dynamic program finds, for the window at hand, the
multiset of remaining lengths whose sum is closest to capacity; the backtracked multiset is repeated for as many
windows as its counts allow.  ``pack``: every piece gets its rank among the pieces of its length (through range
partitions, so a very common length spreads over tasks) and the plan, at most a few entries for each length, maps that
rank to (sequence, offset).

Defined results: null text is the empty text (one piece, the end id alone); repeated rows are packed each; an
empty table gives an empty table; texts of any length are cut freely, each id lies in exactly one piece.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the byte-level BPE in the tokenizer file at ``path``.

    The vocabulary and its merge order are read from that file into the faster encoder; the ids are those of
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` (tested), special strings included.
    Without two adjacent white-space characters the look-ahead branch of the split pattern never decides, and the
    plain pattern splits alike; other texts take the full pattern.
    """
    import re

    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest for 256, 257, ...
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    plain = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    full = plain.replace(r"|\s+", r"|\s+(?!\S)|\s+")
    fast = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens=special)
    slow = tiktoken.Encoding("full", pat_str=full, mergeable_ranks=ranks, special_tokens=special)
    run = re.compile(r"\s\s")
    marked = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(text: str) -> list[int]:
        if marked and marked.search(text):
            return slow.encode(text, allowed_special="all")
        return (slow if run.search(text) else fast).encode_ordinary(text)
    return encode


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                n = len(ids)
                for s in range(0, n, capacity):
                    piece = ids[s:s + capacity]
                    rows.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), n))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most their counts) whose sum is the largest one not above ``capacity``.

    Bitset subset sum: bit s of ``reach`` says that s can be made.  Counts enter in binary parts, long lengths
    first; the states before each part are kept for backtracking.  It stops as soon as capacity is reached.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    s, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> s & 1:
            used[length] = used.get(length, 0) + take
            s -= length * take
    return used


def _plan_from(histogram: dict[int, int], capacity: int, seed) -> list[tuple[dict[int, int], int]]:
    left = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while left:
        first = seed(left)
        left[first] -= 1
        used = fill_window({k: v for k, v in left.items() if v and k <= capacity - first}, capacity - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // c for k, c in used.items())
        for k, c in used.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        plan.append((used, times))
    return plan


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a window with their counts, how many windows look so)] covering the whole histogram.

    Each window must hold one given length: the longest left over, or in a second plan the most common one, which
    suits a length that a third of the pieces share.  The plan with fewer windows is returned.
    """
    plans = [_plan_from(histogram, capacity, max),
             _plan_from(histogram, capacity, lambda left: max(left, key=lambda k: (left[k], k)))]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _slots(plan: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """The plan by length: from ``rank`` on, pieces go through windows ``first`` and up, ``per`` to a window, from ``at``."""
    first, ranks, rows = 0, {}, {}
    for used, times in plan:
        at = 0
        for length in sorted(used, reverse=True):
            c, r = used[length], ranks.get(length, 0)
            rows.setdefault(length, []).append((r, first, c, at))
            ranks[length] = r + c * times
            at += c * length
        first += times
    return sorted(rows.items())


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = staged(pieces, "pieces")
    # At most ``capacity`` rows, whatever the size of the data; the plan has a few entries for each length.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(_slots(plan_windows(histogram, capacity), capacity),
                                  "length long, slots array<struct<rank: long, first: long, per: long, at: long>>")
    ranked = numbered(pieces, "length", "doc_id", "start", "ids_crc32")
    # The last slot of this length whose first rank is not above the piece's.
    slot = F.element_at(F.filter("slots", lambda s: s["rank"] <= F.col("i")), -1)
    further = F.col("i") - F.col("slot.rank")
    return ranked.join(F.broadcast(slots), "length").withColumn("slot", slot).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.first") + F.floor(further / F.col("slot.per"))).alias("sequence_id"),
        (F.col("slot.at") + further % F.col("slot.per") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID) -> DataFrame:
    return pack(token_pieces(docs, vocabulary, capacity, end_id), capacity)
