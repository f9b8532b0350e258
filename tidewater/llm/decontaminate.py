"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters has an error budget k = floor(rate * m).  Cut into k + 1 pieces, any
occurrence with at most k edits leaves one piece intact, so exact piece hits find every such occurrence; Myers'
bit-parallel distance over the window around the hits decides.  Chance hits are dropped early by the same
argument: of two neighbouring runs of n1 and n2 pieces holding at most n1 + n2 - 1 edits together, one holds fewer
edits than pieces; so a hit is checked in runs of 2, 4, 8, ... pieces, and the whole item only if all of them pass.
Both sides are normalised alike: lower case, word characters only, single spaces.

The documents are read once per block of test items (``block_items``, a documented bound on what is broadcast);
there is no shuffle, whole texts are searched, and every item and hit counts.

Defined results: null or empty texts and items without word characters match nothing; an item under ``1 / rate``
characters has no budget and must occur exactly; repeated document rows give repeated results; empty tables give
an empty table; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
BLOCK_ITEMS = 20_000
LEAKS = "doc_id long, item_id long, item_chars long, budget long, distance long, end_at long"

_WORD = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def cuts(item: str, budget: int) -> list[int]:
    """Where ``budget`` + 1 pieces of nearly equal length begin, and the end of the item."""
    n = budget + 1
    return [i * len(item) // n for i in range(n + 1)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_occurrence(eq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Myers: (least edit distance of the item to any substring of ``text``, where the first such ends)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    get = eq.get
    for j, c in enumerate(text):
        e = get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, at


class Matcher:
    """The piece automaton of a block of items, and the check of its hits."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.cuts = [cuts(t, k) for _, t, k in self.items]
        self.eq: dict[tuple[int, int, int], dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, _) in enumerate(self.items):
            for p, (a, b) in enumerate(zip(self.cuts[n], self.cuts[n][1:])):
                found.setdefault(t[a:b], []).append((n, p))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def distance(self, n: int, first: int, last: int, text: str) -> tuple[int, int]:
        """Of pieces ``first`` to ``last`` - 1 of item n to the closest substring of ``text``."""
        a, b = self.cuts[n][first], self.cuts[n][last]
        eq = self.eq.get((n, first, last))
        if eq is None:
            eq = self.eq[n, first, last] = masks(self.items[n][1][a:b])
        return best_occurrence(eq, b - a, text)

    def grows(self, n: int, p: int, start: int, text: str) -> bool:
        """Whether runs of 2, 4, ... pieces around the hit of piece p stay within fewer edits than pieces."""
        at, count, size = self.cuts[n], len(self.cuts[n]) - 1, 2
        while size < count:
            first = p // size * size
            last = min(first + size, count)
            spare, origin = last - first - 1, start - at[p]
            lo = max(origin + at[first] - spare, 0)
            if self.distance(n, first, last, text[lo:origin + at[last] + spare])[0] > spare:
                return False
            size *= 2
        return True

    def leaks(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, item chars, budget, distance, end) of each item within its budget somewhere in ``text``."""
        if not text or not self.items:
            return
        hits: dict[int, set[tuple[int, int]]] = {}
        for end, (length, owners) in self.automaton.iter(text):
            for n, p in owners:
                hits.setdefault(n, set()).add((end + 1 - length, p))
        for n, places in hits.items():
            item_id, item, k = self.items[n]
            m, best, at = len(item), k + 1, 0
            exact = text.find(item)
            if exact >= 0:
                yield item_id, m, k, 0, exact + m
                continue
            starts = {s - self.cuts[n][p] for s, p in places if self.grows(n, p, s, text)}
            lo = hi = None
            for s in [*sorted(starts), None]:  # hits whose windows overlap are checked together
                if s is not None and lo is not None and s - k <= hi:
                    hi = s + m + k
                    continue
                if lo is not None:
                    d, e = self.distance(n, 0, k + 1, text[max(lo, 0):hi])
                    if d < best:
                        best, at = d, max(lo, 0) + e
                if s is not None:
                    lo, hi = s - k, s + m + k
            if best <= k:
                yield item_id, m, k, best, at


def _blocks(items: DataFrame, block_items: int) -> Iterator[list[tuple[int, str]]]:
    """The test items, normalised, in blocks of about ``block_items``."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // block_items))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().collect()
        yield [(r["item_id"], t) for r in rows if (t := normalise(r["text"]))]


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per (document, test item) whose best occurrence is within the item's error budget."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(block: list[tuple[int, str]]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for batch in batches:
                out = [(doc, *leak) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                       for leak in matcher.leaks(normalise(text.as_py()))]
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "item_id", "item_chars", "budget", "distance", "end_at"])
        return source.mapInArrow(search, LEAKS)

    return reduce(DataFrame.unionAll, [one(b) for b in _blocks(items, block_items)])


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents, all columns, that hold no test item within its budget; no shuffle."""
    at = docs.columns.index("text")

    def keep(df: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([next(matcher.leaks(normalise(t.as_py())), None) is None for t in batch.column(at)], pa.bool_()))
        return df.mapInArrow(run, docs.schema)

    return reduce(keep, _blocks(items, block_items), docs)
