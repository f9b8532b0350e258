"""Product codes of vectors by dual-tree Lloyd, exact in integers.

A component x becomes floor(1024 * x); a vector is cut into ``PARTS`` equal consecutive parts.  Each part position has a
codebook, which starts as that part of the vectors with the smallest ids.  A round assigns every part to its nearest
entry (squared Euclidean distance, ties to the lower index) and moves every entry to the floored mean of its parts.

Each task takes its rows in chunks and builds, for each part position, a tree over the chunk's parts whose nodes hold a
box, a count and a cached sum; the codebook has a tree of its own.  Both are walked together: a pair of nodes is dropped
when its least distance exceeds the greatest distance of another pair of the same part node.  A part node that one entry
wins over its whole box is assigned whole, by its cached sum; only the parts of uncertain leaves are compared one by
one, in integers.  Bounds are integers as well, so the result is that of plain comparison of all with all.  A task emits
one sum for each entry it has seen; codebooks (parts x entries) are all that the driver holds.  The trees of a chunk are
built again in each round: that costs about a tenth of a walk, while stored trees would be larger than the vectors.

Defined results: null vectors and vectors with null or non-finite components are dropped; shorter vectors are padded with
zeros to the longest, and that to a multiple of ``PARTS``; with fewer vectors than entries the codebook is shorter; null
ids come last in the choice of the first entries, equal ids are taken in the order of their vectors; repeated rows each
get a row; an error beyond 2 ** 63 - 1 is given as that; null labels are one label; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CHUNK = 4096                    # rows of a tree
LEAF, ENTRY_LEAF = 16, 8        # parts, entries in a leaf
COMBOS = 200_000                # part-entry distances at a time
LIMB = 48                       # bits of a limb of a sum: sums of any size are added up exactly
LONG = 2 ** 63 - 1
SALTS = 32
SUMS = "part int, entry int, limb int, n long, sums array<long>"
CODES = "id long, label string, code string, error long"


def as_integers(rows: list[list[float]], width: int) -> np.ndarray:
    """floor(SCALE * x), padded with zeros to ``width``; Python integers where 64 bits may not do."""
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    if not x.size or np.abs(x).max() < 2.0 ** 40:
        return np.floor(x * SCALE).astype(np.int64)
    exact = np.array([int(v) * SCALE if abs(v) >= 2.0 ** 52 else math.floor(v * SCALE) for v in x.ravel()] + [None], dtype=object)
    return exact[:-1].reshape(x.shape)


class Tree:
    """A balanced tree over the rows of ``x`` (kept in tree order): each node a run of rows with box, count and sum."""

    def __init__(self, x: np.ndarray, leaf: int):
        order, spans, children = np.arange(len(x)), [(0, len(x))], [None]
        at = 0
        while at < len(spans):
            a, b = spans[at]
            if b - a > leaf:
                held = x[order[a:b]]
                axis = int(np.argmax(held.max(0) - held.min(0)))
                order[a:b] = order[a:b][np.argsort(held[:, axis], kind="stable")]
                mid = (a + b) // 2
                children[at] = len(spans)
                spans += [(a, mid), (mid, b)]
                children += [None, None]
            at += 1
        self.order, self.x = order, x[order]
        self.start, self.end = (np.array(c) for c in zip(*spans))
        self.child = np.array([-1 if c is None else c for c in children])
        boxes = [(self.x[a:b].min(0), self.x[a:b].max(0), self.x[a:b].sum(0)) for a, b in spans]
        self.low, self.high, self.sum = (np.stack(c) for c in zip(*boxes))
        self.count = self.end - self.start


def _expand(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``nodes`` and child, for each child; a leaf stands for itself."""
    child, inner = tree.child[nodes], tree.child[nodes] >= 0
    at = np.arange(len(nodes))
    place = np.concatenate([at, at[inner]])
    return place, np.concatenate([np.where(inner, child, nodes), child[inner] + 1])


def _least(group: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """The least value of each group (groups without a value are not read)."""
    out = np.full(size, None if value.dtype == object else LONG, dtype=value.dtype)
    by = np.argsort(group, kind="stable")
    if len(by):
        first = np.flatnonzero(np.r_[True, np.diff(group[by]) > 0])
        out[group[by][first]] = np.minimum.reduceat(value[by], first)
    return out


def walk(parts: Tree, book: Tree) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The nearest entry of every row of ``parts`` (in tree order) and the (node, entry) that were assigned whole."""
    found, whole = np.full(len(parts.x), -1), []
    a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:     # down to the leaves of the entries, two levels at once
        near = np.maximum(np.maximum(book.low[b] - parts.high[a], parts.low[a] - book.high[b]), 0)
        far = np.maximum(book.high[b] - parts.low[a], parts.high[a] - book.low[b])
        bound = _least(a, (far * far).sum(1), len(parts.count))
        keep = (near * near).sum(1) <= bound[a]
        a, b = a[keep], b[keep]
        if (book.child[b] < 0).all():
            break
        place, b = _expand(book, b)
        a = a[place]
        place, a = _expand(parts, a)
        b = b[place]
    # From here on the candidates are entries: an entry that another beats over the whole box of a node goes.
    spread = np.repeat(np.arange(len(b)), book.count[b])
    inside = np.arange(len(spread)) - np.repeat(np.cumsum(book.count[b]) - book.count[b], book.count[b])
    a, e = a[spread], book.order[book.start[b][spread] + inside]
    x = np.empty_like(book.x)
    x[book.order] = book.x
    norm = (x * x).sum(1)
    while len(a):
        by = np.lexsort((e, a))
        a, e = a[by], e[by]
        first = np.flatnonzero(np.r_[True, np.diff(a) > 0])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(a)]))
        # Nearest to the middle of the box: twice the distance, to stay in integers.
        off = 2 * x[e] - parts.low[a] - parts.high[a]
        off = (off * off).sum(1)
        best = np.minimum.reduceat(off, first)
        lead = np.full(len(first), -1)
        hit = np.flatnonzero(off == best[group])[::-1]
        lead[group[hit]] = e[hit]
        rival = lead[group]
        lean = x[e] - x[rival]
        most = norm[rival] - norm[e] + 2 * np.where(lean > 0, lean * parts.high[a], lean * parts.low[a]).sum(1)
        keep = (e == rival) | ~((most < 0) | ((most == 0) & (rival < e)))
        a, e, group = a[keep], e[keep], group[keep]
        alone = np.bincount(group)[group] == 1
        for node, entry in zip(a[alone], e[alone]):
            found[parts.start[node]:parts.end[node]] = entry
            whole.append((int(node), int(entry)))
        a, e = a[~alone], e[~alone]
        leaf = parts.child[a] < 0
        _compare(parts, x, a[leaf], e[leaf], found)
        place, a2 = _expand(parts, a[~leaf])
        a, e = a2, e[~leaf][place]
    return found, whole


def _compare(parts: Tree, x: np.ndarray, a: np.ndarray, e: np.ndarray, found: np.ndarray) -> None:
    """Integer distances of the rows of uncertain leaves to their candidates (ascending by node and entry)."""
    if not len(a):
        return
    first = np.flatnonzero(np.r_[True, np.diff(a) > 0])
    last = np.r_[first[1:], len(a)]
    work = np.cumsum(parts.count[a[first]] * (last - first))
    cuts = [0, *(np.flatnonzero(np.diff(work // COMBOS)) + 1), len(first)]
    for p, q in zip(cuts, cuts[1:]):
        rows, entries, starts, size = [], [], [], 0
        for k in range(p, q):
            node, held = a[first[k]], e[first[k]:last[k]]
            run = np.arange(parts.start[node], parts.end[node])
            rows.append(np.repeat(run, len(held)))
            entries.append(np.tile(held, len(run)))
            starts.append(size + np.arange(len(run)) * len(held))
            size += len(run) * len(held)
        row, entry, start = np.concatenate(rows), np.concatenate(entries), np.concatenate(starts)
        gap = parts.x[row] - x[entry]
        gap = (gap * gap).sum(1)
        least = np.repeat(np.minimum.reduceat(gap, start), np.diff(np.r_[start, size]))
        hit = np.flatnonzero(gap == least)[::-1]    # the first hit of a row, its lowest entry, is written last
        found[row[hit]] = entry[hit]


def _fits(x: np.ndarray, book: np.ndarray) -> bool:
    """Whether all distances and bounds of these parts fit 64 bits."""
    if x.dtype == object or book.dtype == object:
        return False
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    return 64 * most * most * max(1, x.shape[1]) < LONG and most * CHUNK < LONG


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row of ``x``; count and sum of the rows of each entry."""
    if not _fits(x, book):
        x, book = x.astype(object), book.astype(object)
    parts = Tree(x, LEAF)
    found, whole = walk(parts, Tree(book, ENTRY_LEAF))
    count, total = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=x.dtype)
    single = np.ones(len(x), dtype=bool)
    for node, entry in whole:
        count[entry] += parts.count[node]
        total[entry] += parts.sum[node]
        single[parts.start[node]:parts.end[node]] = False
    np.add.at(count, found[single], 1)
    np.add.at(total, found[single], parts.x[single])
    out = np.empty(len(x), dtype=np.int64)
    out[parts.order] = found
    return out, count, total


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            piece = b.slice(at, CHUNK)
            yield piece, as_integers(piece.column("v").to_pylist(), width)


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    w = x.shape[1] // parts
    return [x[:, p * w:(p + 1) * w] for p in range(parts)]


def _limbs(total: np.ndarray) -> Iterator[list[int]]:
    """Limbs of ``LIMB`` bits, lowest first, each with the sign of its number."""
    left = [(1 if v >= 0 else -1, abs(int(v))) for v in total]
    while True:
        yield [s * (v & (1 << LIMB) - 1) for s, v in left]
        left = [(s, v >> LIMB) for s, v in left]
        if not any(v for _, v in left):
            return


def _moved(kept: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round over all vectors."""
    w = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list | None] = [None] * len(books)
        for _, x in _chunks(batches, width):
            for p, part in enumerate(_cut(x, len(books))):
                _, count, total = assign(part, books[p])
                held[p] = [count, total.astype(object)] if held[p] is None else [held[p][0] + count, held[p][1] + total]
        rows = []
        for p, got in enumerate(held):
            for e in range(len(books[p])) if got else ():
                if got[0][e]:
                    rows += [(p, e, k, int(got[0][e]) if k == 0 else 0, limb) for k, limb in enumerate(_limbs(got[1][e]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SUMS.types)], schema=_SUMS)

    got = (kept.select("v").mapInArrow(sums, SUMS).groupBy("part", "entry", "limb")
           .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k].cast("decimal(20,0)")) for k in range(w)]).alias("sums")))
    counts, totals = {}, {}
    for part, entry, limb, n, values in got.collect():    # at most parts x entries x limbs rows
        key = (part, entry)
        counts[key] = counts.get(key, 0) + n
        totals[key] = [a + (int(v) << (LIMB * limb)) for a, v in zip(totals.get(key, [0] * w), values)]
    return [_narrow([[t // counts[p, e] for t in totals[p, e]] if (p, e) in counts else list(book[e]) for e in range(len(book))])
            for p, book in enumerate(books)]


def _narrow(rows: list[list[int]]) -> np.ndarray:
    big = any(abs(int(v)) >= 2 ** 62 for r in rows for v in r)
    out = np.empty((len(rows), len(rows[0])), dtype=object if big else np.int64)
    for i, r in enumerate(rows):
        out[i] = [int(v) for v in r]
    return out


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_CODES = pa.schema([("id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label (as text), v of the vectors without a null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"),
                          F.coalesce(bad, F.lit(False)).alias("bad")).where("v IS NOT NULL AND NOT bad").drop("bad")


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks of all rounds over all vectors, and the padded width; no codebooks without vectors."""
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return [], 0
    width = -(-longest // parts) * parts
    first = [r[0] for r in kept.select("v", "id").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    books = _cut(_narrow(as_integers(first, width).tolist()), parts) if width else [np.zeros((len(first), 0), dtype=np.int64)] * parts
    for _ in range(rounds if width else 0):
        books = _moved(kept, books, width)
    return books, width


def encode(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """id, label, code, error of every vector."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _chunks(batches, width):
            code, error = [""] * len(x), [0] * len(x)
            for part, book in zip(_cut(x, len(books)), books):
                near = assign(part, book)[0] if width else np.zeros(len(x), dtype=np.int64)
                if not _fits(part, book):
                    part, book = part.astype(object), book.astype(object)
                gap = part - book[near]
                error = [a + int(b) for a, b in zip(error, (gap * gap).sum(1) if width else [0] * len(x))]
                code = [a + f"{e:02x}" for a, e in zip(code, near)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("label"), pa.array(code, pa.string()), pa.array([min(e, LONG) for e in error], pa.int64())], schema=_CODES)

    return kept.mapInArrow(codes, CODES)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels; the rows of a frequent label are spread by salt."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy("label").agg(total.alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")
    c, t = coded.withColumn("salt", salt).alias("c"), totals.alias("t")
    return (c.join(t, (F.col("c.salt") == F.col("t.salt")) & F.col("c.label").eqNullSafe(F.col("t.label")))
            .select("c.id", "c.label", "c.code", "c.error", "t.label_error"))


def compress(vectors: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept."""
    kept = kept_vectors(vectors, vector, label)
    books, width = fit(kept, parts, entries, rounds)
    coded = staged(encode(kept, books, width), "codes") if books else kept.sparkSession.createDataFrame([], CODES)
    return with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                                          F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
