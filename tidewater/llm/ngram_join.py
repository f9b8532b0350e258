"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Documents are linked when the Jaccard similarity of their sets of word n-grams reaches ``percent`` / 100.  The join is
exact; every step drops only what cannot be linked.

1. Classes: documents with the same set share a signature; one of them stands for all.
2. Size-derived bounds: a partner of a set of n must share at least t = ceil(percent * n / 100) n-grams, so among the
   n - t + l smallest hashes of both sets at least l are common.  The n-grams of that prefix that occur in no other
   class are counted by two aggregations; a class with too few others cannot have a partner and leaves.
3. The incidence of the classes that remain: n-grams in one class only cannot count; the others are ordered by how
   many classes hold them, and the rarest n - t + 1 of a class must hit a partner's.  Classes that share such a column
   form a cluster; other pairs cannot be linked.
4. Product: a cluster, sorted by set size, is cut into blocks; each pair of blocks whose sizes allow a link multiplies
   its incidence matrices (columns in slices), which accumulates the overlaps of all its pairs at once, and keeps a
   spanning forest of the links found.  Components of these links are the result.

Nothing is dropped or capped: a common n-gram only moves to the end of the order.  Copies are rows of one class, near
copies meet in blocks, and no pair is a row.

Defined results: null text is the empty text; texts without words have n_shingles 0 and are linked with nothing;
texts of fewer words than n count as one n-gram; rows that repeat a doc_id are linked like others, each by its own text;
a null doc_id takes part but names no component (one without other ids has a null name); an empty table gives an empty
table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, staged
from .components import components

WORDS = 4
PERCENT = 85
BLOCK = 512                 # classes in a block of the product
COLUMNS = 2048              # n-grams of a slice of the product
SLICE_BYTES = 250_000       # text handled at once

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_R, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte string begin, and a 64-bit hash of each (A-Z as a-z)."""
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    # Sum of mixed bytes times powers of an odd number, by prefix sums, divided by the power at the word's start.
    powers = np.full(len(data), _R, dtype=np.uint64).cumprod(dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(_LOWER[data] + np.uint64(1)) * powers, dtype=np.uint64)])
    back = np.full(len(data) + 1, _INVERSE, dtype=np.uint64).cumprod(dtype=np.uint64)
    return starts, _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes (signed 64 bits) of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in [*texts, None]:
        if t is not None:
            part.append(t)
            size += len(t) + 1
        if part and (t is None or size > SLICE_BYTES):
            data = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
            starts, h = _word_hashes(data)
            limits = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in part]))
            lo = 0
            n = max(len(h) - words + 1, 0)
            grams = np.full(n, np.uint64(words), dtype=np.uint64)
            for k in range(words):
                grams = _mix(grams * _R + h[k:k + n])
            for hi in limits:
                if hi - lo >= words:
                    out.append(np.unique(grams[lo:hi - words + 1].view(np.int64)))
                else:
                    g = np.full(1, np.uint64(hi - lo), dtype=np.uint64)
                    for x in h[lo:hi]:
                        g = _mix(g * _R + x)
                    out.append(g.view(np.int64) if hi > lo else np.zeros(0, np.int64))
                lo = hi
            part, size = [], 0
    return out


def least_common(n: int | Column, percent: int) -> int | Column:
    """What a set of n must share with any partner."""
    return F.ceil(n * percent / F.lit(100.0)) if isinstance(n, Column) else -(-n * percent // 100)


def _spare(n: int, percent: int) -> int:
    """l of the longer prefix: as many n-grams again as a partner may lack."""
    return max(1, n * (100 - percent) // 100)


def _needed(n: int, percent: int) -> int:
    """How many prefix n-grams a class of n must share: l of the smallest partner."""
    return _spare(least_common(n, percent), percent)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k and th (the key of a row: its id and the hash of its text), text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))


def profiles(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, k, th, n, sig (signature of the set; s1, s2: its halves), needed, prefix (its smallest hashes) of ``keyed`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                rows = []
                for g in shingle_sets(_bytes(b.column(3)), words):
                    n = len(g)
                    rows.append((n, _signature(g), _needed(n, percent), g[:n - least_common(n, percent) + _spare(n, percent)]))
                n, sig, needed, prefix = zip(*rows)
                halves = np.frombuffer(b"".join(sig), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                     pa.array(needed, pa.int64()), pa.array(list(prefix), pa.list_(pa.int64()))],
                    ["doc_id", "k", "th", "n", "sig", "s1", "s2", "needed", "prefix"])
    return docs.mapInArrow(run, "doc_id long, k long, th long, n long, sig binary, s1 long, s2 long, needed long, prefix array<long>")


def _signature(g: np.ndarray) -> bytes:
    return hashlib.md5(g.tobytes()).digest()


def _bytes(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """rep, n, grams of the texts whose set has the signature ``rep`` that was asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                keep = [(rep, len(g), g) for rep, g in zip(b.column(0).to_pylist(), shingle_sets(_bytes(b.column(1)), words)) if _signature(g) == rep]
                if keep:
                    r, n, g = zip(*keep)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()), pa.array(n, pa.int64()), pa.array(list(g), pa.list_(pa.int64()))],
                                                     ["rep", "n", "grams"])
    return docs.select("rep", "text").mapInArrow(run, "rep binary, n long, grams array<long>")


def block_links(rows: list[tuple[bytes, int, np.ndarray]], others: list[tuple[bytes, int, np.ndarray]] | None, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between the classes of two blocks, or inside one (``others`` None)."""
    left, right = rows, rows if others is None else others
    flat = np.concatenate([g for _, _, g in left] + ([] if others is None else [g for _, _, g in right]))
    ids, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1            # n-grams of one class alone add nothing to an overlap
    column = np.where(times[column] > 1, new[column], -1)
    cols, at = [], 0
    for _, n, _ in left if others is None else [*left, *right]:
        c = column[at:at + n]
        cols.append(np.sort(c[c >= 0]))
        at += n
    mine, theirs = cols[:len(left)], cols if others is None else cols[len(left):]
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int((times > 1).sum()), COLUMNS):
        a = _dense(mine, lo)
        overlap += a @ (a if others is None else _dense(theirs, lo)).T
    na, nb = np.array([n for _, n, _ in left]), np.array([n for _, n, _ in right])
    o = np.rint(overlap).astype(np.int64)
    linked = 100 * o >= percent * (na[:, None] + nb[None, :] - o)
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = left[i][0], right[j][0]
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _dense(cols: list[np.ndarray], lo: int) -> np.ndarray:
    out = np.zeros((len(cols), COLUMNS), dtype=np.float32)
    for i, c in enumerate(cols):
        out[i, c[np.searchsorted(c, lo):np.searchsorted(c, lo + COLUMNS)] - lo] = 1
    return out


def links(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """a, b: a spanning forest of the links between the given classes (rep, n, grams)."""
    rows = sets.select("rep", "n", F.explode("grams").alias("g"))
    shared = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # n-grams of a class that others hold too, rarest first, beyond those that nobody else holds
    ordered = (rows.join(shared, "g").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("held")))
    take = F.col("n") - least_common(F.col("n"), percent) + 1 - (F.col("n") - F.size("held"))
    prefix = ordered.where(take > 0).select("rep", F.explode(F.slice("held", F.lit(1), take.cast("int"))["g"]).alias("g"))
    prefix = staged(prefix, "prefix")   # rep: the signature of a class
    lead = prefix.groupBy("g").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("df")).where("df > 1").select("g", "lead")
    clusters = components(prefix.join(lead, "g").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    # Blocks of a cluster by set size: rank in pieces, so that a large cluster is no single sort.
    own = staged(sets.select("rep", "n").join(clusters, sets["rep"] == clusters["node"]).select("rep", "n", "component"), "clusters")
    release(prefix)
    sizes = own.groupBy("component", "n").agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.partitionBy("component").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(up_to), F.lit(0))).select("component", "n", "before")
    tie = Window.partitionBy("component", "n").orderBy("rep")
    ranked = own.withColumn("i", F.row_number().over(tie) - 1).join(before, ["component", "n"]).select(
        "rep", "n", "component", F.floor((F.col("i") + F.col("before")) / block).alias("block"))
    spans = ranked.groupBy("component", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = spans.alias("x"), spans.alias("y")
    # Blocks, not documents: a pair of blocks is worth a task only if their sizes allow a link.
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block"))
                   & (F.col("x.most") * 100 >= F.col("y.least") * percent)).select(
        F.col("x.component").alias("component"), F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    seats = (pairs.select("component", "p", "q", F.col("p").alias("block"), F.lit(0).alias("side"))
             .unionAll(pairs.where("p <> q").select("component", "p", "q", F.col("q").alias("block"), F.lit(1).alias("side"))))
    seated = (ranked.join(seats, ["component", "block"]).join(sets.select("rep", "grams"), "rep")
              .select("component", "p", "q", "side", "rep", "n", "grams"))

    def multiply(t: pa.Table) -> pa.Table:
        side = t.column("side").to_pylist()
        rows = list(zip(t.column("rep").to_pylist(), t.column("n").to_pylist(),
                        (np.asarray(g.values) for g in t.column("grams").combine_chunks())))
        one, two = [r for r, s in zip(rows, side) if s == 0], [r for r, s in zip(rows, side) if s == 1]
        found = block_links(one, two or None, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return seated.groupBy("component", "p", "q").applyInArrow(multiply, "a binary, b binary")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return linked(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, component (its name by signature, null for an empty set)."""
    source = keyed(docs)
    held = staged(profiles(source, words, percent), "profiles")
    full = held.where("n > 0")
    # A signature's n-grams are one set, whichever row they come from.  Least and greatest of both halves as numbers:
    # Spark aggregates them by hash, a binary signature it would sort.
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max)]
    alone = staged(full.select("s1", "s2", F.explode("prefix").alias("g")).groupBy("g").agg(*ends)
                   .where("min_s1 = max_s1 AND min_s2 = max_s2")
                   .groupBy(F.col("min_s1").alias("s1"), F.col("min_s2").alias("s2")).agg(F.count(F.lit(1)).alias("alone")), "alone")
    seen = staged(held.drop("prefix"), "seen")
    release(held)
    classes = (seen.where("n > 0").groupBy("sig")
               .agg(F.min(F.struct("k", "th")).alias("key"), F.min("doc_id").alias("least_id"), *[F.min(c).alias(c) for c in ("n", "needed", "s1", "s2")]))
    length = F.col("n") - least_common(F.col("n"), percent) + F.greatest(F.lit(1), F.floor(F.col("n") * (100 - percent) / F.lit(100.0)))
    able = (classes.join(alone, ["s1", "s2"], "left").where(length - F.coalesce("alone", F.lit(0)) >= F.col("needed"))
            .select(F.col("sig").alias("rep"), "key.k", "key.th"))
    sets = staged(_sets(source.select("k", "th", "text").join(able, ["k", "th"]), words).dropDuplicates(["rep"]), "sets")
    found = components(links(sets, percent))
    release(sets, alone)
    # Components by signature; the smallest id in one is its name.
    named = classes.join(found, classes["sig"] == found["node"], "left").select("sig", "least_id", F.coalesce("component", "sig").alias("component"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(names, "component").select("sig", "component", "component_id")
    return (seen.join(named, "sig", "left")
            .select("doc_id", "th", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component"))
