"""Merkle manifest of a data set as postorder append logs, with a proof for every row.

Leaves ascend by (doc_id, leaf) within a group (``lang``); every ``FAN`` consecutive nodes of a level become one node,
the last run of fewer too, until one remains: the group's subroot.  Subroots, ordered by group, likewise give the root.

1. Leaf digests are taken where the texts are read; only narrow rows are shuffled.
2. Leaves are numbered per group through range partitions: place in the partition plus the rows before it, so a group
   that holds most rows is spread over all tasks.
3. Aligned builders: a task builds the subtree over ``FAN ** LEVELS`` consecutive leaves and appends its nodes in
   completion order, which is postorder.  Builder roots are the next tier's leaves; a tier shrinks the tree 4,096 times.
4. Proofs, from the top tier down: ``position`` gives a node's place in a log in closed form from subtree sizes, so the
   siblings of a leaf are read by address; what lies above a builder is attached once for each builder, not leaf.

Defined results: null fields enter a leaf as ``-``; null doc_ids come first; rows of equal doc_id are ordered by leaf,
equal rows each get a leaf; null lang is a group of its own, before all others; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged

FAN, LEVELS = 8, 4
SPAN = FAN ** LEVELS            # leaves of one builder
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOG = "g string, block long, pos long, place long, top boolean, digest string, id long, other string"
PATH = ("g string, block long, digest string, id long, other string, lefts array<string>, rights array<string>, "
        "subroot string, root string")
PROOF = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
         "verified boolean")


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def position(level: int, j: int, n: int, levels: int) -> int:
    """Place of node ``j`` of ``level`` in the postorder log of a tree over ``n`` leaves.

    A node is complete with its last leaf, m leaves from the left.  Before it stand all nodes that end at m or earlier
    on its own level and below, and those that end before m above it.
    """
    m = min((j + 1) * FAN ** level, n)
    if m < n:
        return sum((m if k <= level else m - 1) // FAN ** k for k in range(levels + 1)) - 1
    return sum(-(-n // FAN ** k) - (k > level) for k in range(levels + 1)) - 1


def leaf_digest(text: Column, alias: str = "leaf") -> Column:
    """Digest of a row's fields, each with its length in front, ``text`` as given."""
    fields = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
                             for c in fields]), 256).alias(alias)


def leaves(docs: DataFrame) -> DataFrame:
    """g (the group, null first), id, digest, other (the leaf of the tampered row, null where nothing is tampered)."""
    text = F.col("text").cast("string")
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return docs.select(F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("g"),
                       F.col("doc_id").cast("long").alias("id"), leaf_digest(text, "digest"),
                       F.when(tampered & (lowered != text), leaf_digest(lowered)).alias("other"))


def _levels(n: int) -> int:
    """Levels that a builder of a tree over ``n`` leaves adds."""
    return LEVELS if n > SPAN else depth(n)


def build(t: pa.Table) -> pa.Table:
    """The log of one builder: its nodes in completion order."""
    t = t.sort_by("i")
    g, block = t.column("g")[0].as_py(), t.column("block")[0].as_py()
    levels = _levels(t.column("n")[0].as_py())
    digests, ids, others = (t.column(c).to_pylist() for c in ("digest", "id", "other"))
    out: list[tuple] = []
    open_runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def append(level: int, digest: str, place: int | None = None) -> None:
        leaf = place is not None
        out.append((place, level == levels, digest, ids[place] if leaf else None, others[place] if leaf else None))
        if level < levels:
            open_runs[level].append(digest)
            if len(open_runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        append(level + 1, h("".join(run)))

    for place, digest in enumerate(digests):
        append(0, digest, place)
    for level in range(levels):     # the last, shorter runs
        if open_runs[level]:
            close(level)
    place, top, digest, id_, other = zip(*out)
    count = len(out)
    return pa.table({"g": pa.array([g] * count, pa.string()), "block": pa.array([block] * count, pa.int64()),
                     "pos": pa.array(range(count), pa.int64()), "place": pa.array(place, pa.int64()), "top": pa.array(top, pa.bool_()),
                     "digest": pa.array(digest, pa.string()), "id": pa.array(id_, pa.int64()), "other": pa.array(other, pa.string())})


def tree(rows: DataFrame) -> list[DataFrame]:
    """Logs of all tiers, from the leaves up; ``rows`` (g, id, digest, other) with i and n of ``numbered``.  The nodes with ``top`` of the last are the roots."""
    largest = rows.agg(F.max("n")).first()[0] or 0
    tiers = []
    while True:
        blocks = rows.withColumn("block", F.floor(F.col("i") / SPAN))
        tiers.append(staged(blocks.groupBy("g", "block").applyInArrow(build, LOG), "merkle-log"))
        if largest <= SPAN:
            return tiers
        largest = -(-largest // SPAN)
        sizes = tiers[-1].where("top").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        rows = tiers[-1].where("top").join(sizes, "g").select(
            "g", F.lit(None).cast("long").alias("id"), "digest", F.lit(None).cast("string").alias("other"), F.col("block").alias("i"), "n")


def _paths(log: pa.Table, path: pa.Table):
    """For each leaf of a builder: place, digest, id, other, and left and right siblings for each level up to the root.

    Siblings are read from the log by address.
    """
    log = log.sort_by("pos")
    nodes, place = log.column("digest").to_pylist(), log.column("place").to_pylist()
    ids, others = log.column("id").to_pylist(), log.column("other").to_pylist()
    at_leaf = [p for p, k in enumerate(place) if k is not None]
    n = len(at_leaf)
    # A lone leaf is its own root; else the builder's depth follows from the number of nodes that its log holds.
    levels = next(k for k in range(LEVELS + 1) if sum(-(-n // FAN ** x) for x in range(k + 1)) == len(nodes))
    above = [([x or "" for x in path.column("lefts")[0].as_py()], [x or "" for x in path.column("rights")[0].as_py()])]
    for level in range(levels - 1, -1, -1):
        count = -(-n // FAN ** level)
        row = [nodes[position(level, j, n, levels)] for j in range(count)]
        below = []
        for j in range(count):
            start = j - j % FAN
            lefts, rights = above[j // FAN]
            below.append((["".join(row[start:j]), *lefts], ["".join(row[j + 1:start + FAN]), *rights]))
        above = below
    for k, p in enumerate(at_leaf):
        yield k, nodes[p], ids[p], others[p], *above[k]


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that follows from a leaf and its siblings."""
    for a, b in zip(lefts, rights):
        digest = h(a + digest + b)
    return digest


def _one(path: pa.Table, name: str) -> str | None:
    return path.column(name)[0].as_py()


def lower_paths(log: pa.Table, path: pa.Table) -> pa.Table:
    """Paths of the builders below (or of the groups, in the tree of groups)."""
    if not (log.num_rows and path.num_rows):
        return pa.table({f.name: pa.array([], f.type) for f in _PATH})
    g, block = log.column("g")[0].as_py(), log.column("block")[0].as_py()
    rows = [(g, block * SPAN + k, digest, id_, other, lefts, rights, _one(path, "subroot"), _one(path, "root"))
            for k, digest, id_, other, lefts, rights in _paths(log, path)]
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_PATH, zip(*rows))})


def proofs_of(log: pa.Table, path: pa.Table) -> pa.Table:
    """Proof and check of every row of a builder."""
    if not (log.num_rows and path.num_rows):
        return pa.table({f.name: pa.array([], f.type) for f in _PROOF})
    subroot, root = _one(path, "subroot"), _one(path, "root")
    rows = []
    for _, leaf, id_, other, lefts, rights in _paths(log, path):
        proof = h("".join(x for pair in zip(lefts, rights) for x in pair))
        folded = fold(other or leaf, lefts, rights)
        rows.append((id_, leaf, subroot, root, proof, folded, folded == root))
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_PROOF, zip(*rows))})


_TEXTS = pa.list_(pa.string())
_PATH = pa.schema([("g", pa.string()), ("block", pa.int64()), ("digest", pa.string()), ("id", pa.int64()), ("other", pa.string()),
                   ("lefts", _TEXTS), ("rights", _TEXTS), ("subroot", pa.string()), ("root", pa.string())])
_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                    ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def _with_paths(log: DataFrame, paths: DataFrame, emit, schema: str) -> DataFrame:
    return log.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(emit, schema)


def _down(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the leaves of the lowest of ``tiers``, given those of the builders of the highest."""
    for log in reversed(tiers):
        paths = _with_paths(log, paths, lower_paths, PATH)
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``."""
    tiers = tree(numbered(staged(leaves(docs), "leaves"), "g", "id", "digest"))
    # The tree of groups: the group itself stands in ``other``.
    groups = tiers[-1].where("top").select(F.lit("").alias("g"), F.lit(None).cast("long").alias("id"), "digest", F.col("g").alias("other"))
    upper = tree(numbered(groups, "g", "other"))
    none = F.array().cast("array<string>")
    start = upper[-1].where("top").select("g", "block", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"),
                                          F.col("digest").alias("root"))
    paths = staged(_down(upper, start).select(F.col("other").alias("g"), F.lit(0).cast("long").alias("block"), "lefts", "rights",
                                              F.col("digest").alias("subroot"), "root"), "subroots")
    return _with_paths(tiers[0], _down(tiers[1:], paths), proofs_of, PROOF)
