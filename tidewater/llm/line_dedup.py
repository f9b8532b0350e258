"""Line deduplication by content-defined chunks of lines, with DataFrame expressions only.

Every line is hashed; a rolling hash over the hashes of neighbouring lines chooses where chunks end, so boundaries
depend on the lines around them alone and fall alike wherever a passage stands (but none cuts off a text's last
line alone).  A line of ``SOLO_CHARS`` or more is
a chunk of its own.  A chunk of several lines (or a solo line) that occurs more than once in the whole table keeps
its first occurrence, by doc_id, text hash and place; the others go after a comparison of their bytes.

Plan: chunk lists are dealt by document once and that exchange is reused by every branch.  Repeats are found on
narrow rows (document, place, hash, length); only chunks with a repeated hash are compared as texts.  A chunk that a
third of the documents hold is one row per task after partial aggregation, and the two joins on chunk hashes are
plain equi-joins whose skewed partitions Spark splits.

``without_passages`` is for what the chunks leave: runs of lines with more than ``PASSAGE_WORDS`` words that still
stand in two documents, because a chunk's ends differ or a repeated line is no chunk that may go.  From every line that
holds a word, the fewest lines with so many words are hashed; the document with the smallest key keeps them.

Defined results: null text is the empty text and has nothing to remove; rows that repeat both doc_id and text get
equal results; a null doc_id sorts first; an empty table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

SOLO_CHARS = 300
MIN_CHARS = 60
PASSAGE_WORDS = 50
NO_ID = -(2 ** 63)
BLANK = " \t\n\r"


def _escaped(t: Column) -> Column:
    """Frees U+0001 for use as the chunk mark."""
    return F.replace(F.replace(t, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))


def _plain(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))


def _shift(a: Column, kind: str) -> Column:
    """The array one place later, with a null in front."""
    return F.concat(F.array(F.lit(None).cast(kind)), F.slice(a, F.lit(1), F.size(a) - 1))


def _next(a: Column, kind: str) -> Column:
    return F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.array(F.lit(None).cast(kind)))


def chunked(docs: DataFrame) -> DataFrame:
    """k1 (doc_id), k2 (text hash), chunks (escaped)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(t).alias("k2"),
                        F.split(_escaped(t), "\n").alias("lines"))
    hashed = lines.select("k1", "k2", "lines", F.transform(
        "lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")).alias("h"),
        F.transform("lines", lambda x: F.length(x) >= SOLO_CHARS).alias("solo"))
    # The rolling hash of a line and the one before it; null in front of the first line.
    rolled = hashed.select("k1", "k2", "lines", "solo", F.zip_with(
        _shift(F.col("h"), "long"), "h", lambda a, b: F.coalesce(F.shiftright(a * 31 + b, 3) % 2 == 0, F.lit(False))).alias("cut"))
    ends = rolled.select("k1", "k2", "lines", F.zip_with(
        F.transform(F.zip_with("cut", _shift(F.col("cut"), "boolean"), lambda a, b: a & ~F.coalesce(b, F.lit(False))),
                    lambda x, i: x & (i != F.size("lines") - 2)),
        F.zip_with("solo", _next(F.col("solo"), "boolean"), lambda a, b: a | F.coalesce(b, F.lit(True))),
        lambda a, b: a | b).alias("ends"))
    marked = F.array_join(F.zip_with("lines", "ends", lambda x, e: F.concat(x, F.when(e, F.lit("\x01")).otherwise(F.lit("\n")))), "")
    parts = ends.select("k1", "k2", F.split(marked, "\x01").alias("parts"))
    return parts.select("k1", "k2", F.slice("parts", F.lit(1), F.size("parts") - 1).alias("chunks"))


def _counts(c: Column) -> Column:
    """Whether a chunk is one that may be removed: several lines, or a solo line."""
    several = (F.instr(F.btrim(c, F.lit(BLANK)), "\n") > 0) & (F.length(c) >= MIN_CHARS)
    return several | (F.length(c) >= SOLO_CHARS)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text (without repeated chunks; null if nothing of a text is left), n_chunks, n_removed."""
    dealt = chunked(docs).repartition("k1", "k2")
    # The outer form (lists are never empty) adds no filter of its own below the exchange, so that it stays the same one.
    rows = (dealt.select("k1", "k2", F.posexplode_outer("chunks").alias("at", "chunk")).where(_counts(F.col("chunk")))
            .select("k1", "k2", "at", F.xxhash64("chunk").alias("h"), F.length("chunk").alias("n")))
    place = F.struct("k1", "k2", "at")
    repeated = (rows.groupBy("h", "n").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
                .where("times > 1").select("h", "n", "first"))
    suspects = (rows.join(repeated, ["h", "n"]).groupBy("k1", "k2")
                .agg(F.collect_list(F.struct("at", "h", "n", "first")).alias("suspects")))
    texts = (dealt.join(suspects, ["k1", "k2"]).select("k1", "k2", "chunks", F.inline_outer("suspects"))
             .select("k1", "k2", "at", "h", "n", "first", F.get("chunks", F.col("at")).alias("chunk")))
    kept = texts.where(place == F.col("first")).select("h", "n", F.col("chunk").alias("kept")).distinct()
    same = (texts.where(place != F.col("first")).join(kept, ["h", "n"]).where(F.col("chunk") == F.col("kept"))
            .groupBy("k1", "k2").agg(F.collect_set("at").alias("removed")))
    chunks, removed = F.col("chunks"), F.coalesce("removed", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), removed)
    out = dealt.join(same, ["k1", "k2"], "left").select(
        "k1", "k2", F.size(chunks).cast("long").alias("n_chunks"), F.size(removed).cast("long").alias("n_removed"),
        F.when(F.size(left) > 0, _plain(F.array_join(F.transform(left, lambda i: F.get(chunks, i)), "\n"))).alias("text"))
    return out.select(F.when(F.col("k1") != NO_ID, F.col("k1")).alias("doc_id"), F.col("k2").alias("text_hash"),
                      "text", "n_chunks", "n_removed")


def without_passages(docs: DataFrame) -> DataFrame:
    """k1, k2, text: of each run of lines of more than ``PASSAGE_WORDS`` words only the first document keeps the lines.

    Reads k1, k2 (a document's key) and text.  Lines without a word neither part a run nor go; a text that loses all
    its other lines is null.  Lines that meet where others went are not searched again.
    """
    place = F.struct("k1", "k2")
    dealt = docs.select("k1", "k2", "text").where("text IS NOT NULL").repartition("k1", "k2")
    lines = F.split("text", "\n")
    # Lines that hold a word, with their places; a run is a slice of them, of at most PASSAGE_WORDS + 1.
    held = dealt.select("k1", "k2", F.filter(F.transform(lines, lambda x, i: F.struct(
        i.alias("i"), x.alias("line"), F.least(F.size(words(x)), F.lit(PASSAGE_WORDS + 1)).alias("n"))), lambda x: x["n"] > 0).alias("w"))
    numbers = held.select("k1", "k2", F.col("w.n").alias("n"), F.transform("w", lambda x: F.xxhash64(x["line"])).alias("h"))
    # 1024 for each line, and its words; as it is once the words are more than PASSAGE_WORDS.
    fewest = F.transform("n", lambda _, i: F.aggregate(F.slice("n", i + 1, F.lit(PASSAGE_WORDS + 1)), F.lit(0), lambda a, n: F.when(
        a % 1024 > PASSAGE_WORDS, a).otherwise(a + 1024 + n)))
    runs = F.transform(fewest, lambda a, i: F.struct(
        i.alias("at"), F.when(a % 1024 > PASSAGE_WORDS, F.shiftright(a, 10)).alias("size")))
    rows = (numbers.select("k1", "k2", "h", F.inline_outer(runs)).where("size IS NOT NULL")
            .select("k1", "k2", "at", "size", F.xxhash64(F.slice("h", F.col("at") + 1, F.col("size"))).alias("h")))
    repeated = rows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    suspects = (rows.join(repeated, "h").groupBy("k1", "k2")
                .agg(F.collect_set(F.struct("at", "size", "h", "first")).alias("suspects")))
    texts = (held.join(suspects, ["k1", "k2"]).select("k1", "k2", "w", F.inline_outer("suspects"))
             .select("k1", "k2", "h", "first", F.array_join(F.slice(F.col("w.line"), F.col("at") + 1, F.col("size")), "\n").alias("run"),
                     F.slice(F.col("w.i"), F.col("at") + 1, F.col("size")).alias("places")))
    kept = texts.where(place == F.col("first")).select("h", F.col("run").alias("kept")).distinct()
    same = (texts.where(place != F.col("first")).join(kept, "h").where(F.col("run") == F.col("kept"))
            .groupBy("k1", "k2").agg(F.flatten(F.collect_set("places")).alias("gone")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    rest = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return (dealt.join(same, ["k1", "k2"], "left").select("k1", "k2", "text", "gone", lines.alias("lines"))
            .select("k1", "k2", F.when(F.col("gone").isNull(), F.col("text")).when(F.size(words(rest)) > 0, rest).alias("text")))
