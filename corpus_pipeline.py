"""Corpus pipeline: toxic documents go, repeated line chunks go, one of each group of near copies stays, benchmark
leaks go, the rest is packed into token windows.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet to the shared folder and reads it again as the next
stage's ``docs``, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import release, staged, table
from tidewater.llm.decontaminate import without_leaks
from tidewater.llm.line_dedup import NO_ID, dedup_lines, without_passages
from tidewater.llm.ngram_join import linked
from tidewater.llm.packing import pack_documents
from tidewater.llm.toxicity import train, without_toxic
from tidewater.session import configure


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents outside the held-out fifth; documents scored 0.5 or more go."""
    configure(spark)
    return without_toxic(docs, train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go; a document of which nothing is left goes, an empty one stays.

    n_chars becomes the length of the remaining text.
    """
    configure(spark)
    return _with_others(docs, _chunks(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As ``drop_repeated_lines``; then what still repeats of line runs of over 50 words goes, too."""
    configure(spark)
    # Written first: the search reads its input in several branches.
    return _with_others(docs, without_passages(staged(_chunks(docs), "chunks")))


def _chunks(docs: DataFrame) -> DataFrame:
    """k1, k2 (the key of a document: id and hash of the text), text without repeated chunks; once for each key."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.col("text_hash").alias("k2"), "text").dropDuplicates(["k1", "k2"])


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")]


def _numbered_columns(docs: DataFrame, *without: str) -> list[Column]:
    """The columns of ``docs`` under names of their own (c0, c1, ...), so that none can clash."""
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in without]


def _with_others(docs: DataFrame, left: DataFrame) -> DataFrame:
    """Each row of ``docs`` with the text of ``left`` (k1, k2, text; null for a document that goes); n_chars is its length.

    Rows that repeat an id and a text get the same text, each keeps its own other columns.
    """
    rows = docs.select(*_key(), *_numbered_columns(docs, "text")).join(left.where("text IS NOT NULL"), ["k1", "k2"])
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return rows.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (word 5-grams, Jaccard 0.8) one document stays: the smallest id, then text hash.

    A document is an id with a text, so another text under the same id is judged by itself.  Of rows that repeat both,
    the one with the smallest other columns stays; texts without words are no copies of each other.  A null id comes
    after all others.
    """
    configure(spark)
    found = staged(linked(docs.select("doc_id", "text"), words=5, percent=80).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.col("th").alias("k2"), "component"), "linked")
    last = F.when(F.col("k1") == NO_ID, F.lit(2 ** 63 - 1)).otherwise(F.col("k1"))
    keepers = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(last.alias("o"), "k2", "k1")).alias("keep"))
    documents = found.groupBy("k1", "k2").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("times"))
    judged = documents.join(keepers, "component", "left").select(
        "k1", "k2", (F.col("times") > 1).alias("again"), F.coalesce((F.col("keep.k1") == F.col("k1")) & (F.col("keep.k2") == F.col("k2")), F.lit(True)).alias("stays"))
    odd = staged(judged.where("again OR NOT stays"), "copies")
    release(found)
    # Texts are only moved for rows that repeat an id and a text and stay.
    rows = docs.select(*_key(), *_numbered_columns(docs))
    single = rows.join(odd.select("k1", "k2"), ["k1", "k2"], "left_anti")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    repeated = (rows.join(odd.where("again AND stays").select("k1", "k2"), ["k1", "k2"])
                .groupBy("k1", "k2").agg(F.min(F.struct(*columns)).alias("row")).select("k1", "k2", "row.*"))
    return single.unionByName(repeated).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    configure(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents with their sequence and offset."""
    configure(spark)
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_passages), ("ngram_join", keep_one_of_each_group),
          ("decontamination", drop_leaks), ("packing", pack)]

# The toxicity model and the tokeniser have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        read, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            release(read)
    return docs
