"""op3: repeated line chunks of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .line_dedup import MIN_CHARS, SOLO_CHARS, dedup_lines

NAME = "op3_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts, what was removed, and length and hash of the remaining text, for every document."""
    kept = F.coalesce("text", F.lit(""))
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chunks", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def rows_sql(source: str) -> str:
    """CTEs ``chunks`` (r, doc_id, place, chunk, gone) over rows (doc_id, text) of ``source``; r numbers the rows."""
    return f"""
src AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {source}
), lines AS (
  SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM src
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, length(line) >= {SOLO_CHARS} AS solo FROM lines
), rolled AS (
  SELECT *, coalesce((((31 * lag(h) OVER w + h) >> 3) % 2) = 0, false) AS cut, coalesce(lead(solo) OVER w, true) AS solo_next
  FROM hashed WINDOW w AS (PARTITION BY r ORDER BY i)
), ends AS (
  SELECT *, solo OR solo_next OR (cut AND NOT coalesce(lag(cut) OVER (PARTITION BY r ORDER BY i), false)
                      AND i <> count(*) OVER (PARTITION BY r) - 1) AS e FROM rolled
), numbered AS (
  SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM ends
), pieces AS (
  SELECT r, doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY r, doc_id, place
), chunks AS (
  SELECT *, ((contains(trim(chunk, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AND length(chunk) >= {MIN_CHARS})
             OR length(chunk) >= {SOLO_CHARS})
            AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone
  FROM pieces
)"""


SQL = f"""
WITH {rows_sql('documents')}, kept AS (
  SELECT r, doc_id, count(*)::BIGINT AS n_chunks, sum(gone::INT)::BIGINT AS n_removed,
         coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM chunks GROUP BY r, doc_id
)
SELECT doc_id, n_chunks, n_removed, length(text)::BIGINT AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""
