"""op11: product codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress

NAME = "op11_vector_codes"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and error of the label for every embedding that is kept, with the digest of the codebooks."""
    return compress(table(spark, sf_dir, "embeddings"))


def rows_sql(source: str) -> str:
    """The plain form: every part against every entry, in every round."""
    distance = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = [f"""near{k} AS (
  SELECT r, p, x, min({{'d': {distance}, 'e': e}}) AS m FROM part JOIN book{k} USING (p) GROUP BY r, p, x
)""" for k in range(ROUNDS + 1)]
    moved = [f"""sum{k + 1} AS (
  SELECT p, m.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS c FROM near{k}, (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY p, m.e, i
), book{k + 1} AS (
  SELECT p, e, coalesce(s.y, b.y) AS y FROM book{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS y FROM sum{k + 1} GROUP BY p, e) s USING (p, e)
)""" for k in range(ROUNDS)]
    steps = ",\n".join(x for k in range(ROUNDS) for x in (near[k], moved[k])) + ",\n" + near[ROUNDS]
    return f"""
WITH vec AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM {source}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), width AS (
  SELECT (max(len(v)) // {PARTS})::BIGINT AS w FROM vec
), part AS (
  SELECT r, p, v[p * w + 1:(p + 1) * w] AS x FROM vec, width, (SELECT unnest(range({PARTS})) AS p)
), first AS (
  SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM vec QUALIFY e < {ENTRIES}
), book0 AS (
  SELECT p, e, x AS y FROM part JOIN first USING (r)
), {steps}, coded AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(y_i::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(y) AS y_i, generate_subscripts(y, 1) AS i FROM book{ROUNDS})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM vec JOIN coded USING (r), digest
"""


SQL = rows_sql("embeddings")
