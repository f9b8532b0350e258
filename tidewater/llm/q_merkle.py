"""op12: Merkle manifest of all documents."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .merkle import FAN, manifest

NAME = "op12_merkle"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and tamper check of every document."""
    return manifest(table(spark, sf_dir, "documents"))


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in fields) + ")"


# Unsigned CRC-32 of the decimal doc_id: a byte is xored in, then eight shift steps (-1).
CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""


def rows_sql(source: str) -> str:
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g, {_leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {CRC} % 3 = 0 THEN {_leaf(lowered)} ELSE {_leaf('text')} END AS seen FROM {source}
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf
), node AS (
  SELECT g, 0 AS level, i, n, leaf AS d FROM placed
  UNION ALL
  SELECT g, level + 1, i // {FAN}, any_value((n + {FAN - 1}) // {FAN}), sha256(string_agg(d, '' ORDER BY i)) FROM node WHERE n > 1
  GROUP BY g, level, i // {FAN}
), subroot AS (
  SELECT g, level, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
), upper AS (
  SELECT 0 AS level, i, n, d FROM subroot
  UNION ALL
  SELECT level + 1, i // {FAN}, any_value((n + {FAN - 1}) // {FAN}), sha256(string_agg(d, '' ORDER BY i)) FROM upper WHERE n > 1
  GROUP BY level, i // {FAN}
), every AS (
  SELECT g, level, i, d FROM node WHERE n > 1
  UNION ALL
  SELECT s.g, s.level + u.level, u.i, u.d FROM subroot s, upper u WHERE u.n > 1
), start AS (
  SELECT row_number() OVER () AS r, p.*, s.level AS top, s.i AS upper_i FROM placed p JOIN subroot s USING (g)
), walk AS (
  SELECT r, g, top, upper_i, 0 AS level, CASE WHEN top = 0 THEN upper_i ELSE i END AS i, seen AS d, '' AS siblings FROM start
  UNION ALL
  SELECT w.r, w.g, w.top, w.upper_i, w.level + 1, CASE WHEN w.level + 1 = w.top THEN w.upper_i ELSE w.i // {FAN} END,
         sha256(string_agg(CASE WHEN e.i = w.i THEN w.d ELSE e.d END, '' ORDER BY e.i)),
         w.siblings || coalesce(string_agg(CASE WHEN e.i <> w.i THEN e.d END, '' ORDER BY e.i), '')
  FROM walk w JOIN every e ON e.g = w.g AND e.level = w.level AND e.i // {FAN} = w.i // {FAN}
  GROUP BY w.r, w.g, w.top, w.upper_i, w.level, w.i, w.d, w.siblings
), folded AS (
  SELECT r, arg_max(d, level) AS folded_root, sha256(arg_max(siblings, level)) AS proof_sha256 FROM walk GROUP BY r
)
SELECT s.doc_id, s.leaf, b.d AS subroot, u.d AS root, f.proof_sha256, f.folded_root, f.folded_root = u.d AS verified
FROM start s JOIN subroot b USING (g) JOIN folded f USING (r) CROSS JOIN (SELECT d FROM upper WHERE n = 1) u
"""


SQL = rows_sql("documents")
