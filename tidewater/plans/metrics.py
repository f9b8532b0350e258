"""Registered queries: metrics of deterministic rule predictors over the model table.

The rule predictors stand in for trained models so every metric is checkable
against SQL: "lag_1h" labels the next hour with the class of the last hour,
"rolling_3h" / "rolling_24h" turn a rolling mean into a class with the
half-event rule, "majority" predicts the most frequent train class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators import features as FT
from ..operators import metrics as MT
from . import sqlparts as Q
from .model import LABELLED_SQL, complete_rows, model_rows
from .registry import register

RULES = ["lag_1h", "lag_24h", "rolling_3h", "rolling_24h", "majority"]
EVAL_SPLIT = "test"


def _level_num(v, high):
    return F.when(v.isNull(), None).when(v == 0, 0).when(v >= high, 2).otherwise(1)


def predictions(spark, sf, rule: str = "lag_1h") -> DataFrame:
    """Scored rows: actual class (next hour) and the rule's predicted class."""
    rows = model_rows(spark, sf)
    thr = FT.area_thresholds(complete_rows(spark, sf))
    j = rows.join(F.broadcast(thr.select("study_area", "high_threshold")), "study_area")
    hi = F.col("high_threshold")
    if rule == "lag_1h":
        pred, val = _level_num(F.col("total_events_lag_1h"), hi), F.col("total_events_lag_1h").cast("double")
    elif rule == "lag_24h":
        pred, val = _level_num(F.col("total_events_lag_24h"), hi), F.col("total_events_lag_24h").cast("double")
    elif rule in ("rolling_3h", "rolling_24h"):
        val = F.col(f"total_events_rolling_mean_{rule.split('_')[1]}")
        pred = FT.regression_to_class(val, hi)
    elif rule == "majority":
        train = rows.filter(F.col("dataset_split") == "train")
        mode = (train.groupBy("traffic_level_numeric").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), "traffic_level_numeric").limit(1)
                .select("traffic_level_numeric").scalar())
        pred, val = mode, F.lit(None).cast("double")
    else:
        raise ValueError(rule)
    return j.select("study_area", "timestamp_utc", "dataset_split",
                    F.col("traffic_level_numeric").alias("actual"), pred.cast("int").alias("predicted"),
                    F.col(C.TARGET_COLUMN).cast("double").alias("actual_value"),
                    val.alias("predicted_value"))


def _sql_pred(rule: str) -> str:
    def lvl(v):
        return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} = 0 THEN 0 WHEN {v} >= high_threshold THEN 2 ELSE 1 END"

    def reg(v):
        p = f"greatest(0.0::DOUBLE, {v})"
        return f"CASE WHEN {p} < 0.5 THEN 0 WHEN {p} >= high_threshold - 0.5 THEN 2 ELSE 1 END"

    if rule == "lag_1h":
        pred, val = lvl("total_events_lag_1h"), "CAST(total_events_lag_1h AS DOUBLE)"
    elif rule == "lag_24h":
        pred, val = lvl("total_events_lag_24h"), "CAST(total_events_lag_24h AS DOUBLE)"
    elif rule in ("rolling_3h", "rolling_24h"):
        c = f"total_events_rolling_mean_{rule.split('_')[1]}"
        pred, val = reg(c), c
    else:
        pred = f"""(SELECT traffic_level_numeric FROM ({LABELLED_SQL}) t WHERE dataset_split = 'train'
                   GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)"""
        val = "CAST(NULL AS DOUBLE)"
    return f"""SELECT study_area, timestamp_utc, dataset_split, traffic_level_numeric AS actual,
  CAST({pred} AS INTEGER) AS predicted, CAST({C.TARGET_COLUMN} AS DOUBLE) AS actual_value, {val} AS predicted_value
FROM ({LABELLED_SQL}) l"""


def sql_per_label(pred: str, by: list[str], labels: list[int] | None = None) -> str:
    b = "".join(f"{x}, " for x in by)
    conf = f"SELECT {b}actual, predicted, COUNT(*) AS n FROM ({pred}) p GROUP BY ALL"
    lab = f"""SELECT {b}label, SUM(support) AS support, SUM(pred) AS predicted, SUM(tp) AS tp FROM (
  SELECT {b}actual AS label, n AS support, 0 AS pred, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM ({conf}) c
  UNION ALL SELECT {b}predicted AS label, 0 AS support, n AS pred, 0 AS tp FROM ({conf}) c) u GROUP BY ALL"""
    if labels is not None:
        grid = f"SELECT * FROM (VALUES {', '.join(f'({x})' for x in labels)}) g(label)"
        lab = f"""SELECT g.label, COALESCE(l.support, 0) AS support, COALESCE(l.predicted, 0) AS predicted,
  COALESCE(l.tp, 0) AS tp FROM ({grid}) g LEFT JOIN ({lab}) l ON g.label = l.label"""
    pr = f"""SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM ({lab}) l"""
    return f"SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM ({pr}) x"


def sql_class_metrics(pred: str, by: list[str]) -> str:
    b = "".join(f"{x}, " for x in by)
    g = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {b}CAST(SUM(support) AS BIGINT) AS rows, round(SUM(tp) / SUM(support), 9) AS accuracy,
  round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
  round(SUM(f1 * support) / SUM(support), 9) AS weighted_f1
FROM ({sql_per_label(pred, by)}) pl {g}"""


def _test(pred: str) -> str:
    return f"SELECT * FROM ({pred}) x WHERE dataset_split = '{EVAL_SPLIT}'"


def test_predictions(spark, sf, rule="lag_1h"):
    return predictions(spark, sf, rule).filter(F.col("dataset_split") == EVAL_SPLIT)


@register("class_metrics", f"SELECT * FROM ({sql_class_metrics(_test(_sql_pred('lag_1h')), [])}) m")
def class_metrics(spark, sf):
    """M6: accuracy, macro P / R / F1, weighted F1 on the test split (rule lag_1h)."""
    return MT.class_metrics(test_predictions(spark, sf))


_REPORT_SQL = sql_per_label(_test(_sql_pred("lag_1h")), [], [0, 1, 2])


@register("confusion_and_report", f"""
SELECT g.actual, g.predicted, COALESCE(c.n, 0) AS n, CAST(r.label AS INTEGER) AS label,
  round(r.p, 9) AS precision, round(r.r, 9) AS recall, round(r.f1, 9) AS f1, CAST(r.support AS BIGINT) AS support
FROM (SELECT a.x AS actual, b.x AS predicted FROM (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) b(x)) g
LEFT JOIN (SELECT actual, predicted, COUNT(*) AS n FROM ({_test(_sql_pred('lag_1h'))}) t GROUP BY ALL) c
  ON g.actual = c.actual AND g.predicted = c.predicted
JOIN ({_REPORT_SQL}) r ON r.label = g.actual""")
def confusion_and_report(spark, sf):
    """M7: fixed 3x3 confusion grid with the per-class report of the actual class."""
    p = test_predictions(spark, sf)
    grid = MT.confusion_matrix(p)
    rep = MT.classification_report(p).drop("class_name")
    return grid.join(F.broadcast(rep), grid.actual == rep.label).select(
        "actual", "predicted", "n", "label", "precision", "recall", "f1", "support")


@register("per_area_metrics", f"""
SELECT *, round(avg(macro_f1) OVER (), 9) AS mean_area_macro_f1
FROM ({sql_class_metrics(_test(_sql_pred('lag_1h')), ['study_area'])}) m""")
def per_area_metrics(spark, sf):
    """M8: M6 per area and the unweighted mean of area macro F1."""
    return MT.per_area_metrics(test_predictions(spark, sf))


def _sql_reg(pred: str, by: list[str]) -> str:
    b = "".join(f"{x}, " for x in by)
    g = f"GROUP BY {', '.join(by)}" if by else ""
    on = " AND ".join(f"p.{x} = m.{x}" for x in by) if by else "true"
    means = f"SELECT {b}avg(actual_value) AS mu FROM ({pred}) q {g}"
    bp = "".join(f"p.{x}, " for x in by)
    gp = f"GROUP BY {', '.join('p.' + x for x in by)}" if by else ""
    return f"""SELECT {bp}COUNT(*) AS rows, round(avg(abs(actual_value - predicted_value)), 9) AS mae,
  round(sqrt(avg((actual_value - predicted_value) * (actual_value - predicted_value))), 9) AS rmse,
  round(1.0 - SUM((actual_value - predicted_value) * (actual_value - predicted_value))
        / SUM((actual_value - mu) * (actual_value - mu)), 9) AS r2
FROM ({pred}) p JOIN ({means}) m ON {on} {gp}"""


@register("regression_metrics", f"""
SELECT 'ALL' AS study_area, * FROM ({_sql_reg(_test(_sql_pred('rolling_3h')), [])}) a
UNION ALL SELECT * FROM ({_sql_reg(_test(_sql_pred('rolling_3h')), ['study_area'])}) b""")
def regression_metrics(spark, sf):
    """M9: MAE, RMSE, R2 of the 3-hour rolling mean as a count forecast, overall and per area."""
    p = test_predictions(spark, sf, "rolling_3h")
    overall = MT.regression_metrics(p).withColumn("study_area", F.lit("ALL"))
    per = MT.regression_metrics(p, by=["study_area"])
    cols = ["study_area", "rows", "mae", "rmse", "r2"]
    return overall.select(*cols).unionByName(per.select(*cols))


def predictions_all_rules(spark, sf) -> DataFrame:
    """Every rule's predictions in one frame with a ``rule`` column: the model
    table is computed once and fanned out by ``explode`` (no join)."""
    rows = model_rows(spark, sf).filter(F.col("dataset_split") == EVAL_SPLIT)
    thr = FT.area_thresholds(complete_rows(spark, sf))
    j = rows.join(F.broadcast(thr.select("study_area", "high_threshold")), "study_area")
    hi = F.col("high_threshold")
    train = model_rows(spark, sf).filter(F.col("dataset_split") == "train")
    mode = (train.groupBy("traffic_level_numeric").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "traffic_level_numeric").limit(1).select("traffic_level_numeric").scalar())
    preds = {
        "lag_1h": _level_num(F.col("total_events_lag_1h"), hi),
        "lag_24h": _level_num(F.col("total_events_lag_24h"), hi),
        "rolling_3h": FT.regression_to_class(F.col("total_events_rolling_mean_3h"), hi),
        "rolling_24h": FT.regression_to_class(F.col("total_events_rolling_mean_24h"), hi),
        "majority": mode,
    }
    fan = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), preds[r].cast("int").alias("predicted"))
                              for r in RULES]))
    return j.select("study_area", F.col("traffic_level_numeric").alias("actual"), fan.alias("__p")) \
            .select("study_area", "actual", "__p.rule", "__p.predicted")


def _sql_pred_all() -> str:
    cases = " ".join(f"WHEN '{r}' THEN p_{r}" for r in RULES)
    parts = ", ".join(f"CAST(({_sql_pred_expr(r)}) AS INTEGER) AS p_{r}" for r in RULES)
    return f"""SELECT study_area, actual, rule, CASE rule {cases} END AS predicted FROM (
  SELECT study_area, traffic_level_numeric AS actual, {parts} FROM ({LABELLED_SQL}) l
  WHERE dataset_split = '{EVAL_SPLIT}') x, (VALUES {', '.join(f"('{r}')" for r in RULES)}) r(rule)"""


def _sql_pred_expr(rule: str) -> str:
    sql = _sql_pred(rule)
    return sql.split("CAST(", 1)[1].rsplit(" AS INTEGER) AS predicted", 1)[0]


PRED_ALL_SQL = _sql_pred_all()
SUMMARY_SQL = f"""
SELECT o.rule AS experiment, o.accuracy, o.macro_f1, o.weighted_f1, o.macro_precision, o.macro_recall,
       a.mean_area_macro_f1
FROM ({sql_class_metrics(PRED_ALL_SQL, ['rule'])}) o
JOIN (SELECT rule, round(avg(macro_f1), 9) AS mean_area_macro_f1
      FROM ({sql_class_metrics(PRED_ALL_SQL, ['rule', 'study_area'])}) x GROUP BY rule) a ON o.rule = a.rule"""


def experiment_rows(spark, sf) -> DataFrame:
    p = predictions_all_rules(spark, sf)
    o = MT.class_metrics(p, by=["rule"])
    per = MT.class_metrics(p, by=["rule", "study_area"])
    mean_area = per.groupBy("rule").agg(F.round(F.avg("macro_f1"), 9).alias("mean_area_macro_f1"))
    return o.join(mean_area, "rule").select(F.col("rule").alias("experiment"), "accuracy", "macro_f1",
                                            "weighted_f1", "macro_precision", "macro_recall",
                                            "mean_area_macro_f1")


@register("model_ranking", f"""
SELECT CAST(row_number() OVER (ORDER BY macro_f1 DESC, mean_area_macro_f1 DESC, experiment) AS INTEGER) AS rank,
  experiment, macro_f1, mean_area_macro_f1 FROM ({SUMMARY_SQL}) s""")
def model_ranking(spark, sf):
    """K8: experiments by macro F1, then mean area F1; rank 1 is the chosen model."""
    s = experiment_rows(spark, sf)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("macro_f1"), F.desc("mean_area_macro_f1"), "experiment")
    return s.select(F.row_number().over(w).alias("rank"), "experiment", "macro_f1", "mean_area_macro_f1")


def _area_cols():
    return [(a, "f1_" + a.lower().replace("å", "a").replace("ø", "o").replace("æ", "ae").replace(" ", "_"))
            for a in sorted(C.STUDY_AREAS)]


_PIVOT_SQL = ", ".join(f"max(CASE WHEN study_area = {Q.lit(a)} THEN macro_f1 END) AS {slug}"
                       for a, slug in _area_cols())


@register("experiment_summary", f"""
SELECT o.rule AS experiment, o.accuracy, o.macro_f1, o.weighted_f1, o.macro_precision, o.macro_recall, {
    ', '.join(f'a.{slug}' for _, slug in _area_cols())}
FROM ({sql_class_metrics(PRED_ALL_SQL, ['rule'])}) o
JOIN (SELECT rule, {_PIVOT_SQL} FROM ({sql_class_metrics(PRED_ALL_SQL, ['rule', 'study_area'])}) x GROUP BY rule) a
  ON o.rule = a.rule""")
def experiment_summary(spark, sf):
    """One row per experiment (5 metrics) with the per-area macro F1 pivot."""
    p = predictions_all_rules(spark, sf)
    o = MT.class_metrics(p, by=["rule"])
    per = MT.class_metrics(p, by=["rule", "study_area"])
    piv = per.groupBy("rule").pivot("study_area", sorted(C.STUDY_AREAS)).agg(F.first("macro_f1"))
    piv = piv.select("rule", *[F.col(f"`{a}`").alias(slug) for a, slug in _area_cols()])
    return o.join(piv, "rule").select(F.col("rule").alias("experiment"), "accuracy", "macro_f1", "weighted_f1",
                                      "macro_precision", "macro_recall", *[s for _, s in _area_cols()])


@register("compare_models", f"""
SELECT g.study_area, g.macro_f1 AS global_macro_f1, l.macro_f1 AS local_macro_f1,
  round(l.macro_f1 - g.macro_f1, 9) AS difference
FROM ({sql_class_metrics(_test(_sql_pred('lag_1h')), ['study_area'])}) g
LEFT JOIN ({sql_class_metrics(_test(_sql_pred('rolling_3h')), ['study_area'])}) l ON g.study_area = l.study_area""")
def compare_models(spark, sf):
    """Global model vs per-area model, macro F1 per area and the difference."""
    g = MT.class_metrics(test_predictions(spark, sf, "lag_1h"), by=["study_area"])
    loc = MT.class_metrics(test_predictions(spark, sf, "rolling_3h"), by=["study_area"])
    j = g.select("study_area", F.col("macro_f1").alias("global_macro_f1")).join(
        loc.select("study_area", F.col("macro_f1").alias("local_macro_f1")), "study_area", "left")
    return j.withColumn("difference", F.round(F.col("local_macro_f1") - F.col("global_macro_f1"), 9))


_STRAT_LIMIT = 500


def _sql_strat() -> str:
    rows = f"""SELECT *, md5(study_area || '|' || CAST(CAST(epoch(timestamp_utc) AS BIGINT) AS VARCHAR)) AS h,
  study_area || '_' || CAST(traffic_level_numeric AS VARCHAR) AS stratum
FROM ({LABELLED_SQL}) l WHERE dataset_split = 'train'"""
    counts = f"SELECT stratum, COUNT(*) AS size FROM ({rows}) r GROUP BY stratum"
    total = f"(SELECT COUNT(*) FROM ({rows}) t)"
    q = f"""SELECT *, row_number() OVER (ORDER BY size DESC, stratum) AS pos, COUNT(*) OVER () AS n,
  least(greatest(CAST(round_even(size / {total} * {_STRAT_LIMIT}, 0) AS BIGINT), 1), size) AS req FROM ({counts}) c"""
    q2 = f"""SELECT *, COALESCE(SUM(req) OVER (ORDER BY size DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM ({q}) q"""
    q3 = f"""SELECT stratum, CASE WHEN pos = n THEN least(greatest({_STRAT_LIMIT} - before, 1), size) ELSE req END AS quota
FROM ({q2}) q2"""
    sel = f"""SELECT r.* FROM ({rows}) r JOIN ({q3}) q USING (stratum)
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY h) <= quota"""
    return f"""SELECT study_area, timestamp_utc, traffic_level_numeric FROM ({sel}) s
QUALIFY row_number() OVER (ORDER BY h) <= {_STRAT_LIMIT}"""


@register("stratified_subset", _sql_strat())
def stratified_subset(spark, sf):
    """Proportional (area, class) sample of the train split, capped at 500, md5 order."""
    rows = model_rows(spark, sf).filter(F.col("dataset_split") == "train")
    key = F.concat(F.col("study_area"), F.lit("|"),
                   F.unix_seconds(F.col("timestamp_utc").cast("timestamp")).cast("string"))
    out = MT.stratified_subset(rows, ["study_area", "traffic_level_numeric"], key, _STRAT_LIMIT)
    return out.select("study_area", "timestamp_utc", "traffic_level_numeric")

