"""Classification / regression metrics as aggregates.

Everything starts from the confusion counts ``groupBy(actual, predicted).count()``
— a partial aggregate over the scored rows whose output is at most
classes^2 rows per group — and the per-label arithmetic runs on that tiny table.
Macro averages cover the labels present in actual or predicted (as the
reference computes them); the fixed 3x3 report always lists all classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

LABELS = [0, 1, 2]


def confusion_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("n"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_label(conf: DataFrame, by: list[str] | None = None, labels: list[int] | None = None) -> DataFrame:
    """Per label: support, predicted count, true positives, precision, recall, F1.

    Without ``labels`` only labels present in actual or predicted appear.
    """
    by = by or []
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("pred"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("pred"), F.lit(0).cast("bigint").alias("tp")))
    long = conf.select(*by, F.inline(sides))
    g = long.groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("pred").alias("predicted"),
                                       F.sum("tp").alias("tp"))
    if labels is not None:
        spark = conf.sparkSession
        grid = spark.createDataFrame([(x,) for x in labels], "label int")
        if by:
            grid = (conf.select(*by).distinct()
                    .select(*by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")))
        g = grid.join(g, [*by, "label"], "left").na.fill(0, ["support", "predicted", "tp"])
    p = _safe_div(F.col("tp").cast("double"), F.col("predicted"))
    r = _safe_div(F.col("tp").cast("double"), F.col("support"))
    return g.select(*by, "label", F.col("support").cast("bigint").alias("support"),
                    F.col("predicted").cast("bigint").alias("predicted"), F.col("tp").cast("bigint").alias("tp"),
                    p.alias("precision"), r.alias("recall"),
                    _safe_div(2 * p * r, p + r).alias("f1"))


def class_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                  by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """M6: accuracy, macro precision / recall / F1, weighted F1 (zero division -> 0)."""
    by = by or []
    pl = per_label(confusion_counts(df, actual, predicted, by), by)
    out = pl.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("rows"))
    return out.select(*by, "rows", *[F.round(c, digits).alias(c) for c in
                                     ["accuracy", "macro_precision", "macro_recall", "macro_f1",
                                      "weighted_f1"]])


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     labels: list[int] | None = None) -> DataFrame:
    """M7: fixed 3x3 grid of counts, zero-filled."""
    labels = labels or LABELS
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual int, predicted int")
    conf = confusion_counts(df, actual, predicted)
    return (F.broadcast(grid).join(conf, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                          digits: int = 9) -> DataFrame:
    """M7: per-class precision, recall, F1 and support for all classes."""
    pl = per_label(confusion_counts(df, actual, predicted), labels=LABELS)
    return pl.select(F.col("label").cast("int").alias("label"),
                     F.element_at(F.array(*[F.lit(x) for x in C.CLASS_NAMES]),
                                  F.col("label").cast("int") + 1).alias("class_name"),
                     F.round("precision", digits).alias("precision"), F.round("recall", digits).alias("recall"),
                     F.round("f1", digits).alias("f1"), "support")


def per_area_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     digits: int = 9) -> DataFrame:
    """M8: M6 per study area, plus the unweighted mean of area macro F1."""
    m = class_metrics(df, actual, predicted, ["study_area"], digits)
    mean_f1 = m.select(F.avg("macro_f1")).scalar()
    return m.withColumn("mean_area_macro_f1", F.round(mean_f1, digits))


def regression_metrics(df: DataFrame, actual: str = "actual_value", predicted: str = "predicted_value",
                       by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """M9: MAE, RMSE, R2 = 1 - SSE / SST, overall or per group (one pass +
    the mean for SST, taken as a grouped aggregate joined back)."""
    by = by or []
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    if by:
        # one row per group; the planner broadcasts it when (and only when) it is small
        means = df.groupBy(*by).agg(F.avg(y).alias("__mean"))
        j = df.join(means, by)
    else:
        j = df.withColumn("__mean", df.select(F.avg(y)).scalar())
    out = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (F.lit(1.0) - F.sum((y - p) * (y - p)) / F.sum((y - F.col("__mean")) * (y - F.col("__mean"))))
        .alias("r2"))
    return out.select(*by, "rows", *[F.round(c, digits).alias(c) for c in ["mae", "rmse", "r2"]])


def scaler_stats(df: DataFrame, features: list[str], split_col: str = "dataset_split",
                 digits: int = 9) -> DataFrame:
    """Mean and population std per feature on the train split (long form)."""
    train = df.filter(F.col(split_col) == "train")
    aggs = []
    for c in features:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m__{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s__{c}")]
    wide = train.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                               F.col(f"m__{c}").alias("mean"), F.col(f"s__{c}").alias("std"))
                      for i, c in enumerate(features)])
    long = wide.select(F.inline(pairs))
    # "+ 0.0" folds a rounded -0.0 into 0.0
    return long.select("position", "feature", (F.round("mean", digits) + F.lit(0.0)).alias("mean"),
                       (F.round("std", digits) + F.lit(0.0)).alias("std"))


def stratified_subset(df: DataFrame, strata: list[str], key: Column, limit: int,
                      salt_buckets: int = 16) -> DataFrame:
    """Proportional sample by stratum, at least 1 per stratum, the last
    stratum (smallest) takes the rest, capped at ``limit``; rows chosen in
    md5(key) order (exact, reproducible).

    Strata counts are a tiny aggregate; the quota is joined back (strata are
    few: areas x classes).  Per-stratum top-quota runs in two steps — top-quota
    inside (stratum, salt) buckets, then across buckets — so a stratum holding
    a third of all rows is sorted in parallel, and step two sees at most
    ``salt_buckets * quota`` rows per stratum.
    """
    h = F.md5(key.cast("string"))
    d = df.withColumn("__h", h).withColumn("__stratum", F.concat_ws("_", *[F.col(s).cast("string") for s in strata]))
    total = d.select(F.count(F.lit(1))).scalar()
    counts = d.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("__size"), "__stratum")
    req = F.least(F.greatest(F.bround(F.col("__size") / total * limit).cast("bigint"), F.lit(1)),
                  F.col("__size"))
    q = counts.withColumn("__req", req).withColumn("__pos", F.row_number().over(order)) \
              .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    before = F.coalesce(F.sum("__req").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    q = q.withColumn("__before", before)
    last_req = F.least(F.greatest(F.lit(limit) - F.col("__before"), F.lit(1)), F.col("__size"))
    q = q.withColumn("__quota", F.when(F.col("__pos") == F.col("__n"), last_req).otherwise(F.col("__req")))
    quotas = q.select("__stratum", "__quota")
    d = d.join(F.broadcast(quotas), "__stratum")
    salt = F.pmod(F.xxhash64("__h"), F.lit(salt_buckets))
    w1 = Window.partitionBy("__stratum", salt).orderBy("__h")
    d = d.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= F.col("__quota"))
    w2 = Window.partitionBy("__stratum").orderBy("__h")
    d = d.withColumn("__r2", F.row_number().over(w2)).filter(F.col("__r2") <= F.col("__quota"))
    cap = Window.partitionBy(F.lit(0)).orderBy("__h")
    d = d.withColumn("__r3", F.row_number().over(cap)).filter(F.col("__r3") <= limit)
    return d.drop("__h", "__stratum", "__quota", "__r1", "__r2", "__r3")
