"""Exact quantiles (linear interpolation, as pandas / ``quantile_cont``) with bounded work per group.

``percentile`` keeps a value -> count map per group, so a group of continuous
values (e.g. voyage durations of one area) would sit whole in one task.  Here,
for groups of every size alike:

1. ``percentile_approx`` (rank error <= n / accuracy) brackets each target rank
   between two values ``lo`` / ``hi``; the bracket is as narrow as the group's
   size allows (``LEVELS``), so it holds a small share of a large group;
2. one aggregate counts the rows below ``lo``, another the rows of each value
   inside [lo, hi], so a value that very many rows share is one row;
3. running counts over these values give the two neighbours of the exact
   position, which are interpolated.

The result equals ``percentile`` exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 1_000_000
LEVELS = [1e-4, 1e-2, 1.0]      # half-widths of a bracket, as shares of the group, beside 3 / accuracy


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, qs: list[float],
                    names: list[str] | None = None, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One row per group with one column per quantile (groups without values are absent)."""
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    if not group_cols:
        keyed = exact_quantiles(df.withColumn("__g", F.lit(0)), ["__g"], value_col, qs, names, accuracy)
        return keyed.drop("__g")
    g = list(group_cols)
    v = F.col(value_col).cast("double")
    base = df.select(*g, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    levels = sorted({min(1.0, 3.0 / accuracy), *LEVELS})
    probes = [p for q in qs for e in levels for p in (max(0.0, q - e), min(1.0, q + e))]
    approx = base.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"),
                                  F.percentile_approx("__v", probes, accuracy).alias("__b"))
    # The narrowest bracket that still holds ranks k and k + 1 on both sides of the approximation's error.
    level = F.lit(len(levels) - 1)
    for i in reversed(range(len(levels) - 1)):
        level = F.when(F.col("__n") * levels[i] >= 2.5 + 1.5 * F.col("__n") / accuracy, i).otherwise(level)
    at = lambda i, side: F.get("__b", F.lit(2 * len(levels) * i + side) + 2 * level)      # noqa: E731
    sized = approx.select(*g, "__n", F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), at(i, 0).alias("lo"), at(i, 1).alias("hi"))
        for i, q in enumerate(qs)]).alias("__q"))                        # one row per group
    rows = base.join(sized, g)
    below = rows.groupBy(*g).agg(F.array(*[
        F.count(F.when(F.col("__v") < F.col("__q")[i]["lo"], 1)) for i in range(len(qs))]).alias("__below"))
    hit = F.filter("__q", lambda x: (F.col("__v") >= x["lo"]) & (F.col("__v") <= x["hi"]))
    values = (rows.select(*g, "__n", "__v", F.explode(hit).alias("__x"))
              .groupBy(*g, "__n", F.col("__x.i").alias("__i"), F.col("__x.q").alias("__t"), "__v").agg(F.count(F.lit(1)).alias("__c")))
    w = Window.partitionBy(*g, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("__t") * (F.col("__n") - 1)
    # A value covers ranks __to - __c up to __to - 1.
    ranked = (values.join(below, g).withColumn("__to", F.sum("__c").over(w) + F.get("__below", F.col("__i")))
              .withColumn("__pos", pos).withColumn("__k", F.floor("__pos")))
    covers = lambda k: (k >= F.col("__to") - F.col("__c")) & (k < F.col("__to"))      # noqa: E731
    val = ranked.groupBy(*g, "__i").agg(
        F.max(F.when(covers(F.col("__k")), F.col("__v"))).alias("__a"),
        F.max(F.when(covers(F.col("__k") + 1), F.col("__v"))).alias("__d"),
        F.first(F.col("__pos") - F.col("__k")).alias("__f"))
    # same arithmetic as ``percentile``: (k + 1 - pos) * v[k] + (pos - k) * v[k + 1]
    interp = (F.when(F.col("__d").isNull() | (F.col("__f") == 0), F.col("__a"))
              .otherwise((F.lit(1.0) - F.col("__f")) * F.col("__a") + F.col("__f") * F.col("__d")))
    return (val.select(*g, "__i", interp.alias("__r")).groupBy(*g)
            .agg(*[F.max(F.when(F.col("__i") == i, F.col("__r"))).alias(n) for i, n in enumerate(names)]))
