"""Profiles of voyages, hourly panels and labelled tables.

Every profile is one (or a few) grouped aggregates; counts per value use
``groupBy().count()`` with partial aggregation, distinct counts use
``countDistinct`` (exact), quantiles are exact: ``percentile`` on panel-sized
groups, ``exact_quantiles`` (bounded memory) on data-sized groups.  Several
value columns are profiled in one pass by unpivoting to (column, value)
rows first, so the input is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import clean as CL
from .quantiles import exact_quantiles


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def profile_identifier(col) -> Column:
    """Identifier as the profile scripts read it: trim, drop a trailing ``.0``."""
    t = F.regexp_replace(CL.strip(col), r"\.0$", "")
    return F.when(~t.isin(*C.NULL_TOKENS), t)


def voyage_profile(raw: DataFrame) -> DataFrame:
    """A3: per year rows and distinct ship id / MMSI / IMO."""
    return raw.groupBy("source_year").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(profile_identifier("skips_id")).alias("unique_ships"),
        F.countDistinct(profile_identifier("mmsi_nummer")).alias("unique_mmsi"),
        F.countDistinct(profile_identifier("imo_nummer")).alias("unique_imo"))


def flow_class_counts(raw: DataFrame) -> DataFrame:
    """A4: domestic / inbound / outbound / other by home-country code (SQL
    three-valued logic: a null code on either side can leave a voyage unclassified)."""
    dep = F.trim("landkode_avgang_totegn") == C.HOME_COUNTRY_CODE
    arr = F.trim("landkode_ankomst_totegn") == C.HOME_COUNTRY_CODE
    cnt = lambda cond: F.count(F.when(cond, 1))
    return raw.groupBy("source_year").agg(
        cnt(dep & arr).alias("domestic"), cnt(~dep & arr).alias("international_to_norway"),
        cnt(dep & ~arr).alias("norway_to_international"), cnt(~dep & ~arr).alias("international_other"))


PROFILE_VALUE_COLUMNS = ["avgangshavn_kode", "ankomsthavn_kode", "avgangshavn_navn",
                         "ankomsthavn_navn", "skipstype", "skipsgruppe", "land_avgang",
                         "land_ankomst"]


def top_values(raw: DataFrame, columns=None, n: int = 20, by_year: bool = True) -> DataFrame:
    """A5: value counts of several columns in one pass; top ``n`` per (year, column).

    Ties are broken by the value so the top list is deterministic.
    """
    columns = columns or PROFILE_VALUE_COLUMNS
    keys = ["source_year"] if by_year else []
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    long = raw.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys, "column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def monthly_counts(clean: DataFrame) -> DataFrame:
    """Departures and arrivals per ``yyyy-MM`` (unparsable times skipped)."""
    sides = F.array(
        F.struct(F.lit("departures").alias("side"), F.col("departure_time").alias("t")),
        F.struct(F.lit("arrivals").alias("side"), F.col("arrival_time").alias("t")))
    long = clean.select(F.inline(sides)).filter(F.col("t").isNotNull())
    m = long.select(F.date_format(F.col("t").cast("timestamp"), "yyyy-MM").alias("month"), "side")
    return (m.groupBy("month").agg(F.count(F.when(F.col("side") == "departures", 1)).alias("departures"),
                                   F.count(F.when(F.col("side") == "arrivals", 1)).alias("arrivals")))


def _norwegian_sides(raw: DataFrame, level: str = "municipality") -> DataFrame:
    """Unpivot each voyage into its Norwegian ends: (year, side, place, mmsi, time)."""
    place = {"municipality": ("kommunenavn_avgang", "kommunenavn_ankomst"),
             "county": ("fylkesnavn_avgang", "fylkesnavn_ankomst")}[level]
    mmsi = F.regexp_replace(F.col("mmsi_nummer"), r"\.0$", "")
    sides = F.array(
        F.when(F.trim("landkode_avgang_totegn") == C.HOME_COUNTRY_CODE,
               F.struct(F.lit("departure").alias("side"), F.trim(place[0]).alias("place"),
                        mmsi.alias("mmsi"), F.col("etd_estimert_avgangstidspunkt").alias("time_text"))),
        F.when(F.trim("landkode_ankomst_totegn") == C.HOME_COUNTRY_CODE,
               F.struct(F.lit("arrival").alias("side"), F.trim(place[1]).alias("place"),
                        mmsi.alias("mmsi"), F.col("ankomsttidspunkt").alias("time_text"))))
    return (raw.select("source_year", F.explode(sides).alias("__s")).filter(F.col("__s").isNotNull())
               .select("source_year", "__s.*").filter(F.col("place").isNotNull()))


def municipality_activity(raw: DataFrame, level: str = "municipality", by_year: bool = True) -> DataFrame:
    """Norwegian departures, arrivals, activity and distinct MMSI per place."""
    keys = ["source_year"] if by_year else []
    s = _norwegian_sides(raw, level)
    return s.groupBy(*keys, F.col("place").alias(level)).agg(
        F.count(F.when(F.col("side") == "departure", 1)).alias("departures"),
        F.count(F.when(F.col("side") == "arrival", 1)).alias("arrivals"),
        F.count(F.lit(1)).alias("activity"),
        F.countDistinct("mmsi").alias("unique_mmsi"))


def municipality_monthly(raw: DataFrame) -> DataFrame:
    """A6 per municipality: Norwegian activity by month (unparsable times skipped)."""
    s = _norwegian_sides(raw).withColumn("t", F.try_to_timestamp(F.trim("time_text")))
    return (s.filter(F.col("t").isNotNull())
             .groupBy(F.col("place").alias("municipality"),
                      F.date_format("t", "yyyy-MM").alias("month"))
             .agg(F.count(F.lit(1)).alias("activity")))


def municipality_ranking(raw: DataFrame, per_year: int = 30, overall: int = 40) -> DataFrame:
    """Top places per year and over all years, by activity (ties by name)."""
    yearly = municipality_activity(raw)
    wy = Window.partitionBy("source_year").orderBy(F.desc("activity"), "municipality")
    top_year = (yearly.withColumn("rank", F.row_number().over(wy)).filter(F.col("rank") <= per_year)
                      .withColumn("scope", F.lit("year")))
    total = municipality_activity(raw, by_year=False)
    top_all = (total.orderBy(F.desc("activity"), "municipality").limit(overall)
                    .withColumn("rank", F.row_number().over(
                        Window.partitionBy(F.lit(1)).orderBy(F.desc("activity"), "municipality")))
                    .withColumn("source_year", F.lit(None).cast("int"))
                    .withColumn("scope", F.lit("overall")))
    cols = ["scope", "source_year", "rank", "municipality", "activity", "unique_mmsi"]
    return top_year.select(*cols).unionByName(top_all.select(*cols))


def missing_profile(df: DataFrame, columns=None) -> DataFrame:
    """Null count, null % (2 decimals) and distinct count per column.

    Cells become (column, value) rows that are counted by value first (partial aggregation keeps one row per
    value and task), so no row is expanded over all columns' distinct sets at once.
    """
    columns = columns or df.columns
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("__v")) for c in columns])))
    values = cells.groupBy("column", "__v").agg(F.count(F.lit(1)).alias("__c"))
    return values.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__c"))), F.lit(0)).cast("bigint").alias("missing"),
        F.round(F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__c"))), F.lit(0)) * 100.0 / F.sum("__c"), 2).alias("missing_pct"),
        F.count("__v").alias("distinct_values"))


def area_year_counts(voyages: DataFrame) -> DataFrame:
    """Voyage-area rows by area and year, zero where an area of the data has none in a year of the data."""
    counts = voyages.groupBy("study_area", "source_year").agg(F.count(F.lit(1)).alias("rows"))
    # Both lists are bounded by the areas and years; the counts are aggregated once and their exchange is read again.
    grid = (counts.agg(F.collect_set("study_area").alias("a"), F.collect_set("source_year").alias("y"))
            .select(F.explode("a").alias("study_area"), "y").select("study_area", F.explode("y").alias("source_year")))
    return grid.join(counts, ["study_area", "source_year"], "left").select("study_area", "source_year", F.coalesce("rows", F.lit(0)).alias("rows"))


def voyage_summary(voyages: DataFrame) -> DataFrame:
    """Distinct ids, area flags, group counts incl. null, time range, durations."""
    grp = lambda g: F.count(F.when(F.col("skipsgruppe") == g, 1)).alias(f"group_{g.lower()}")
    d = F.col("voyage_duration_hours")
    base = voyages.groupBy("study_area").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("seilas_id").alias("unique_voyages"),
        F.countDistinct("skips_id").alias("unique_ships"),
        F.countDistinct("mmsi_nummer").alias("unique_mmsi"),
        F.countDistinct("imo_nummer").alias("unique_imo"),
        F.count(F.when(F.col("arrival_in_study_area"), 1)).alias("arrivals"),
        F.count(F.when(F.col("departure_in_study_area"), 1)).alias("departures"),
        F.count(F.when(F.col("arrival_in_study_area") & F.col("departure_in_study_area"), 1))
         .alias("internal"),
        *[grp(g) for g in C.SKIPSGRUPPE_COUNTERS],
        F.count(F.when(F.col("skipsgruppe").isNull(), 1)).alias("group_null"),
        F.min("departure_time").alias("first_departure"),
        F.max("arrival_time").alias("last_arrival"),
        F.round(F.avg(d), 6).alias("duration_mean"))
    # durations are continuous and data-sized: exact quantiles with bounded memory
    q = exact_quantiles(voyages, ["study_area"], "voyage_duration_hours", [0.5, 0.95],
                        ["duration_median", "duration_p95"])
    q = q.select("study_area", F.round("duration_median", 6).alias("duration_median"),
                 F.round("duration_p95", 6).alias("duration_p95"))
    return base.join(q, "study_area", "left")


# ---------------------------------------------------------------------------
# Panel and label profiles
# ---------------------------------------------------------------------------

DIST_QUANTILES = [0.10, 0.25, 0.33, 0.50, 0.67, 0.75, 0.90, 0.95, 0.99]


def distribution(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """Count, mean, median, sample std, min, max and 9 exact quantiles."""
    v = F.col(col).cast("double")
    qs = F.percentile(v, DIST_QUANTILES)
    out = df.agg(F.count(v).alias("count"), F.round(F.avg(v), digits).alias("mean"),
                 F.round(F.percentile(v, 0.5), digits).alias("median"),
                 F.round(F.stddev_samp(v), digits).alias("std"),
                 F.min(v).alias("min"), F.max(v).alias("max"), qs.alias("__q"))
    return out.select("count", "mean", "median", "std", "min", "max",
                      *[F.round(F.col("__q")[i], digits).alias(f"q{int(round(q * 100)):02d}")
                        for i, q in enumerate(DIST_QUANTILES)])


def value_histogram(df: DataFrame, col: str, n: int = 30) -> DataFrame:
    """A11 histogram: counts of the ``n`` smallest values."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
              .agg(F.count(F.lit(1)).alias("count")).orderBy("value").limit(n))


def class_crosstab(df: DataFrame, by: list[str], label: str = "traffic_level") -> DataFrame:
    """Class counts (fixed LOW / MEDIUM / HIGH order) with percentages."""
    p = df.groupBy(*by).pivot(label, C.CLASS_NAMES).count().na.fill(0)
    total = sum(F.col(c) for c in C.CLASS_NAMES)
    return p.select(*by, *[F.col(c).cast("bigint").alias(c) for c in C.CLASS_NAMES],
                    total.cast("bigint").alias("total"),
                    *[F.round(F.col(c) * 100.0 / total, 2).alias(f"{c.lower()}_pct")
                      for c in C.CLASS_NAMES])


def area_hour_summary(panel: DataFrame, target: str = C.TARGET_COLUMN) -> DataFrame:
    """Per area rows, zero hours, zero %, mean, max; train-target quantiles."""
    t = F.col("total_events")
    is_train = F.col("dataset_split") == "train"
    y = F.when(is_train, F.col(target).cast("double"))
    return panel.groupBy("study_area").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(t == 0, 1)).alias("zero_hours"),
        F.round(F.count(F.when(t == 0, 1)) * 100.0 / F.count(F.lit(1)), 6).alias("zero_pct"),
        F.round(F.avg(t), 6).alias("mean_events"),
        F.max(t).alias("max_events"),
        F.round(F.percentile(y, 0.33), 6).alias("train_target_q33"),
        F.round(F.percentile(y, 0.67), 6).alias("train_target_q67"),
        F.round(F.percentile(y, 0.90), 6).alias("train_target_q90"),
        F.round(F.avg(y), 6).alias("train_target_mean"),
        F.max(y).alias("train_target_max"))


def class_weights(df: DataFrame, label: str = "traffic_level_numeric") -> DataFrame:
    """Balanced weight per class = total / (classes * count)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "count", F.round(total / (k * F.col("count")), 9).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "traffic_level_numeric") -> DataFrame:
    """Attach A25 weights as a ``weight`` column (classes <= 3 -> broadcast)."""
    w = class_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(w), label, "left")
