"""AIS ship-type code -> live traffic group, and display labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C


def normalize_ship_type(code) -> Column:
    """Parse to int; outside 0..99 or unparsable -> null."""
    c = code if isinstance(code, Column) else F.col(code)
    as_int = F.trim(c.cast("string")).try_cast("int")
    return F.when(as_int.between(0, 99), as_int)


def ship_group(code) -> Column:
    v = normalize_ship_type(code)
    return (F.when(v.isin(*C.FISHING_CODES), F.lit("fishing"))
             .when(v.isin(*C.TUG_CODES), F.lit("tug"))
             .when(v.between(*C.PASSENGER_RANGE), F.lit("passenger"))
             .when(v.between(*C.CARGO_RANGE), F.lit("cargo"))
             .when(v.between(*C.TANKER_RANGE), F.lit("tanker"))
             .when(v.isin(*C.AUXILIARY_CODES), F.lit("auxiliary")))


def ship_type_label(code) -> Column:
    """Display label: group name with a capital, else ``AIS <n>``; not a number -> Unknown."""
    c = code if isinstance(code, Column) else F.col(code)
    n = F.trim(c.cast("string")).try_cast("int")
    group = ship_group(c)
    return (F.when(n.isNull(), F.lit("Unknown"))
             .when(group.isNotNull(), F.initcap(group))
             .otherwise(F.concat(F.lit("AIS "), n.cast("string"))))


def mapping_table(spark: SparkSession) -> DataFrame:
    """The mapping as a small constant table (group, rule)."""
    rows = [(g, C.SHIP_GROUP_RULES[g]) for g in C.SHIP_GROUPS]
    return spark.createDataFrame(rows, "ship_group string, ais_codes string")
