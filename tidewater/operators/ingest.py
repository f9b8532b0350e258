"""Decode and validate raw AIS messages.

Each line is decoded with ``from_json`` against an explicit schema; one
``reject_reason`` column records why a record fails, so the good rows and the
dead-letter rows come from one pass and counters are a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

RAW_SCHEMA = T.StructType([
    T.StructField("mmsi", T.StringType()),
    T.StructField("msgtime", T.StringType()),
    # Numbers are read as text: "62.45" and 62.45 are the same latitude, 5.0 is status 5.
    *[T.StructField(c, T.StringType()) for c in ("latitude", "longitude", "name", "speedOverGround", "courseOverGround",
                                                 "trueHeading", "navigationalStatus", "shipType", "rateOfTurn")],
    T.StructField("_corrupt", T.StringType()),
])
DECIMALS = ["latitude", "longitude", "speedOverGround", "courseOverGround", "trueHeading", "rateOfTurn"]
INTEGERS = ["navigationalStatus", "shipType"]

POSITION_COLUMNS = ["mmsi", "vessel_name", "latitude", "longitude", "sog", "cog", "heading",
                    "nav_status", "ship_type", "rate_of_turn", "timestamp", "source", "offset"]


def to_utc(text_col) -> F.Column:
    """ISO text -> UTC instant; ``Z`` / offsets converted, naive taken as UTC
    (the session zone is UTC); unparsable -> null."""
    return F.try_to_timestamp(F.trim(text_col)).cast("timestamp_ntz")


def decode_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """Every line with its decoded fields and a ``reject_reason``.

    Reasons: ``blank`` (empty line), ``decode`` (bad JSON or not an object),
    ``missing_field`` (mmsi / latitude / longitude / msgtime absent),
    ``bad_timestamp`` (time not parsable).  Null reason = good record.
    """
    # ``inline`` hands on a row's parsed fields as plain columns: later expressions read them, while an expression named
    # in a select is put into each of its uses again, the whole parse with it, and so is a filter on the reason.
    text = F.trim(F.col(value))
    j = F.from_json(F.col(value), RAW_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt",
                                                "mode": "PERMISSIVE"})
    once = lambda df, struct: df.select(F.col("offset"), text_column, F.inline(F.array(struct)))      # noqa: E731
    text_column = text.alias("__text")
    d = once(raw, j)
    number = {c: F.trim(c).try_cast("double") for c in DECIMALS + INTEGERS}
    text_column = F.col("__text")
    d = once(d, F.struct("mmsi", "msgtime", "name", "_corrupt", to_utc(F.col("msgtime")).alias("__ts"),
                         *[F.col(c) for c in DECIMALS + INTEGERS], *[number[c].alias(f"__{c}") for c in number]))
    unreadable = F.lit(False)
    for c in DECIMALS + INTEGERS:
        n = F.col(f"__{c}")
        bad = n.isNull() if c in DECIMALS else (n.isNull() | (n != F.floor(n)))
        unreadable = unreadable | (F.col(c).isNotNull() & bad)
    number = {c: F.col(f"__{c}") for c in number} | {c: F.col(f"__{c}").try_cast("int") for c in INTEGERS}
    reason = (F.when(F.col("__text") == "", F.lit("blank"))
               .when(~F.col("__text").startswith("{") | F.col("_corrupt").isNotNull() | unreadable, F.lit("decode"))
               .when(F.col("mmsi").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull() |
                     F.col("msgtime").isNull(), F.lit("missing_field"))
               .when(F.col("__ts").isNull(), F.lit("bad_timestamp")))
    good = {"mmsi": F.col("mmsi"), "vessel_name": F.col("name"), "latitude": number["latitude"], "longitude": number["longitude"],
            "sog": number["speedOverGround"], "cog": number["courseOverGround"], "heading": number["trueHeading"],
            "nav_status": number["navigationalStatus"], "ship_type": number["shipType"], "rate_of_turn": number["rateOfTurn"],
            "timestamp": F.col("__ts")}
    d = d.select("offset", F.inline(F.array(F.struct(reason.alias("reject_reason"), *[v.alias(f"__of_{c}") for c, v in good.items()]))))
    return d.select(*[F.when(F.col("reject_reason").isNull(), F.col(f"__of_{c}")).alias(c) for c in good],
                    F.lit(C.DEFAULT_SOURCE).alias("source"), "offset", "reject_reason")


def normalize_positions(raw: DataFrame, value: str = "value") -> DataFrame:
    """Good records only, in the position schema."""
    return (decode_messages(raw, value).filter(F.col("reject_reason").isNull())
            .select(*POSITION_COLUMNS))


def pipeline_counters(decoded: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Received / skipped / processed / failed (by stage) / detected."""
    aggs = [F.count(F.lit(1)).alias("received"),
            F.count(F.when(F.col("reject_reason") == "blank", 1)).alias("skipped_blank"),
            F.count(F.when(F.col("reject_reason") == "decode", 1)).alias("failed_decode"),
            F.count(F.when(F.col("reject_reason").isin("missing_field", "bad_timestamp"), 1))
             .alias("failed_validation"),
            F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("processed")]
    out = decoded.agg(*aggs)
    if events is not None:
        out = out.withColumn("events_detected", events.select(F.count(F.lit(1))).scalar())
    return out
