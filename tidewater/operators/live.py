"""Live AIS path in batch form: geofence transitions, vessel state, stores.

Key identity used by the geofence detector (W4): with arrival order ``offset``,
the state a row sees equals the row with the greatest ``(timestamp, offset)``
among the vessel's earlier arrivals.  (Rows older than the state are ignored;
every accepted row has a timestamp >= all earlier ones, so the last accepted row
is the last arrival of the running maximum timestamp.)  The detector is
therefore a running ``max(struct(timestamp, offset, inside))`` — an
associative scan — which we split into offset chunks: a chunk-local window
plus a carried prefix from a small per-chunk summary.  A vessel holding a third
of all rows is spread over many (mmsi, chunk) window partitions instead of one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import inside_box

DEFAULT_CHUNK = 1_000_000  # offsets per scan segment

EVENT_COLUMNS = ["mmsi", "event_type", "timestamp", "latitude", "longitude", "vessel_name",
                 "ship_type", "sog", "source", "offset"]


def _prev_state_simple(p: DataFrame) -> DataFrame:
    w = (Window.partitionBy("mmsi").orderBy("offset")
         .rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumn("__prev", F.max("__key").over(w))


def _prev_state_chunked(p: DataFrame, chunk: int) -> DataFrame:
    p = p.withColumn("__chunk", F.floor(F.col("offset") / F.lit(chunk)))
    local_w = (Window.partitionBy("mmsi", "__chunk").orderBy("offset")
               .rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("__local", F.max("__key").over(local_w))
    summary = p.groupBy("mmsi", "__chunk").agg(F.max("__key").alias("__chunk_max"))
    carry_w = (Window.partitionBy("mmsi").orderBy("__chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select("mmsi", "__chunk", F.max("__chunk_max").over(carry_w).alias("__carry"))
    return (p.join(carry, ["mmsi", "__chunk"], "left")
             .withColumn("__prev", F.greatest("__local", "__carry"))
             .drop("__local", "__carry", "__chunk"))


def geofence_scan(positions: DataFrame, chunk: int | None = DEFAULT_CHUNK,
                  inside: Column | None = None) -> DataFrame:
    """Every valid position with its geofence decision.

    Adds ``inside``, ``prev_inside`` (state before the row; null for the
    first row), ``stale`` (older than the state: ignored) and ``event_type``
    (ENTRY / EXIT / null).  Rows without mmsi, coordinates or time are skipped.
    """
    p = positions.filter(F.col("mmsi").isNotNull() & F.col("latitude").isNotNull() &
                         F.col("longitude").isNotNull() & F.col("timestamp").isNotNull())
    p = p.withColumn("inside", F.coalesce(inside if inside is not None else inside_box(),
                                          F.lit(False)))
    p = p.withColumn("__key", F.struct(F.col("timestamp").alias("ts"), F.col("offset").alias("off"),
                                       F.col("inside").alias("inside")))
    p = _prev_state_chunked(p, chunk) if chunk else _prev_state_simple(p)
    prev = F.col("__prev")
    stale = prev.isNotNull() & (F.col("timestamp") < prev["ts"])
    changed = prev.isNotNull() & ~stale & (prev["inside"] != F.col("inside"))
    etype = (F.when(changed & F.col("inside"), F.lit("ENTRY"))
              .when(changed & ~F.col("inside"), F.lit("EXIT")))
    return (p.withColumn("prev_inside", prev["inside"]).withColumn("prev_ts", prev["ts"])
             .withColumn("stale", stale)
             .withColumn("event_type", etype).drop("__key", "__prev"))


def geofence_transitions(positions: DataFrame, chunk: int | None = DEFAULT_CHUNK) -> DataFrame:
    """ENTRY / EXIT events in the traffic-event schema."""
    scan = geofence_scan(positions, chunk)
    return scan.filter(F.col("event_type").isNotNull()).select(*EVENT_COLUMNS)


def final_geofence_state(positions: DataFrame) -> DataFrame:
    """State per vessel after all rows: the row with the greatest (timestamp, offset)."""
    p = positions.filter(F.col("mmsi").isNotNull() & F.col("latitude").isNotNull() &
                         F.col("longitude").isNotNull() & F.col("timestamp").isNotNull())
    best = F.max_by(F.struct(F.coalesce(inside_box(), F.lit(False)).alias("inside"),
                             F.col("timestamp").alias("last_timestamp"), "latitude", "longitude"),
                    F.struct("timestamp", "offset"))
    return p.groupBy("mmsi").agg(best.alias("s")).select("mmsi", "s.*")


# ---------------------------------------------------------------------------
# Vessel state stores.  All "pick one row per key" rules are max_by / min_by
# aggregates: partial aggregation runs map-side, so a hot key is reduced before
# the shuffle and no task ever holds a whole group.
# ---------------------------------------------------------------------------

def _pick(df: DataFrame, keys: list[str], order: Column, newest: bool = True) -> DataFrame:
    cols = [c for c in df.columns]
    agg = F.max_by if newest else F.min_by
    return df.groupBy(*keys).agg(agg(F.struct(*cols), order).alias("__r")).select("__r.*")


def latest_per_vessel(positions: DataFrame) -> DataFrame:
    """Newest row per mmsi; among equal timestamps the first arrival wins."""
    return _pick(positions, ["mmsi"], F.struct(F.col("timestamp"), (-F.col("offset")).alias("o")))


def last_arrival_per_vessel(positions: DataFrame) -> DataFrame:
    """Unconditional overwrite in arrival order: last offset per mmsi wins."""
    return _pick(positions, ["mmsi"], F.col("offset"))


def search_documents(positions: DataFrame) -> DataFrame:
    """One document per (mmsi, timestamp); a rewrite replaces (last write wins)."""
    docs = _pick(positions, ["mmsi", "timestamp"], F.col("offset"))
    doc_id = F.concat(F.col("mmsi"), F.lit("-"),
                      F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return docs.withColumn("doc_id", doc_id)


def history_rows(positions: DataFrame) -> DataFrame:
    """S8 within one batch: first write per (mmsi, timestamp) wins."""
    return _pick(positions, ["mmsi", "timestamp"], F.col("offset"), newest=False)


def history_insert(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose (mmsi, timestamp) is not stored yet."""
    return history_rows(batch).join(existing.select("mmsi", "timestamp"),
                                    ["mmsi", "timestamp"], "left_anti")


def merge_latest(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert the batch's newest row per mmsi; only a strictly newer
    timestamp overwrites (older or equal keeps the stored row)."""
    new = latest_per_vessel(batch)
    cols = snapshot.columns
    o = snapshot.alias("o")
    n = new.select(*cols).alias("n")
    j = o.join(n, F.col("o.mmsi") == F.col("n.mmsi"), "full_outer")
    take_new = F.col("o.mmsi").isNull() | (F.col("n.mmsi").isNotNull() &
                                           (F.col("n.timestamp") > F.col("o.timestamp")))
    return j.select(*[F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
                      for c in cols])


def event_insert(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Keep one event per (mmsi, event_type, timestamp) not stored yet."""
    keys = ["mmsi", "event_type", "timestamp"]
    first = _pick(events, keys, F.col("offset"), newest=False)
    if existing is not None:
        first = first.join(existing.select(*keys), keys, "left_anti")
    return first


def late_rows(positions: DataFrame, chunk: int | None = DEFAULT_CHUNK) -> DataFrame:
    """How each store treats rows older than its state.

    geofence ignores ``ts < state``; latest-state ignores ``ts <= state``;
    history keeps all; last-arrival cache accepts all.
    """
    s = geofence_scan(positions, chunk).withColumn("__pm", F.col("prev_ts"))
    return s.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("stale"), 1)).alias("geofence_ignored"),
        F.count(F.when(F.col("__pm").isNotNull() & (F.col("timestamp") <= F.col("__pm")), 1))
         .alias("latest_state_ignored"),
        F.count(F.lit(1)).alias("history_kept"),
        F.count(F.lit(1)).alias("last_arrival_accepted"))
