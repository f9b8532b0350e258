"""Structured Streaming live path.

Topology (each arrow is one streaming query with its own checkpoint):

    source (Kafka topic / envelope files) --decode+validate--> foreachBatch:
        rejects (P2), history (S8), latest-state log (S9), search log (S11)
    source --decode--> groupBy(mmsi).transformWithStateInPandas (X2), repeated events removed in its state (X5)
        --foreachBatch--> event table (S12)
    event table (file stream) --foreachBatch--> hourly increments (X3), merged on read

No stage has an event-time watermark: a vessel whose clock is ahead cuts off no other vessel's events.

Counters are derived from the de-duplicated event table, so a redelivered
message cannot count twice and counters never drift from events.

Every sink is idempotent under micro-batch retry (executor loss): history appends only rows whose key is not stored
yet (anti-join against only the date partitions the batch touches — a partition filter on its few dates); events are
written once for each batch; logs are written under ``batch_id=<n>`` with overwrite, and readers resolve "last write
wins" / "newest wins" with ``max_by`` at read time.  The latest-state and search logs are folded into a snapshot every
``every`` batches (``CompactedLog``), so a read touches one snapshot and fewer than that many logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.timefeat import floor_hour
from ..operators import hourly as H
from ..operators import ingest as I
from ..operators import live as L
from .geofence import EVENT_SCHEMA, geofence_stream, use_rocksdb

ENVELOPE_SCHEMA = T.StructType([T.StructField("offset", T.LongType()),
                                T.StructField("value", T.StringType())])


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

def envelope_file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """S5 (file form): JSON lines ``{"offset": n, "value": "<raw message>"}``.

    The envelope carries the arrival offset the transport assigned (as a
    Kafka record does); blank / bad / non-object messages are kept for P2.
    """
    r = spark.readStream.schema(ENVELOPE_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path).select(F.coalesce("value", F.lit("")).alias("value"), "offset")


def kafka_stream(spark: SparkSession, servers: str, topic: str = "vessel-positions",
                 max_offsets: int | None = None, starting: str = "earliest") -> DataFrame:
    """Topic source; value as text, offset = arrival order within its partition.

    Producers key messages by mmsi (S7), so one vessel stays in one partition
    and its offsets order its positions.  (Not exercised in tests: needs a broker.)
    """
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    return r.load().select(F.col("value").cast("string").alias("value"), "offset", "partition")


def kafka_sink(positions: DataFrame, servers: str, topic: str, checkpoint: str):
    """Position rows as JSON values keyed by mmsi (keeps per-vessel order)."""
    out = positions.select(F.col("mmsi").cast("string").alias("key"),
                           F.to_json(F.struct(*positions.columns)).alias("value"))
    return (out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


# ---------------------------------------------------------------------------
# Table helpers
# ---------------------------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def _with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date(F.col("timestamp").cast("timestamp")))


def append_new_keys(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose key is not stored yet (date-partitioned table)."""
    rows = _with_date(rows)
    existing = read_table(spark, path)
    if existing is not None:
        dates = [r[0] for r in rows.select("date").distinct().collect()]  # few dates per micro-batch
        existing = existing.filter(F.col("date").isin(dates)).select("date", *keys)
        rows = rows.join(existing, ["date", *keys], "left_anti")
    rows = rows.cache()
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("date").parquet(path)
    rows.unpersist()
    return n


def write_log(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite") \
      .parquet(f"{path}/batch_id={batch_id}")


class CompactedLog:
    """A log of micro-batches with a snapshot every ``every`` batches.

    ``log/batch_id=<n>`` holds a batch, ``snapshot/upto=<n>`` the rows that ``pick`` keeps of everything up to batch n.
    A folder counts once Spark's own marker (``_SUCCESS``) is in it, which is written last: a job that dies while a
    snapshot is written leaves the one before and its logs in force.  What a snapshot replaces is deleted one snapshot
    later, so that readers which have listed it can end.
    """

    def __init__(self, path: str, pick, every: int = 32):
        self.path, self.pick, self.every = path.rstrip("/"), pick, every

    def _done(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the complete folders, ascending: at most a few snapshots and twice ``every`` logs."""
        jvm = spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(p.getName().split("=")[1]) for p in found
                      if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _delete(self, spark: SparkSession, folder: str) -> None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def folders(self, spark: SparkSession, upto: int | None = None) -> list[str]:
        """The newest snapshot and the logs after it."""
        snapshots = [n for n in self._done(spark, "snapshot") if upto is None or n <= upto]
        since = snapshots[-1] if snapshots else -1
        logs = [n for n in self._done(spark, "log") if n > since and (upto is None or n <= upto)]
        return [f"{self.path}/snapshot/upto={n}" for n in snapshots[-1:]] + [f"{self.path}/log/batch_id={n}" for n in logs]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Append a batch (again, if it is tried again) and write a snapshot when it is due."""
        spark = rows.sparkSession
        snapshots = self._done(spark, "snapshot")
        if snapshots and batch_id <= snapshots[-1]:
            return      # tried again after its snapshot
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact(spark, batch_id)

    def compact(self, spark: SparkSession, upto: int) -> None:
        before = self._done(spark, "snapshot")
        self.pick(spark.read.parquet(*self.folders(spark, upto))).write.mode("overwrite").parquet(f"{self.path}/snapshot/upto={upto}")
        if before:
            for n in before[:-1]:
                self._delete(spark, f"{self.path}/snapshot/upto={n}")
            for n in self._done(spark, "log"):
                if n <= before[-1]:
                    self._delete(spark, f"{self.path}/log/batch_id={n}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.pick(spark.read.parquet(*self.folders(spark)))


# ---------------------------------------------------------------------------
# Position sinks
# ---------------------------------------------------------------------------

def latest_log(base: str, every: int = 32) -> CompactedLog:
    """Newest row per mmsi (ties: first arrival); a snapshot is as large as the fleet."""
    return CompactedLog(f"{base.rstrip('/')}/latest", L.latest_per_vessel, every)


def search_log(base: str, every: int = 256) -> CompactedLog:
    """Per (mmsi, time) the last write; a snapshot holds all documents, so it is written more rarely."""
    return CompactedLog(f"{base.rstrip('/')}/search", lambda log: L._pick(log, ["mmsi", "timestamp"], F.col("offset")), every)


class PositionSinks:
    """foreachBatch writer for rejects (P2), history (S8), latest log (S9), search log."""

    def __init__(self, base: str, every: int = 32):
        self.base, self.every = base.rstrip("/"), every

    def __call__(self, decoded: DataFrame, batch_id: int) -> None:
        spark = decoded.sparkSession
        decoded = decoded.cache()
        write_log(decoded.filter(F.col("reject_reason").isNotNull()), f"{self.base}/rejects", batch_id)
        good = decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason")
        append_new_keys(spark, L.history_rows(good), f"{self.base}/history", ["mmsi", "timestamp"])
        latest_log(self.base, self.every).write(L.latest_per_vessel(good), batch_id)
        search_log(self.base, 8 * self.every).write(L.search_documents(good.withColumn("imo", F.lit(None).cast("string"))), batch_id)
        decoded.unpersist()


def current_vessels(spark: SparkSession, base: str) -> DataFrame:
    """S9 read side: newest row per mmsi."""
    return latest_log(base).read(spark)


def search_index(spark: SparkSession, base: str) -> DataFrame:
    """S11 read side: per document id the last write (highest offset) wins."""
    return search_log(base).read(spark)


def start_position_sinks(raw: DataFrame, base: str, checkpoint: str, trigger: dict | None = None):
    decoded = I.decode_messages(raw)
    w = decoded.writeStream.foreachBatch(PositionSinks(base)).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": f"{C.INGEST_MAX_WAIT_MS} milliseconds"})).start()


# ---------------------------------------------------------------------------
# X2 + X5 + S12: events
# ---------------------------------------------------------------------------

class EventSink:
    """foreachBatch writer for S12: the events of a batch, once; nothing stored is read.

    The operator's state already holds one event per (mmsi, event_type, timestamp).  A batch that is tried again finds
    its folder complete and writes nothing, so readers of the table (X3) see no file twice.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        folder = f"{self.path}/batch_id={batch_id}"
        if not _exists(events.sparkSession, f"{folder}/_SUCCESS"):
            _with_date(events).write.mode("overwrite").partitionBy("date").parquet(folder)


def event_stream(raw: DataFrame, ttl_ms: int | None = None, initial: DataFrame | None = None, seen_ttl_ms: int | None = None) -> DataFrame:
    """Transitions as they happen, each once.  No event-time watermark: one vessel whose clock runs ahead must not
    cut off the others.  ``initial``: saved state (``geofence.saved_state``) for vessels that the stream has not seen."""
    return geofence_stream(I.normalize_positions(raw), ttl_ms, initial, seen_ttl_ms)


def start_event_sink(raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, ttl_ms: int | None = None,
                     initial: DataFrame | None = None, seen_ttl_ms: int | None = None):
    use_rocksdb(raw.sparkSession)
    w = (event_stream(raw, ttl_ms, initial, seen_ttl_ms).writeStream.foreachBatch(EventSink(path))
         .option("checkpointLocation", checkpoint))
    return w.trigger(**(trigger or {"processingTime": f"{C.INGEST_MAX_WAIT_MS} milliseconds"})).start()


# ---------------------------------------------------------------------------
# Hourly counters from the event table
# ---------------------------------------------------------------------------

class HourlySink:
    """foreachBatch writer: increments of each batch of new events per hour, and its (hour, vessel) pairs.

    Events are stored once (``EventSink``), so the increments add up; a late event of any age counts in its own
    hour.  A batch that is retried overwrites its own folder.  No state is kept in the stream.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        events = events.cache()
        counts, pairs = hour_increments(events)
        write_log(counts, f"{self.path}/counts", batch_id)
        write_log(pairs, f"{self.path}/vessels", batch_id)
        events.unpersist()


def hour_increments(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counters per hour without distinct vessels, and the (hour, vessel) pairs that give those."""
    return (H.live_hourly_counts(events).drop("unique_vessels"),
            events.select(floor_hour("timestamp").alias("timestamp_utc"), "mmsi").distinct())


def merge_hours(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Increments summed per hour; distinct vessels through their (hour, vessel) pairs."""
    sums = [F.sum(c).alias(c) for c in C.COUNTER_COLUMNS if c != "unique_vessels"]
    seen = (pairs.select("timestamp_utc", "mmsi").distinct().groupBy("timestamp_utc")
            .agg(F.count("mmsi").alias("unique_vessels")))
    return (counts.groupBy("timestamp_utc").agg(*sums).join(seen, "timestamp_utc")
            .select("timestamp_utc", *C.COUNTER_COLUMNS))


def hourly_table(spark: SparkSession, path: str) -> DataFrame:
    """X3 read side."""
    path = path.rstrip("/")
    return merge_hours(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/vessels"))


def start_hourly(spark: SparkSession, events_path: str, out_path: str, checkpoint: str,
                 trigger: dict | None = None):
    schema = T._parse_datatype_string(EVENT_SCHEMA)
    ev = spark.readStream.schema(schema).parquet(events_path)
    w = ev.writeStream.foreachBatch(HourlySink(out_path)).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


# ---------------------------------------------------------------------------
# The whole live path
# ---------------------------------------------------------------------------

def start_live_pipeline(spark: SparkSession, raw: DataFrame, base: str, checkpoint_root: str | None = None,
                        trigger: dict | None = None) -> dict:
    """Start the three queries of the live path on one source.

    ``checkpoint_root`` defaults to a folder under the session's shared
    ``spark.checkpoint.dir`` (never a machine-local temporary folder).
    Returns the started queries by name; each can be stopped or awaited.
    """
    from ..session import ensure_checkpoint_dir
    root = (checkpoint_root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/live").rstrip("/")
    base = base.rstrip("/")
    return {
        "positions": start_position_sinks(raw, base, f"{root}/positions", trigger),
        "events": start_event_sink(raw, f"{base}/events", f"{root}/events", trigger),
        "hourly": start_hourly(spark, f"{base}/events", f"{base}/hourly", f"{root}/hourly", trigger),
    }
