"""Stream = batch: the live path over an envelope file source with availableNow."""

import json
import os
import time

from pyspark.sql import functions as F

from tidewater.operators import ingest as I
from tidewater.operators import live as L
from tidewater.sources import adapters as A
from tidewater.streaming import geofence as G
from tidewater.streaming import pipeline as P

SF001 = "/root/testdata/sf0.001"


def _write_envelopes(spark, folder, files=4, redeliver=False):
    raw = A.raw_ais_messages(spark, SF001)
    if redeliver:
        again = raw.filter(F.col("event_id") % 10 == 0).withColumn(
            "offset", F.col("offset") + F.lit(A.REDELIVERY_OFFSET_SHIFT))
        raw = raw.unionByName(again)
    rows = sorted((r.offset, r.value) for r in raw.collect())   # test fixture: 1,000 rows
    os.makedirs(folder, exist_ok=True)
    step = (len(rows) + files - 1) // files
    for i in range(files):
        part = rows[i * step:(i + 1) * step]
        with open(os.path.join(folder, f"part-{i:03d}.json"), "w") as f:
            for off, val in part:
                f.write(json.dumps({"offset": off, "value": val}) + "\n")
        t = time.time() - 1000 + i
        os.utime(os.path.join(folder, f"part-{i:03d}.json"), (t, t))
    return raw


def _key(rows):
    return sorted((r.mmsi, r.event_type, r.timestamp.replace(tzinfo=None)) for r in rows)


def test_event_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    raw = _write_envelopes(spark, src, redeliver=True)
    stream = P.envelope_file_stream(spark, src, max_files=1)
    q = P.start_event_sink(stream, os.path.join(scratch, "events"), os.path.join(scratch, "ck"),
                           trigger={"availableNow": True})
    q.awaitTermination(600)
    got = spark.read.parquet(os.path.join(scratch, "events")).collect()
    batch = L.event_insert(L.geofence_transitions(I.normalize_positions(raw)))
    expect = batch.withColumn("timestamp", F.col("timestamp").cast("timestamp")).collect()
    assert len(got) > 0
    assert _key(got) == _key(expect)

    # Hourly counters from the event table equal the batch counters
    q2 = P.start_hourly(spark, os.path.join(scratch, "events"), os.path.join(scratch, "hourly"),
                        os.path.join(scratch, "ck2"), trigger={"availableNow": True})
    q2.awaitTermination(600)
    hourly = {r.timestamp_utc.replace(tzinfo=None): r.total_events
              for r in P.hourly_table(spark, os.path.join(scratch, "hourly")).collect()}
    from tidewater.operators import hourly as H
    bh = {r.timestamp_utc: r.total_events for r in H.live_hourly_counts(batch).collect()}
    assert hourly == bh


def test_position_sinks(spark, scratch):
    src = os.path.join(scratch, "in")
    raw = _write_envelopes(spark, src, files=3, redeliver=True)
    base = os.path.join(scratch, "tables")
    q = P.start_position_sinks(P.envelope_file_stream(spark, src, max_files=1), base,
                               os.path.join(scratch, "ck"), trigger={"availableNow": True})
    q.awaitTermination(600)
    good = I.normalize_positions(raw)
    hist = spark.read.parquet(os.path.join(base, "history"))
    assert hist.count() == L.history_rows(good).count()
    cur = {(r.mmsi, r.offset) for r in P.current_vessels(spark, base).collect()}
    exp = {(r.mmsi, r.offset) for r in L.latest_per_vessel(good).collect()}
    assert cur == exp
    idx = P.search_index(spark, base)
    assert idx.count() == good.select("mmsi", "timestamp").distinct().count()
    rej = spark.read.parquet(os.path.join(base, "rejects"))
    assert rej.count() == I.decode_messages(raw).filter("reject_reason IS NOT NULL").count()


def _lines(spark, rows, folder, name):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for off, mmsi, ts, lat, lon in rows:
            value = json.dumps({"mmsi": mmsi, "msgtime": ts, "latitude": lat, "longitude": lon, "shipType": 70})
            f.write(json.dumps({"offset": off, "value": value}) + "\n")


def test_a_clock_ahead_cuts_off_nobody(spark, scratch):
    """One vessel is 60 days ahead of two others; the stream finds the same events and hours as the batch."""
    from tidewater import config as C
    from tidewater.operators import hourly as H
    inside, outside = (62.47, 6.15), (59.0, 3.0)
    files = [[(1, "257000001", "2024-03-05T10:00:00Z", *outside), (2, "257000001", "2024-03-05T10:10:00Z", *inside)],
             [(3, "257000002", "2024-01-05T08:00:00Z", *outside), (4, "257000003", "2024-01-05T08:01:00Z", *outside)],
             [(5, "257000002", "2024-01-05T08:10:00Z", *inside), (6, "257000003", "2024-01-05T09:11:00Z", *inside)],
             [(5, "257000002", "2024-01-05T08:10:00Z", *inside)]]
    src = os.path.join(scratch, "in")
    for i, rows in enumerate(files):
        _lines(spark, rows, src, f"part-{i}.json")
        os.utime(os.path.join(src, f"part-{i}.json"), (time.time() - 1000 + i,) * 2)
    q = P.start_event_sink(P.envelope_file_stream(spark, src, max_files=1), os.path.join(scratch, "ev"),
                           os.path.join(scratch, "ck"), trigger={"availableNow": True})
    q.awaitTermination(600)
    raw = spark.read.schema(P.ENVELOPE_SCHEMA).json(src)
    batch = L.event_insert(L.geofence_transitions(I.normalize_positions(raw)))
    got = spark.read.parquet(os.path.join(scratch, "ev")).collect()
    assert _key(got) == _key(batch.withColumn("timestamp", F.col("timestamp").cast("timestamp")).collect())
    assert len(got) == 3
    q = P.start_hourly(spark, os.path.join(scratch, "ev"), os.path.join(scratch, "h"), os.path.join(scratch, "ck2"),
                       trigger={"availableNow": True})
    q.awaitTermination(600)
    cols = ["timestamp_utc", *C.COUNTER_COLUMNS]
    assert sorted(map(tuple, P.hourly_table(spark, os.path.join(scratch, "h")).select(cols).collect())) == sorted(
        map(tuple, H.live_hourly_counts(batch).select(cols).collect()))


def _messages(spark, rows):
    """Positions (offset, mmsi, minute, inside) as a batch frame."""
    data = [(m, f"2024-01-01 00:{t:02d}:00", 62.47 if i else 59.0, 6.15 if i else 3.0, None, 70, 1.0, "t", off) for off, m, t, i in rows]
    return spark.createDataFrame(data, "mmsi string, timestamp string, latitude double, longitude double, vessel_name string, ship_type int, "
                                       "sog double, source string, offset long").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_saved_state_is_restored(spark):
    """A vessel that was inside leaves: an EXIT with the saved state, nothing without; a newer saved time makes rows stale."""
    G.use_rocksdb(spark)
    rows = _messages(spark, [(10, "a", 10, False), (11, "b", 10, True), (12, "c", 10, False), (13, "c", 40, False)])
    state = spark.createDataFrame([("a", True, "2024-01-01 00:05:00", 62.47, 6.15), ("c", True, "2024-01-01 00:30:00", 62.47, 6.15),
                                   ("d", True, "2024-01-01 00:30:00", 62.47, 6.15)],
                                  "mmsi string, inside boolean, last_timestamp string, latitude double, longitude double")
    got = G.geofence_stream(rows, initial=G.saved_state(state)).collect()
    assert sorted((r.mmsi, r.event_type, r.offset) for r in got) == [("a", "EXIT", 10), ("c", "EXIT", 13)]
    assert G.geofence_stream(rows).collect() == []


def test_rows_are_decided_piece_by_piece(spark):
    """A vessel of many pieces: the same events as the batch scan, and no piece larger than asked for."""
    G.use_rocksdb(spark)
    p = A.ais_positions(spark, SF001).withColumn("mmsi", F.lit("one"))
    want = sorted((r.event_type, r.offset) for r in L.event_insert(L.geofence_transitions(p)).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = sorted((r.event_type, r.offset) for r in G.geofence_stream(p).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(want) >= 8


def test_operator_adds_no_exchange_or_sort(spark):
    G.use_rocksdb(spark)
    plan = G.geofence_stream(A.ais_positions(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "REPARTITION_BY_NUM" in plan


def test_restart_and_late_redelivery(spark, scratch):
    """State and seen events survive a restart; a message delivered again a month later makes no event, and no batch
    of the event sink reads the event table."""
    inside, outside = (62.47, 6.15), (59.0, 3.0)
    src, ev, ck = (os.path.join(scratch, x) for x in ("in", "ev", "ck"))
    batches = [[(1, "257000001", "2024-03-05T10:00:00Z", *outside), (2, "257000001", "2024-03-05T10:10:00Z", *inside)],
               [(3, "257000001", "2024-04-05T10:00:00Z", *outside)],
               [(4, "257000001", "2024-03-05T10:10:00Z", *inside), (5, "257000001", "2024-04-05T10:00:00Z", *outside)]]
    for i, rows in enumerate(batches):
        _lines(spark, rows, src, f"part-{i}.json")
        q = P.start_event_sink(P.envelope_file_stream(spark, src), ev, ck, trigger={"availableNow": True})
        q.awaitTermination(60)
        assert q.exception() is None
    got = spark.read.parquet(ev)
    assert sorted((r.event_type, r.offset) for r in got.collect()) == [("ENTRY", 2), ("EXIT", 3)]
    # The same batch again, as after a lost commit: nothing is written.
    P.EventSink(ev)(got.drop("date", "batch_id"), 0)
    assert spark.read.parquet(ev).count() == 2


def test_state_ttl(spark, scratch):
    """With a short time to live the vessel is forgotten between two runs: leaving makes no event."""
    inside, outside = (62.47, 6.15), (59.0, 3.0)
    src, ev, ck = (os.path.join(scratch, x) for x in ("in", "ev", "ck"))
    for i, rows in enumerate([[(1, "257000001", "2024-03-05T10:00:00Z", *outside), (2, "257000001", "2024-03-05T10:10:00Z", *inside)],
                              [(3, "257000001", "2024-03-05T11:00:00Z", *outside)]]):
        _lines(spark, rows, src, f"part-{i}.json")
        P.start_event_sink(P.envelope_file_stream(spark, src), ev, ck, trigger={"once": True}, ttl_ms=500, seen_ttl_ms=500).awaitTermination(60)
        time.sleep(2)
    assert [(r.event_type, r.offset) for r in spark.read.parquet(ev).collect()] == [("ENTRY", 2)]


def test_log_is_folded_into_snapshots(spark, scratch):
    """One snapshot and fewer logs than ``every`` are read; a snapshot without its marker does not count."""
    p = A.ais_positions(spark, SF001).withColumn("part", F.pmod(F.col("offset"), F.lit(11)))
    log = P.CompactedLog(os.path.join(scratch, "log"), L.latest_per_vessel, every=4)
    for n in range(11):
        log.write(L.latest_per_vessel(p.where(F.col("part") == n)), n)
        want = sorted(map(str, L.latest_per_vessel(p.where(F.col("part") <= n)).collect()))
        assert sorted(map(str, log.read(spark).collect())) == want
    names = [x.rsplit("/", 1)[1] for x in log.folders(spark)]
    assert names == ["upto=7", "batch_id=8", "batch_id=9", "batch_id=10"]
    assert sorted(os.listdir(os.path.join(scratch, "log", "log"))) == [f"batch_id={n}" for n in (10, 4, 5, 6, 7, 8, 9)]
    log.write(L.latest_per_vessel(p.where(F.col("part") == 2)), 2)      # tried again long after
    log.compact(spark, 10)
    os.remove(os.path.join(scratch, "log", "snapshot", "upto=10", "_SUCCESS"))     # killed before the marker
    assert [x.rsplit("/", 1)[1] for x in log.folders(spark)][0] == "upto=7"
    assert sorted(map(str, log.read(spark).collect())) == want
