"""Geofence state machine (W4 / X2): literal cases and equivalence with a row-by-row loop."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators import hourly as H
from tidewater.operators import live as L
from tidewater.streaming.geofence import decide

T0 = dt.datetime(2024, 5, 1, 12, 10)
SCHEMA = ("mmsi string, timestamp timestamp_ntz, latitude double, longitude double, offset long, "
          "vessel_name string, ship_type int, sog double, source string")


def _rows(mmsi, pts, ship_type=70):
    return [(mmsi, T0 + dt.timedelta(minutes=m), la, lo, i, "TEST", ship_type, 10.0, "test")
            for i, (m, la, lo) in enumerate(pts)]


def loop_reference(rows):
    """Plain row-by-row detector (the reference semantics)."""
    state, out = {}, []
    for mmsi, ts, inside, off in sorted(rows, key=lambda r: r[3]):
        s = state.get(mmsi)
        if s is None:
            state[mmsi] = (inside, ts)
            continue
        if ts < s[1]:
            continue
        if s[0] != inside:
            out.append((mmsi, "ENTRY" if inside else "EXIT", ts, off))
        state[mmsi] = (inside, ts)
    return sorted(out)


def test_transitions_literal(spark):
    df = spark.createDataFrame(_rows("257123456", [(0, 62.40, 6.14), (5, 62.47, 6.14), (10, 62.48, 6.16),
                                                   (20, 62.40, 6.14)]), SCHEMA)
    ev = L.geofence_transitions(df).orderBy("offset").collect()
    assert [(e.event_type, e.offset) for e in ev] == [("ENTRY", 1), ("EXIT", 3)]


def test_first_row_inside_no_event_equal_ts_accepted_older_ignored(spark):
    pts = [(0, 62.47, 6.14),      # first row inside: no event
           (10, 62.40, 6.14),     # EXIT
           (5, 62.47, 6.14),      # older than state: ignored
           (10, 62.47, 6.14)]     # equal time: accepted -> ENTRY
    df = spark.createDataFrame(_rows("257000001", pts), SCHEMA)
    scan = L.geofence_scan(df).orderBy("offset").collect()
    assert [r.event_type for r in scan] == [None, "EXIT", None, "ENTRY"]
    assert [r.stale for r in scan] == [False, False, True, False]


def test_counters_literal(spark):
    pts = [(0, 62.40, 6.14), (5, 62.47, 6.14), (20, 62.40, 6.14)]
    df = spark.createDataFrame(_rows("257999999", pts), SCHEMA)
    ev = L.geofence_transitions(df)
    c = H.live_hourly_counts(ev).collect()
    assert len(c) == 1
    r = c[0]
    assert (r.total_events, r.arrivals, r.departures, r.unique_vessels, r.cargo_events) == (2, 1, 1, 1, 2)


def test_zero_hour_snapshot(spark):
    pts = [(0, 62.40, 6.14), (60, 62.40, 6.14), (80, 62.47, 6.14)]
    df = spark.createDataFrame(_rows("257000002", pts), SCHEMA)
    snap = H.zero_hour_snapshot(df, L.geofence_transitions(df)).orderBy("timestamp_utc").collect()
    assert [r.total_events for r in snap] == [0, 1]
    assert snap[1].arrivals == 1 and snap[1].departures == 0 and snap[1].unique_vessels == 1
    assert all(getattr(snap[0], c) == 0 for c in snap[0].asDict() if c != "timestamp_utc")


events_strategy = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.booleans()),
                           min_size=1, max_size=40)


@settings(max_examples=12, deadline=None)
@given(events_strategy, st.integers(1, 7))
def test_window_form_equals_loop(spark, evs, chunk):
    rows = [(f"25700000{m}", T0 + dt.timedelta(minutes=t), 62.47 if ins else 62.40, 6.14, i,
             "X", 70, 1.0, "t") for i, (m, t, ins) in enumerate(evs)]
    df = spark.createDataFrame(rows, SCHEMA)
    expect = loop_reference([(r[0], r[1], r[2] > 62.43, r[4]) for r in rows])
    for c in (None, chunk):
        got = sorted((r.mmsi, r.event_type, r.timestamp, r.offset)
                     for r in L.geofence_transitions(df, chunk=c).collect())
        assert got == expect


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.booleans()), min_size=1, max_size=60),
       st.integers(0, 60), st.booleans(), st.booleans())
def test_stream_decide_equals_loop(evs, split, with_state, state_inside):
    """X2's vectorised micro-batch decision, chained over two batches, equals the loop."""
    ts = np.array([t for t, _ in evs], dtype=np.int64)
    ins = np.array([b for _, b in evs], dtype=bool)
    rows = [("m", int(t), bool(b), i) for i, (t, b) in enumerate(evs)]
    state = None
    if with_state:
        state = (state_inside, -1, 0.0, 0.0)
        rows = [("m", -1, state_inside, -1)] + rows
    expect = [(e[2], e[1]) for e in loop_reference(rows)]
    got = []
    k = min(split, len(evs))
    for lo, hi in ((0, k), (k, len(evs))):
        if hi <= lo:
            continue
        codes, last = decide(ts[lo:hi], ins[lo:hi], state)
        got += [(int(ts[lo + i]), "ENTRY" if c == 1 else "EXIT") for i, c in enumerate(codes) if c != 0]
        if last >= 0:
            state = (bool(ins[lo + last]), int(ts[lo + last]), 0.0, 0.0)
    assert sorted(got) == sorted(expect)


def test_chunked_scan_equals_simple_on_fixture_with_hot_vessel(spark):
    """Real fixture rows plus one vessel holding a third of all rows: the chunked
    scan (many offset segments) equals the single-window form."""
    from pyspark.sql import functions as F
    from tidewater.sources import adapters as A
    p = A.ais_positions(spark, "/root/testdata/sf0.001")
    hot = p.filter(F.col("event_id") % 3 == 0).withColumn("mmsi", F.lit("257999000"))
    data = p.filter(F.col("event_id") % 3 != 0).unionByName(hot)
    key = ["mmsi", "event_type", "timestamp", "offset"]
    simple = sorted(tuple(r) for r in L.geofence_transitions(data, chunk=None).select(*key).collect())
    chunked = sorted(tuple(r) for r in L.geofence_transitions(data, chunk=16).select(*key).collect())
    assert simple == chunked and len(simple) > 0


def test_a_vessel_without_saved_events_is_asked_for_none():
    import pandas as pd
    from tidewater.streaming.geofence import GeofenceProcessor

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

    class Map(dict):
        asked = 0

        def exists(self):
            return bool(len(self))

        def containsKey(self, k):
            self.asked += 1
            return k in self

        def updateValue(self, k, v):
            self[k] = v

    class Handle:
        def getValueState(self, *args):
            return Value()

        def getMapState(self, *args):
            return Map()

    g = GeofenceProcessor(ordered=True)
    g.init(Handle())
    when = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:05", "2024-01-01 00:10", "2024-01-01 00:10", "2024-01-01 00:10", "2024-01-01 00:10"])
    rows = pd.DataFrame({"mmsi": "257", "timestamp": when, "latitude": [62.4, 62.47, 62.4, 62.47, 62.4, 62.47], "longitude": 6.14,
                         "vessel_name": None, "ship_type": 70, "sog": 1.0, "source": "s", "offset": range(6)})
    made = pd.concat(g.handleInputRows("257", iter([rows]), None))
    assert list(made["event_type"]) == ["ENTRY", "EXIT", "ENTRY"] and g.seen.asked == 0
    # Delivered again: the saved events are asked for, none is made twice.
    again = rows.assign(offset=range(6, 12)).iloc[2:]
    assert not list(g.handleInputRows("257", iter([again]), None)) and g.seen.asked > 0
