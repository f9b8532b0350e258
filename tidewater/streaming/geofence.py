"""X2 + X5: stateful geofence detector as ``transformWithStateInPandas``.

State per vessel: a ``ValueState`` (inside flag, last accepted time, position) and a ``MapState`` of the events it has
made (type, time), so that a message delivered again makes no second event, however late, without reading the event
table.  Both may carry a processing-time TTL (the reference keeps a 24-hour copy of the state; its in-memory copy never
expires, so TTL is off by default).  ``initialState`` restores a saved state table, e.g. of another deployment or of a
batch run over the history (``live.final_geofence_state``).

On batch input (a backfill over the history) a vessel's rows reach the processor in arrival order, dealt by mmsi and
sorted by offset inside the partition, which the operator's own requirements keep; they are decided piece by piece as
Spark hands them over, and no more than one piece is held.  Streams cannot be sorted: there a vessel's rows of one
micro-batch are put in order first, so their number is bounded by the source's limit for a trigger
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).  A row is accepted when its time is >= the largest time seen
so far; the state it is compared with is the last accepted row before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C

STATE_SCHEMA = "inside boolean, last_ts_us long, latitude double, longitude double"
SEEN_KEY = "event_type string, ts_us long"
EVENT_SCHEMA = ("mmsi string, event_type string, timestamp timestamp, latitude double, "
                "longitude double, vessel_name string, ship_type int, sog double, source string, "
                "offset long")
_EVENT_COLS = ["mmsi", "event_type", "timestamp", "latitude", "longitude", "vessel_name", "ship_type",
               "sog", "source", "offset"]


def decide(ts_us: np.ndarray, inside: np.ndarray, state: tuple | None):
    """Vectorised geofence decisions for rows already sorted by offset.

    Returns (event codes: 1 ENTRY / -1 EXIT / 0 none, index of the last
    accepted row or -1).
    """
    n = len(ts_us)
    s_ts = state[1] if state is not None else None
    s_in = bool(state[0]) if state is not None else None
    run = np.maximum.accumulate(ts_us)
    prev_max = np.empty(n, dtype=np.int64)
    prev_max[0] = s_ts if s_ts is not None else np.iinfo(np.int64).min
    prev_max[1:] = run[:-1]
    if s_ts is not None:
        prev_max = np.maximum(prev_max, s_ts)
    has_prior = np.ones(n, dtype=bool)
    if s_ts is None:
        has_prior[0] = False
    accepted = ~has_prior | (ts_us >= prev_max)
    acc_idx = np.where(accepted, np.arange(n), -1)
    last_acc = np.maximum.accumulate(acc_idx)
    last_before = np.concatenate([[-1], last_acc[:-1]])
    prev_in = np.where(last_before >= 0, inside[np.clip(last_before, 0, None)],
                       s_in if s_in is not None else False)
    prev_known = (last_before >= 0) | (s_in is not None)
    change = prev_known & accepted & (prev_in != inside)
    codes = np.where(change, np.where(inside, 1, -1), 0)
    return codes, int(last_acc[-1]) if n else -1


class GeofenceProcessor(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None, seen_ttl_ms: int | None = None, ordered: bool = False, min_lat: float = C.GEOFENCE_MIN_LAT,
                 max_lat: float = C.GEOFENCE_MAX_LAT, min_lon: float = C.GEOFENCE_MIN_LON, max_lon: float = C.GEOFENCE_MAX_LON):
        self.ttl_ms, self.seen_ttl_ms, self.ordered = ttl_ms, seen_ttl_ms, ordered
        self.box = (min_lat, max_lat, min_lon, max_lon)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("geofence", STATE_SCHEMA, self.ttl_ms)
        self.seen = handle.getMapState("events", SEEN_KEY, "seen boolean", self.seen_ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[-1]
        self.state.update((bool(row["inside"]), int(row["last_ts_us"]), float(row["latitude"]), float(row["longitude"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = state = self.state.get()       # None if there is none
        self.known, self.made = None, set()
        arrived = None
        for pdf in rows if self.ordered else [pd.concat(list(rows), ignore_index=True)]:
            if arrived is not None and pdf["offset"].min() < arrived:
                raise ValueError(f"rows of {key} are not in arrival order")     # the plan rules it out
            arrived = pdf["offset"].max()
            state, events = self.piece(pdf, state)
            if events is not None:
                yield events
        if state is not before:
            self.state.update(state)

    def _first(self, made: tuple) -> bool:
        """Whether the event is new; keeps it.  Each question to the state is a round trip: a vessel without any saved
        event is asked for none of them, and what this call has kept is known here."""
        if self.known is None:
            self.known = self.seen.exists()
        if made in self.made or (self.known and self.seen.containsKey(made)):
            return False
        self.made.add(made)
        self.seen.updateValue(made, (True,))
        return True

    def piece(self, pdf: pd.DataFrame, state: tuple | None) -> tuple[tuple | None, pd.DataFrame | None]:
        """The state after some rows of a vessel, and the events that they make."""
        pdf = pdf.dropna(subset=["latitude", "longitude", "timestamp"])
        if pdf.empty:
            return state, None
        pdf = pdf.sort_values("offset", kind="stable").reset_index(drop=True)
        lo_lat, hi_lat, lo_lon, hi_lon = self.box
        inside = ((pdf["latitude"] >= lo_lat) & (pdf["latitude"] <= hi_lat) &
                  (pdf["longitude"] >= lo_lon) & (pdf["longitude"] <= hi_lon)).to_numpy()
        ts = pd.to_datetime(pdf["timestamp"])
        if getattr(ts.dt, "tz", None) is not None:
            ts = ts.dt.tz_convert("UTC").dt.tz_localize(None)
        ts_us = ts.astype("datetime64[us]").astype("int64").to_numpy()
        codes, last = decide(ts_us, inside, state)
        if last >= 0:
            state = (bool(inside[last]), int(ts_us[last]), float(pdf["latitude"].iloc[last]), float(pdf["longitude"].iloc[last]))
        new = []
        for i in np.flatnonzero(codes):
            made = ("ENTRY" if codes[i] == 1 else "EXIT", int(ts_us[i]))
            if self._first(made):
                new.append((i, made[0]))
        if not new:
            return state, None
        out = pdf.iloc[[i for i, _ in new]].copy()
        out["event_type"] = [kind for _, kind in new]
        return state, out[_EVENT_COLS]

    def close(self) -> None:
        pass


def saved_state(states: DataFrame) -> DataFrame:
    """Rows of ``live.final_geofence_state`` (mmsi, inside, last_timestamp, latitude, longitude) as ``initialState`` rows."""
    return states.select("mmsi", "inside", F.unix_micros(F.col("last_timestamp").cast("timestamp")).alias("last_ts_us"), "latitude", "longitude")


def geofence_stream(positions: DataFrame, ttl_ms: int | None = None, initial: DataFrame | None = None,
                    seen_ttl_ms: int | None = None) -> DataFrame:
    """Streaming (or batch) positions -> ENTRY / EXIT events, once each; state per mmsi, from ``initial`` (``saved_state``)."""
    spark = positions.sparkSession
    p = positions.where("mmsi IS NOT NULL").select(
        "mmsi", F.col("timestamp").cast("timestamp").alias("timestamp"), "latitude", "longitude", "vessel_name",
        F.col("ship_type").cast("int").alias("ship_type"), "sog", "source", F.col("offset").cast("long").alias("offset"))
    if not p.isStreaming:
        # The operator asks for this very partitioning and for rows sorted by mmsi, so it adds no exchange and no sort.
        p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mmsi").sortWithinPartitions("mmsi", "offset")
    return p.groupBy("mmsi").transformWithStateInPandas(
        statefulProcessor=GeofenceProcessor(ttl_ms, seen_ttl_ms, ordered=not p.isStreaming), outputStructType=EVENT_SCHEMA,
        outputMode="Append", timeMode="ProcessingTime" if ttl_ms or seen_ttl_ms else "None",
        initialState=initial.groupBy("mmsi") if initial is not None else None)


def use_rocksdb(spark) -> None:
    """State in RocksDB, which ``transformWithState`` needs."""
    spark.streams       # starts the state store's coordinator, which batch jobs ask for as well
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
