"""Windows of consecutive hours over scaled features, against a plain loop."""

import datetime as dt
import math

from tidewater.operators import features as FT
from tidewater.operators import metrics as MT

START = dt.datetime(2024, 1, 1)
LENGTH = 5
FEATURES = ["a", "b", "flat"]


def hours(skip=()):
    rows = []
    for area, n in (("Bergen", 30), ("Ålesund", 12), ("Tromsø", 4)):
        for h in range(n):
            if (area, h) not in skip:
                label = None if h % 7 == 3 else h % 3
                rows.append((area, START + dt.timedelta(hours=h), "train" if h < 20 else "test", h * h % 11, math.sin(h), 4.0, label))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "study_area string, timestamp_utc timestamp_ntz, dataset_split string, a int, b double, flat double, label int")


def plain(rows):
    train = [r for r in rows if r[2] == "train"]
    stats = []
    for i in range(3, 6):
        v = [float(r[i]) for r in train]
        mean = sum(v) / len(v)
        stats.append((mean, math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) or 1.0))
    out = {}
    for area in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == area), key=lambda r: r[1])
        for i in range(LENGTH - 1, len(own)):
            part = own[i - LENGTH + 1:i + 1]
            if own[i][6] is not None and own[i][1] - part[0][1] == dt.timedelta(hours=LENGTH - 1):
                out[area, own[i][1]] = (own[i][2], own[i][6], [[(float(r[3 + k]) - m) / s for k, (m, s) in enumerate(stats)] for r in part])
    return out


def windows(spark, rows):
    df = frame(spark, rows)
    scaled = FT.scale_features(df, MT.scaler_stats(df, FEATURES), FEATURES)
    got = FT.sequence_windows(scaled, "label", LENGTH).collect()
    assert len({(r["study_area"], r["timestamp_utc"]) for r in got}) == len(got)
    return {(r["study_area"], r["timestamp_utc"]): (r["dataset_split"], r["label"], r["sequence"]) for r in got}


def check(spark, rows):
    got, want = windows(spark, rows), plain(rows)
    assert got.keys() == want.keys()
    for k, (split, label, seq) in want.items():
        assert got[k][:2] == (split, label)
        assert all(abs(x - y) < 1e-5 for p, q in zip(got[k][2], seq, strict=True) for x, y in zip(p, q, strict=True))
    return got


def test_windows_equal_plain_loop(spark):
    got = check(spark, hours())
    # unlabelled hours end no window but are inside others; an area shorter than a window has none
    assert ("Bergen", START + dt.timedelta(hours=10)) not in got and ("Bergen", START + dt.timedelta(hours=11)) in got
    assert not any(a == "Tromsø" for a, _ in got)
    # a test window may begin among train hours; a feature that never changes scales to 0
    assert got["Bergen", START + dt.timedelta(hours=20)][0] == "test"
    assert all(row[2] == 0.0 for _, _, seq in got.values() for row in seq)


def test_missing_hour_interrupts(spark):
    got = check(spark, hours(skip={("Bergen", 9)}))
    assert not any(("Bergen", START + dt.timedelta(hours=h)) in got for h in range(9, 14))
    assert ("Bergen", START + dt.timedelta(hours=14)) in got


def test_no_train_hours_and_empty(spark):
    rows = [(*r[:2], "test", *r[3:]) for r in hours()]
    got = windows(spark, rows)
    assert got.keys() == plain([*rows, ("x", START, "train", 1, 1.0, 1.0, None)]).keys()
    assert all(x is None for _, _, seq in got.values() for row in seq for x in row or [None])
    assert windows(spark, []) == {}
