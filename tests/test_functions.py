"""Literal cases of the reference tests (geofence, ship types, cleaning, time)."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.functions import clean as CL
from tidewater.functions import geo as G
from tidewater.functions import shiptype as S
from tidewater.functions.timefeat import calendar_columns, cyclical_columns


def test_geofence_points(spark):
    rows = [(62.4722, 6.1495, True), (62.4680, 6.1300, True), (62.20, 6.15, False),
            (62.47, 7.00, False), (62.43, 6.05, True), (62.52, 6.27, True)]
    df = spark.createDataFrame(rows, "lat double, lon double, expected boolean")
    got = df.select(G.inside_box("lat", "lon").alias("g"), "expected").collect()
    assert all(r.g == r.expected for r in got)


def test_ship_type_mapping(spark):
    cases = {"30": "fishing", "31": "tug", "32": "tug", "52": "tug", "60": "passenger", "65": "passenger",
             "69": "passenger", "70": "cargo", "75": "cargo", "79": "cargo", "80": "tanker", "85": "tanker",
             "89": "tanker", "50": "auxiliary", "51": "auxiliary", "54": "auxiliary", "36": None, "37": None,
             "90": None, None: None, "invalid": None, "-1": None, "100": None}
    df = spark.createDataFrame([(k,) for k in cases], "code string")
    got = {r.code: r.g for r in df.select("code", S.ship_group("code").alias("g")).collect()}
    assert got == cases
    norm = {r.code: r.n for r in df.select("code", S.normalize_ship_type("code").alias("n")).collect()}
    assert norm["-1"] is None and norm["100"] is None and norm["30"] == 30


def test_ship_type_label(spark):
    df = spark.createDataFrame([("70",), ("36",), ("x",)], "code string")
    got = [r.l for r in df.select(S.ship_type_label("code").alias("l")).collect()]
    assert got == ["Cargo", "AIS 36", "Unknown"]


def test_cleaning_literals(spark):
    df = spark.createDataFrame([("259222000,0", "223,899", " nan ", "YES")], "i string, n string, t string, b string")
    r = df.select(CL.clean_identifier("i").alias("i"), CL.clean_numeric("n").alias("n"),
                  CL.clean_text("t").alias("t"), CL.parse_bool("b").alias("b")).first()
    assert r.i == "259222000" and abs(r.n - 223.899) < 1e-12 and r.t is None and r.b is True


def test_dst_hours(spark):
    # 2024-03-31 01:00 UTC is 03:00 local; 2024-10-27 00:00 and 01:00 UTC are both 02:00 local
    ts = [dt.datetime(2024, 3, 31, 1), dt.datetime(2024, 10, 27, 0), dt.datetime(2024, 10, 27, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "timestamp_utc timestamp_ntz")
    got = [r.hour_local for r in df.select(*calendar_columns("timestamp_utc")).collect()]
    assert got == [3, 2, 2]


def test_calendar_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12),)], "timestamp_utc timestamp_ntz")  # Monday
    r = df.select(*calendar_columns("timestamp_utc")).first()
    assert r.day_of_week == 0 and r.is_weekend == 0 and r.day_of_year == 1
    c = df.select(*calendar_columns("timestamp_utc")).select(*cyclical_columns()).first()
    assert abs(c.month_sin) < 1e-12 and abs(c.month_cos - 1) < 1e-12


def test_projection_north(spark):
    df = spark.createDataFrame([(60.0, 5.0, 10.0, 0.0, None)],
                               "latitude double, longitude double, sog double, cog double, heading double")
    lat, lon = G.project_position()
    r = df.select(lat.alias("a"), lon.alias("b")).first()
    assert abs(r.a - (60.0 + 5.0 / 60.0)) < 1e-3 and abs(r.b - 5.0) < 1e-9


def test_duration_negative_null(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 8))], "d timestamp_ntz, a timestamp_ntz")
    assert df.select(CL.duration_hours("d", "a").alias("h")).first().h is None
    assert df.select(CL.duration_hours("a", "d").alias("h")).first().h == 2.0
    _ = F


def test_exact_quantiles_bracket_path_equals_percentile(spark):
    """The bounded-memory path (forced with a small accuracy) equals ``percentile``."""
    from tidewater.operators.quantiles import exact_quantiles
    df = spark.range(0, 20000).select((F.col("id") % 3).alias("g"),
                                      ((F.col("id") * 7919) % 10007 / F.lit(7.0)).alias("v"))
    qs = [0.1, 0.5, 0.95]
    got = {r.g: (r.a, r.b, r.c) for r in exact_quantiles(df, ["g"], "v", qs, ["a", "b", "c"], accuracy=500).collect()}
    exp = {r.g: (r.a, r.b, r.c) for r in df.groupBy("g").agg(
        *[F.percentile("v", q).alias(n) for q, n in zip(qs, ["a", "b", "c"])]).collect()}
    assert got.keys() == exp.keys()
    for k in got:
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[k], exp[k]))


def test_rules_against_literal_cases(spark):
    """Literal cases of the display and cleaning rules."""
    import datetime as dt

    from tidewater.functions import clean as CL
    from tidewater.functions.timefeat import age_seconds
    from tidewater.operators import ingest as I
    from tidewater.operators import serve as V
    speeds = spark.createDataFrame([(3.0,), (7.0,), (20.0,), (None,)], "sog double")
    assert tuple(V.speed_counts(speeds).first()) == (4, 1, 1)
    t = dt.datetime(2024, 1, 1, 0, 0, 8, 600000)
    age = spark.createDataFrame([(t, dt.datetime(2024, 1, 1, 0, 0, 10))], "a timestamp_ntz, b timestamp_ntz")
    assert age.select(age_seconds("a", "b")).first()[0] == 1
    track = spark.createDataFrame([("1", t), ("1", t + dt.timedelta(seconds=90)), ("2", t)], "mmsi string, timestamp timestamp_ntz")
    assert {r.mmsi: r.duration_minutes for r in V.track_duration(track).collect()} == {"1": 2, "2": None}
    raw = spark.createDataFrame([("\t257000001\n",), ("257000001\n",), ("\u00a0 nan \t",), (" a b ",)], "x string")
    assert [r[0] for r in raw.select(CL.clean_identifier("x")).collect()][0] == "257000001"
    assert [r[0] for r in raw.select(CL.valid_digits("x", 9)).collect()] == [None] * 4
    assert [r[0] for r in raw.select(CL.strip("x")).collect()] == ["257000001", "257000001", "nan", "a b"]
    lines = ['{"mmsi": "1", "msgtime": "2024-01-01T00:00:00Z", "latitude": "62.45", "longitude": 6, "navigationalStatus": 5.0}',
             '{"mmsi": "1", "msgtime": "2024-01-01T00:00:00Z", "latitude": "abc", "longitude": 6}',
             '{"mmsi": "1", "msgtime": "2024-01-01T00:00:00Z", "latitude": 62, "longitude": 6, "navigationalStatus": 5.5}']
    got = I.decode_messages(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, offset long")).orderBy("offset").collect()
    assert (got[0].latitude, got[0].longitude, got[0].nav_status, got[0].reject_reason) == (62.45, 6.0, 5, None)
    assert [r.reject_reason for r in got[1:]] == ["decode", "decode"]


def test_exact_quantiles_ties_and_small_groups(spark):
    """Groups of 1 to 400 rows, one with a third of its rows equal, equal ``percentile`` on the same path."""
    from pyspark.sql import functions as F

    from tidewater.operators.quantiles import exact_quantiles
    rows = [(n, float((i * 37) % 101) if i % 3 else 50.0) for n in (1, 2, 3, 7, 40, 400) for i in range(n)]
    df = spark.createDataFrame(rows + [(9, None), (9, float("nan"))], "g int, v double")
    qs = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    names = [f"p{i}" for i in range(len(qs))]
    exp = {r[0]: tuple(r)[1:] for r in df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(*[F.percentile("v", q) for q in qs]).collect()}
    assert {r[0]: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", qs, names).collect()} == exp
    assert {r[0]: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", qs, names, accuracy=50).collect()} == exp


def test_messages_are_parsed_once(spark):
    """One parse a row, also under the filter on the reason."""
    from tidewater.operators import ingest as I
    raw = spark.createDataFrame([('{"mmsi": 257, "msgtime": "2024-01-01T00:00:00Z", "latitude": "62.4", "longitude": 6}', 1), ("[1]", 2), (None, 3)],
                                "value string, offset long")
    for df in (I.normalize_positions(raw), I.decode_messages(raw).where("reject_reason IS NULL").select("offset", "timestamp")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
        assert [r["offset"] for r in df.collect()] == [1]
    old = {r["offset"]: r["reject_reason"] for r in I.decode_messages(raw).collect()}
    assert old[1] is None and old[2] == "decode"
