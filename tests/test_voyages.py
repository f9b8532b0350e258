"""Voyage table and events: rows with an id of their own pass the de-duplications without an exchange."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import config as C
from tidewater.operators import voyage as VY

SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in C.RAW_VOYAGE_COLUMNS], T.StructField("source_year", T.IntegerType()),
                       T.StructField("order_1", T.LongType()), T.StructField("order_2", T.LongType()), T.StructField("order_3", T.LongType()),
                       T.StructField("order_4", T.TimestampNTZType())])


def raw_rows(spark, ids, seed=3):
    """A raw voyage for each id, in two years, between random places."""
    rnd, rows = random.Random(seed), []
    for n, i in enumerate(ids):
        r = dict.fromkeys(C.RAW_VOYAGE_COLUMNS, "x")
        r |= {"seilas_id": i, "kommunenavn_avgang": rnd.choice([*C.STUDY_AREAS, "Oslo", None]), "kommunenavn_ankomst": rnd.choice([*C.STUDY_AREAS, " Bergen "]),
              "landkode_avgang_totegn": rnd.choice(["NO", "SE"]), "landkode_ankomst_totegn": "NO", "lengde": f"{n},5", "mmsi_nummer": rnd.choice(["257000001", "nan"]),
              "etd_estimert_avgangstidspunkt": f"2020-03-0{rnd.randint(1, 3)} 10:00:00", "ankomsttidspunkt": rnd.choice(["2020-03-04 11:30:00", "never"])}
        rows.append((*[r[c] for c in C.RAW_VOYAGE_COLUMNS], rnd.choice([2020, 2021, None]), n, rnd.randint(0, 5), None, dt.datetime(2020, 1, 1)))
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "nan", " nan", "nan.0", "None", "<NA>", "12", "12,0", "12.0", " 12", "12\t", "12.5", "12,5", "12.00", "x ", "x", ".0", ",0", "0"]


def listed(df):
    return sorted(map(repr, df.collect()))


def test_same_rows_as_one_keep_first_over_all(spark, monkeypatch):
    for seed, least in ((1, 0), (2, 0), (2, 1000)):
        monkeypatch.setattr(VY, "LEAST_ROWS", least)
        rnd = random.Random(seed)
        raw = raw_rows(spark, [*ODD, *ODD, *[f"v{rnd.randint(0, 300)}" for _ in range(200)]], seed).cache()
        want = VY.dedupe_voyages(VY.expand_study_areas(VY.clean_voyages(raw)))
        got = VY.prepare_voyages(raw)
        assert listed(got.select(*sorted(got.columns))) == listed(want.select(*sorted(want.columns)))
        span = ("2020-03-01 00:00:00", "2020-03-04 11:00:00")
        assert listed(VY.prepare_events(raw, *span)) == listed(VY.voyage_events(want, *span))
        assert listed(VY.prepare_events(raw)) == listed(VY.voyage_events(want))
    monkeypatch.setattr(VY, "LEAST_ROWS", 0)
    none = raw.limit(0)
    assert VY.prepare_voyages(none).count() == VY.prepare_events(none).count() == 0


def test_only_rows_that_share_an_id_are_exchanged(spark, monkeypatch):
    monkeypatch.setattr(VY, "LEAST_ROWS", 0)
    raw = raw_rows(spark, [*ODD, *[f"own-{i}" for i in range(500)], *["twice"] * 3]).repartition(5).cache()
    alone, sharing = VY.split_by_id(raw)
    clean = lambda df: [r[0] for r in df.select(VY.CL.clean_identifier("seilas_id")).collect()]
    own, rest = clean(alone), clean(sharing)
    assert len(own) + len(rest) == raw.count() and len(set(own)) == len(own) and not set(own) & set(rest)
    assert None not in own and rest.count("twice") == 3
    assert sum(str(i).startswith("own-") for i in rest) < 50        # bits may clash
    for table in (VY.prepare_voyages(raw), VY.prepare_events(raw, "2020-01-01", "2021-01-01")):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        first, second = plan.index("min_by") if "min_by" in plan else -1, plan.index("Union")
        assert first > second >= 0
        assert plan.count("NOT (getbit") == 1       # the branch without an aggregate


def test_exchange_files_of_a_staged_table_are_freed(spark):
    from tidewater.session import FREE_EXCHANGES, staged
    before = spark.conf.get(FREE_EXCHANGES, None)
    rows = staged(spark.range(50).groupBy((F.col("id") % 7).alias("k")).count(), "freed", free=True)
    assert rows.count() == rows.count() == 7 and spark.conf.get(FREE_EXCHANGES, None) == before
