"""S1 yearly CSV scan (latin-1, all text, missing file rule), S13 / S14 writers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater import config as C
from tidewater.operators import features as FT
from tidewater.operators import sinks as SK
from tidewater.operators import voyage as VY
from tidewater.plans import model as M
from tidewater.sources import adapters as A

SF001 = "/root/testdata/sf0.001"


def _write_year_csv(spark, path, year):
    raw = A.voyages_raw(spark, SF001).filter(F.col("source_year") == year)
    rows = raw.orderBy("order_1", "order_2", "order_3", "order_4").select(*C.RAW_VOYAGE_COLUMNS).collect()
    with open(path, "w", encoding="latin-1") as f:
        f.write(";".join(C.RAW_VOYAGE_COLUMNS) + "\n")
        for r in rows:
            f.write(";".join("" if v is None else v for v in r) + "\n")
    return len(rows)


def test_scan_voyage_files(spark, scratch):
    n96 = _write_year_csv(spark, os.path.join(scratch, "v1996.csv"), 1996)
    n97 = _write_year_csv(spark, os.path.join(scratch, "v1997.csv"), 1997)
    df = VY.scan_voyage_files(spark, {1996: os.path.join(scratch, "v1996.csv"),
                                      1997: os.path.join(scratch, "v1997.csv")})
    assert df.count() == n96 + n97
    assert df.filter(F.col("source_year") == 1996).count() == n96
    assert all(t == "string" for _, t in df.select(*C.RAW_VOYAGE_COLUMNS).dtypes)
    assert "Tromsø" in {r[0] for r in df.select("kommunenavn_avgang").distinct().collect()}
    voyages = VY.prepare_voyages(df)
    assert voyages.count() > 0
    with pytest.raises(FileNotFoundError):
        VY.scan_voyage_files(spark, {1995: os.path.join(scratch, "missing.csv")})
    skipped = VY.scan_voyage_files(spark, {1995: os.path.join(scratch, "missing.csv"),
                                           1996: os.path.join(scratch, "v1996.csv")}, missing="skip")
    assert skipped.count() == n96


def test_write_table_and_metadata(spark, scratch):
    table = M.model_rows(spark, SF001)
    SK.write_table(table, os.path.join(scratch, "model"), ["study_area"], ["timestamp_utc"])
    back = spark.read.parquet(os.path.join(scratch, "model"))
    assert back.count() == table.count()
    SK.write_table(table.limit(10), os.path.join(scratch, "model_csv"), fmt="csv")
    thr = FT.area_thresholds(M.complete_rows(spark, SF001))
    SK.write_metadata(table, thr, os.path.join(scratch, "meta"))
    files = [f for f in os.listdir(os.path.join(scratch, "meta")) if f.endswith(".json")]
    meta = json.loads(open(os.path.join(scratch, "meta", files[0])).readline())
    assert meta["target"] == C.TARGET_COLUMN and len(meta["numeric_features"]) == 44
    assert set(meta["thresholds"]) <= set(C.STUDY_AREAS)
    assert sum(v["rows"] for v in meta["splits"].values()) == table.count()


def test_voyage_files_by_name_and_delimiter(spark, scratch):
    """Reversed columns with one more, and a comma file, read alike; a missing column raises."""
    import pytest

    from tidewater import config as C
    from tidewater.operators import voyage as VY
    cols = list(C.RAW_VOYAGE_COLUMNS)
    one, two, bad = (os.path.join(scratch, f"v{i}.csv") for i in range(3))
    with open(one, "w", encoding="latin-1") as f:
        f.write(";".join(["extra", *reversed(cols)]) + "\n" + ";".join(["e", *(f"v_{c}" for c in reversed(cols))]) + "\n")
    with open(two, "w", encoding="latin-1") as f:
        f.write(",".join(cols) + "\n" + ",".join(f"v_{c}" for c in cols) + "\n")
    with open(bad, "w", encoding="latin-1") as f:
        f.write(";".join(cols[1:]) + "\n")
    for path in (one, two):
        r = VY.scan_voyage_files(spark, {1996: path}).first()
        assert [r[c] for c in cols] == [f"v_{c}" for c in cols]
    with pytest.raises(ValueError):
        VY.scan_voyage_files(spark, {1996: bad})


ORDER_KEYS = ["area", "at", "id"]


def _unsorted(spark):
    rows = [(None if i % 11 == 0 else f"a{i * 7 % 3}", None if i % 13 == 0 else i * 37 % 50, i // 2) for i in range(400)]
    rows += [("a1", 5, 1)] * 200                          # one key holds a third of all rows
    return rows, spark.createDataFrame(rows, "area string, at int, id int")


def _nulls_last(r):
    return [(x is None, 0 if x is None else x) for x in r]


def test_sorted_files_follow_one_another(spark, scratch):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tidewater.operators.sinks import write_sorted
    rows, df = _unsorted(spark)
    write_sorted(df, f"{scratch}/sorted", [F.asc_nulls_last(c) for c in ORDER_KEYS], files=6)
    files = sorted(glob.glob(f"{scratch}/sorted/part-*"))
    got = [tuple(r[c] for c in ORDER_KEYS) for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 2
    assert got == sorted(rows, key=_nulls_last)


def test_position_is_the_place_in_the_whole_order(spark):
    from pyspark.sql import functions as F

    from tidewater.operators.sinks import with_position
    rows, df = _unsorted(spark)
    got = with_position(df, [F.col("area"), F.floor(F.col("at") / 10)], [F.asc_nulls_last("at"), F.asc_nulls_last("id")])
    assert got.columns == [*ORDER_KEYS, "position"]
    want = sorted(rows, key=_nulls_last)
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got.collect()) == list(range(1, len(rows) + 1))
    assert with_position(df.limit(0), [F.col("area")], [F.asc_nulls_last("id")]).collect() == []


def test_scan_voyages_writes_each_row_once_where_it_is(spark, monkeypatch, tmp_path):
    """Compressed files without an exchange; rows are read once; a null year is a year of its own."""
    import tidewater.config as C
    import tidewater.session as session
    from tidewater.plans import voyage as V
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def raw(s, sf):
        rows = [(y, *[f"{c}{i}; ø" for c in C.RAW_VOYAGE_COLUMNS]) for i, y in enumerate([1996, 1997, 1996, None])]
        df = s.createDataFrame(rows, "source_year int, " + ", ".join(f"{c} string" for c in C.RAW_VOYAGE_COLUMNS))
        return df.mapInArrow(counted, df.schema)

    monkeypatch.setattr(V, "raw", raw)
    monkeypatch.setattr(session, "scratch_table_path", lambda s, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, V.scan_voyages(spark, "unused").collect()), key=str)
    assert read.value == 4
    assert got == sorted(map(tuple, raw(spark, "unused").collect()), key=str)
    assert {p.suffix for p in tmp_path.rglob("part-*")} == {".gz"}
