"""Voyage files -> cleaned voyages -> study-area rows -> arrival / departure events.

(S1, S4, P3-P14, T1-T3, J8.)  Everything is row-local except two
aggregations: "keep first" de-duplication (``min_by`` over an explicit
file-order key, partially aggregated map-side) and the event de-duplication.
Both are asked only of rows that share their voyage id with another row
(``split_by_id``); all other rows stay where they are.
Study-area expansion is an ``explode`` of the (at most two) areas a voyage
touches — no cross join with an area table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import clean as CL
from ..functions.timefeat import floor_hour
from ..session import staged

# Voyage columns by kind, as the yearly files name them.
IDENTIFIER_COLUMNS = ["seilas_id", "skips_id", "imo_nummer", "mmsi_nummer", "avgangshavn_id",
                      "ankomsthavn_id"]
NUMERIC_COLUMNS = ["byggeaar", "bruttotonnasje_bt", "doedvekttonn_dwt", "lengde", "bredde",
                   "dypgaaende"]
TEXT_COLUMNS = ["kallesignal", "fartoynavn", "skipstype", "skipsgruppe", "flaggkode", "flaggstat",
                "farlig_last_hazmat", "avgangshavn_kode", "avgangshavn_navn", "land_avgang",
                "landkode_avgang_totegn", "fylkesnavn_avgang", "kommunenavn_avgang",
                "ankomsthavn_kode", "ankomsthavn_navn", "land_ankomst", "landkode_ankomst_totegn",
                "fylkesnavn_ankomst", "kommunenavn_ankomst"]
ORDER_COLUMNS = ["order_1", "order_2", "order_3", "order_4"]


# ---------------------------------------------------------------------------
# Raw delimited files (all text, one file per year)
# ---------------------------------------------------------------------------

def raw_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in C.RAW_VOYAGE_COLUMNS])


def _header(spark: SparkSession, path: str, sep: str | None, encoding: str) -> tuple[list[str], str]:
    """Column names of a file and its delimiter (the one of ``;``, ``,``, tab, ``|`` that splits the header most)."""
    line = spark.read.option("encoding", encoding).text(path).first()
    text = (line[0] if line else "").lstrip("\ufeff").rstrip("\r")
    sep = sep or max(";,\t|", key=text.count)
    return [c.strip().strip('"') for c in text.split(sep)], sep


def scan_voyage_files(spark: SparkSession, paths_by_year: dict[int | None, str], sep: str | None = None,
                      encoding: str = "ISO-8859-1", missing: str = "error") -> DataFrame:
    """Read yearly files as all-text rows with ``source_year`` and a file-order key.

    Columns are taken by name from each file's header, in any order; further columns are
    left out and a missing one raises.  The delimiter is detected unless ``sep`` is given.

    The order key is (file, split start, position in split) — monotone in the
    file's row order — so "keep first" rules stay deterministic when Spark
    splits a large file.  ``missing='skip'`` drops absent years (single-area
    form); ``'error'`` raises.
    """
    frames = []
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for year, path in sorted(paths_by_year.items(), key=lambda p: (p[0] is None, p[0] or 0)):
        p = jvm_fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            if missing == "skip":
                continue
            raise FileNotFoundError(path)
        names, found = _header(spark, path, sep, encoding)
        if absent := [c for c in C.RAW_VOYAGE_COLUMNS if c not in names]:
            raise ValueError(f"{path}: no column {', '.join(absent)}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        df = (spark.read.schema(schema).option("header", "true").option("sep", found).option("enforceSchema", "true")
              .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))
        frames.append(df.select(
            *C.RAW_VOYAGE_COLUMNS, F.lit(year).cast("int").alias("source_year"),
            F.col("_metadata.file_path").alias("order_1"),
            F.col("_metadata.file_block_start").alias("order_2"),
            F.monotonically_increasing_id().alias("order_3"),
            F.lit(None).cast("timestamp_ntz").alias("order_4")))
    if not frames:
        raise FileNotFoundError("no voyage files found")
    return union_years(frames)


def union_years(frames: list[DataFrame]) -> DataFrame:
    """Concatenate yearly tables by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------

def _cleaned(c: str) -> Column:
    """The cleaning expression of a voyage column, on the raw row (``byggeaar`` also reads ``source_year``)."""
    if c in IDENTIFIER_COLUMNS:
        e = CL.clean_identifier(c)
        if c == "mmsi_nummer":
            e = CL.valid_digits(e, 9)
        elif c == "imo_nummer":
            e = CL.valid_digits(e, 7)
    elif c in NUMERIC_COLUMNS:
        e = CL.clean_numeric(c)
        if c == "lengde":
            e = CL.in_range(e, *C.LENGTH_BOUNDS, low_inclusive=False)
        elif c == "bredde":
            e = CL.in_range(e, *C.BEAM_BOUNDS, low_inclusive=False)
        elif c == "dypgaaende":
            e = CL.in_range(e, *C.DRAUGHT_BOUNDS, low_inclusive=True)
        elif c == "byggeaar":
            e = F.when((e >= C.MIN_BUILD_YEAR) & (e <= F.col("source_year")), e)
    elif c in TEXT_COLUMNS:
        e = CL.clean_text(c)
    else:
        e = F.col(c)
    return e.alias(c)


def _derived() -> dict[str, Column]:
    """Times and duration, from the raw time texts."""
    dep = CL.parse_time("etd_estimert_avgangstidspunkt")
    arr = CL.parse_time("ankomsttidspunkt")
    return {"departure_time": dep.alias("departure_time"), "arrival_time": arr.alias("arrival_time"),
            "voyage_duration_hours": CL.duration_hours(dep, arr).alias("voyage_duration_hours")}


def clean_voyages(raw: DataFrame) -> DataFrame:
    """Typed, cleaned voyage rows (one per raw row)."""
    extra = [c for c in raw.columns if c not in C.RAW_VOYAGE_COLUMNS and c != "source_year"]
    d = _derived()
    return raw.select(*[_cleaned(c) for c in C.RAW_VOYAGE_COLUMNS], d["departure_time"], d["arrival_time"],
                      "source_year", d["voyage_duration_hours"], *extra)


def primary_period(df: DataFrame, first_year: int = 2024) -> DataFrame:
    """P10: flag (and keep) rows of the primary modelling period."""
    return df.withColumn("primary_ml_period", F.col("source_year") >= first_year)


# ---------------------------------------------------------------------------
# Study areas
# ---------------------------------------------------------------------------

def expand_study_areas(voyages: DataFrame, areas=None) -> DataFrame:
    """One row per (voyage, study area it departs from or arrives in, in Norway)."""
    areas = list(areas or C.STUDY_AREAS)
    dep_m, arr_m = F.col("kommunenavn_avgang"), F.col("kommunenavn_ankomst")
    # plain expressions (no lambda) keep the explode inside whole-stage codegen
    cand = F.array_distinct(F.array(F.when(dep_m.isin(*areas), dep_m), F.when(arr_m.isin(*areas), arr_m)))
    out = voyages.withColumn("study_area", F.explode(cand)).filter(F.col("study_area").isNotNull())
    dep_flag = CL.area_flag("kommunenavn_avgang", "landkode_avgang_totegn", F.col("study_area"))
    arr_flag = CL.area_flag("kommunenavn_ankomst", "landkode_ankomst_totegn", F.col("study_area"))
    return (out.withColumn("departure_in_study_area", dep_flag)
               .withColumn("arrival_in_study_area", arr_flag)
               .filter(F.col("departure_in_study_area") | F.col("arrival_in_study_area")))


def internal_voyages(expanded: DataFrame) -> DataFrame:
    """Voyages with both ends in the same area."""
    return expanded.filter(F.col("departure_in_study_area") & F.col("arrival_in_study_area"))


# ---------------------------------------------------------------------------
# Keep-first de-duplication
# ---------------------------------------------------------------------------

def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in an explicit order (null keys compare equal).

    ``min_by`` is a partial aggregate: each map task keeps one candidate per key
    before the shuffle, so a key holding a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
              .select(*[F.col(c) if c in keys else F.col(f"__r.{c}") for c in df.columns]))


def dedupe_voyages(expanded: DataFrame) -> DataFrame:
    """(study_area, seilas_id) within a year, then (source_year, study_area, seilas_id):
    both keep the first row in file order, so one pass over the finer key suffices."""
    return keep_first(expanded, ["source_year", "study_area", "seilas_id"], ORDER_COLUMNS)


KEY_COLUMNS = ["source_year", "study_area", "seilas_id"]
EVENT_INPUT_COLUMNS = ["skips_id", "mmsi_nummer", "skipstype", "skipsgruppe", "departure_time",
                       "arrival_time", "departure_in_study_area", "arrival_in_study_area"]


# What the expansion and the keep-first read: cleaned before, all else only for the rows that stay.
AREA_COLUMNS = ["kommunenavn_avgang", "kommunenavn_ankomst", "landkode_avgang_totegn", "landkode_ankomst_totegn"]
FLAG_COLUMNS = ["departure_in_study_area", "arrival_in_study_area"]
# Raw columns behind derived ones.
_SOURCES = {"departure_time": ["etd_estimert_avgangstidspunkt"], "arrival_time": ["ankomsttidspunkt"],
            "voyage_duration_hours": ["etd_estimert_avgangstidspunkt", "ankomsttidspunkt"]}


# Bits of a bitmap of Spark's bitmap functions, and the most of them that mark shared voyage ids (32 MB).
BITMAP_BITS = 32768
MOST_BITMAPS = 8192
# With fewer rows one exchange of all is quicker, as AQE would join the narrow rows that stay into a task or two.
LEAST_ROWS = 20_000_000


def split_by_id(raw: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """``raw`` as rows whose (cleaned) voyage id no other row has, and the rest.

    A first pass counts the rows of each id's hash, so nothing but hashes goes through its last exchange, and marks the
    hashes that several rows share in a bitmap of 16 bits for each, 32 MB at most.  Every row then finds its own bit where
    it is read.  Null ids, clashing hashes and clashing bits only add rows to the rest.  Of fewer than ``LEAST_ROWS`` rows
    all are the rest (and the first is None).
    """
    spark = raw.sparkSession
    # Cheap, since every row asks for its bit: equal clean ids have equal parts before the first comma or point.
    part = F.substring_index(F.translate(CL.strip("seilas_id"), ",", "."), ".", 1)
    hashed = F.xxhash64(F.when(~part.isin(*C.NULL_TOKENS), part))
    seen = Observation()
    counts = raw.select(hashed.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("rows"))
    shared = staged(counts.filter(F.col("n") > 1).select("h"), "shared-ids", free=True)
    if (seen.get["rows"] or 0) < LEAST_ROWS:
        return None, raw
    maps = min(MOST_BITMAPS, 1 << (16 * shared.count() // BITMAP_BITS).bit_length())
    bits = maps * BITMAP_BITS
    place = F.pmod("h", F.lit(bits))
    marked = (shared.select(F.floor(place / BITMAP_BITS).alias("map"), F.pmod(place, F.lit(BITMAP_BITS)).alias("bit"))
              .groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")))
    every = spark.range(maps).withColumnRenamed("id", "map").join(marked, "map", "left")
    joined = every.select("map", F.coalesce("bits", F.unhex(F.repeat(F.lit("00"), F.lit(BITMAP_BITS // 8)))).alias("bits")).agg(
        F.expr("listagg(bits) WITHIN GROUP (ORDER BY map)").alias("bits"))
    own = F.pmod(hashed, F.lit(bits))
    byte = F.substring(staged(joined, "shared-id-bits").scalar(), (F.floor(own / 8) + 1).cast("int"), F.lit(1))
    found = F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")), F.pmod(own, F.lit(8)).cast("int")) == 1
    return raw.filter(~found), raw.filter(found)


def _expanded(raw: DataFrame, areas, out: list[str], late: list[str], extra: list[str]) -> DataFrame:
    """Area rows with clean key and area columns; ``late`` columns still raw."""
    early = ["seilas_id", *AREA_COLUMNS]
    rows = raw.select(*[_cleaned(c) for c in early], *late, "source_year", *extra, *ORDER_COLUMNS)
    needed = [c for c in [*early, *extra, *FLAG_COLUMNS] if c in out]
    return expand_study_areas(rows, areas).select(*dict.fromkeys([*KEY_COLUMNS, *ORDER_COLUMNS, *needed, *late]))


def _prepared(raw: DataFrame, areas, columns: list[str] | None) -> tuple[DataFrame | None, DataFrame]:
    """The voyage table in two parts: voyages with an id of their own (None: not told apart), and the others."""
    extra = [c for c in raw.columns if c not in C.RAW_VOYAGE_COLUMNS and c not in ("source_year", *ORDER_COLUMNS)]
    out = list(dict.fromkeys(KEY_COLUMNS + ORDER_COLUMNS + list(columns))) if columns is not None else [
        *C.RAW_VOYAGE_COLUMNS, "departure_time", "arrival_time", "source_year", "voyage_duration_hours", *extra, *ORDER_COLUMNS,
        "study_area", *FLAG_COLUMNS]
    late = list(dict.fromkeys(r for c in out for r in _SOURCES.get(c, [c])
                              if r in C.RAW_VOYAGE_COLUMNS and r not in ("seilas_id", *AREA_COLUMNS)))
    derived = _derived()

    def finished(kept: DataFrame) -> DataFrame:
        return kept.select(*[derived[c] if c in derived else _cleaned(c) if c in late else F.col(c) for c in out])

    alone, sharing = split_by_id(raw)
    return (None if alone is None else finished(_expanded(alone, areas, out, late, extra)),
            finished(dedupe_voyages(_expanded(sharing, areas, out, late, extra))))


def prepare_voyages(raw: DataFrame, areas=None, columns: list[str] | None = None) -> DataFrame:
    """S1 output -> clean -> expand -> dedupe (the voyage table), as ``dedupe_voyages`` of the cleaned, expanded rows.

    A voyage whose id no other row has is the first of its key in each of its areas and goes through no exchange.  Of the
    others only the key and area columns are cleaned before the keep-first aggregate, the rest for the rows that stay.
    ``columns`` narrows the rows when a caller needs only some columns (the kept row is the same; less data is shuffled).
    """
    alone, sharing = _prepared(raw, areas, columns)
    return sharing if alone is None else alone.unionByName(sharing)


# ---------------------------------------------------------------------------
# events
# ---------------------------------------------------------------------------

EVENT_COLUMNS = ["study_area", "seilas_id", "vessel_key", "mmsi_nummer", "skipstype",
                 "skipsgruppe", "event_time", "event_type"]


def _event_rows(voyages: DataFrame, start, end) -> tuple[DataFrame, list[str]]:
    """Events in [start, end) before their de-duplication, and the order columns they carry."""
    v = voyages.withColumn("vessel_key", CL.vessel_key("mmsi_nummer", "skips_id"))
    sides = F.array(
        F.when(F.col("departure_in_study_area") & F.col("departure_time").isNotNull(),
               F.struct(F.lit("departure").alias("t"), F.col("departure_time").alias("ts"))),
        F.when(F.col("arrival_in_study_area") & F.col("arrival_time").isNotNull(),
               F.struct(F.lit("arrival").alias("t"), F.col("arrival_time").alias("ts"))))
    order = [c for c in ["source_year", *ORDER_COLUMNS] if c in voyages.columns]
    e = (v.select("study_area", "seilas_id", "vessel_key", "mmsi_nummer", "skipstype", "skipsgruppe",
                  *order, F.explode(sides).alias("__e"))
          .filter(F.col("__e").isNotNull())
          .select("study_area", "seilas_id", "vessel_key", "mmsi_nummer", "skipstype", "skipsgruppe",
                  F.col("__e.ts").alias("event_time"), F.col("__e.t").alias("event_type"), *order))
    lo = F.lit(str(start)).cast("timestamp_ntz")
    hi = F.lit(str(end)).cast("timestamp_ntz")
    return e.filter((F.col("event_time") >= lo) & (F.col("event_time") < hi)), order


def _finished_events(e: DataFrame) -> DataFrame:
    return e.select(*EVENT_COLUMNS).withColumn("hour_utc", floor_hour("event_time"))


def voyage_events(voyages: DataFrame, start=C.DATA_START, end=C.DATA_END) -> DataFrame:
    """Departure and arrival events per area (flag set, time present), inside
    [start, end), de-duplicated on (area, voyage, type, time)."""
    e, order = _event_rows(voyages, start, end)
    # Duplicates can only come from different yearly files: keep the earliest.
    e = keep_first(e, ["study_area", "seilas_id", "event_type", "event_time"], order) if order \
        else e.dropDuplicates(["study_area", "seilas_id", "event_type", "event_time"])
    return _finished_events(e)


def prepare_events(raw: DataFrame, start=C.DATA_START, end=C.DATA_END, areas=None) -> DataFrame:
    """``voyage_events`` of ``prepare_voyages``: a voyage with an id of its own has no event twice and passes both
    de-duplications without an exchange."""
    alone, sharing = _prepared(raw, areas, EVENT_INPUT_COLUMNS)
    events = voyage_events(sharing, start, end)
    return events if alone is None else _finished_events(_event_rows(alone, start, end)[0]).unionByName(events)
