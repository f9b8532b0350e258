"""Deterministic maritime views over the driver's tables.

The test tables hold no ships, so each view re-labels an existing table:
``events`` becomes AIS positions (A) and voyage events (B); ``lineitem`` and
its dimensions become raw voyage rows (C).  Every view is written twice, as a
DataFrame plan and as DuckDB SQL text, so oracle queries can start from the same
rows.  All work is row-local projections plus small dimension joins, so the views
scale with their source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .tables import read_table

# Region name -> municipality used for the voyage view.
REGION_MUNICIPALITY = {
    "AFRICA": "Bergen",
    "AMERICA": "Kristiansund",
    "ASIA": "Stavanger",
    "EUROPE": "Tromsø",
    "MIDDLE EAST": "Ålesund",
}
# user_id % 5 -> study area for the event view.
USER_AREA = ["Bergen", "Kristiansund", "Stavanger", "Tromsø", "Ålesund"]
# event_id % 7 -> skipsgruppe (index 6 = null).
EVENT_GROUP = ["Passasjer", "Last", "Fisk", "Tank", "Auxiliary", "Slep", None]
# Part type -> skipsgruppe.
PART_GROUP = {
    "PROMO": "Passasjer",
    "STANDARD": "Last",
    "SMALL": "Fisk",
    "LARGE": "Tank",
    "MEDIUM": "Auxiliary",
    "ECONOMY": "Slep",
}
# Fixed test windows of view B (UTC, end exclusive).
EVENTS_START = "2024-01-01 00:00:00"
EVENTS_END = "2024-01-31 00:00:00"
EVENTS_SPLIT = {"train": "2024-01-21 00:00:00", "validation": "2024-01-26 00:00:00",
                "test": "2024-01-31 00:00:00"}
REDELIVERY_OFFSET_SHIFT = 1_000_000_000_000


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(col == F.lit(key), F.lit(value)) if expr is None
                else expr.when(col == F.lit(key), F.lit(value)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _sql_case(col: str, mapping: dict) -> str:
    parts = " ".join(f"WHEN {_sql_lit(k)} THEN {_sql_lit(v)}" for k, v in mapping.items())
    return f"CASE {col} {parts} END"


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _pick(index: Column, values: list) -> Column:
    return _case(index, {i: v for i, v in enumerate(values) if v is not None})


# ---------------------------------------------------------------------------
# A. AIS positions from ``events``
# ---------------------------------------------------------------------------

def ais_positions(spark: SparkSession, sf_dir: str, redeliver: bool = False) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    offset = (F.expr("event_id div 64") * 64 + 63 - eid % 64).cast("bigint")
    out = ev.select(
        (F.lit(257000000) + F.col("user_id")).cast("string").alias("mmsi"),
        (F.lit(9000000) + F.col("user_id")).cast("string").alias("imo"),
        F.when(F.col("user_id") % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("VESSEL "), F.col("user_id").cast("string"))).alias("vessel_name"),
        (F.lit(62.401) + k * F.lit(0.002)).alias("latitude"),
        (F.lit(6.01) + (eid % 7) * F.lit(0.05)).alias("longitude"),
        (F.col("value") / F.lit(10.0)).alias("sog"),
        ((eid * 37) % 360).cast("double").alias("cog"),
        F.when(eid % 5 == 0, F.lit(None).cast("double"))
         .otherwise(((eid * 53) % 360).cast("double")).alias("heading"),
        (eid % 16).cast("int").alias("nav_status"),
        (F.lit(30) + (eid * 7) % 61).cast("int").alias("ship_type"),
        F.lit(None).cast("double").alias("rate_of_turn"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.lit(C.DEFAULT_SOURCE).alias("source"),
        offset.alias("offset"),
        eid.alias("event_id"),
    )
    if redeliver:
        again = out.filter(F.col("event_id") % 10 == 0).withColumn(
            "offset", F.col("offset") + F.lit(REDELIVERY_OFFSET_SHIFT))
        out = out.unionByName(again)
    return out


AIS_POSITIONS_SQL = f"""
SELECT CAST(257000000 + user_id AS VARCHAR) AS mmsi,
       CAST(9000000 + user_id AS VARCHAR) AS imo,
       CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'VESSEL ' || CAST(user_id AS VARCHAR) END AS vessel_name,
       62.401::DOUBLE + CAST(json_extract_string(props, '$.k') AS INTEGER) * 0.002::DOUBLE AS latitude,
       6.01::DOUBLE + (event_id % 7) * 0.05::DOUBLE AS longitude,
       value / 10.0::DOUBLE AS sog,
       CAST((event_id * 37) % 360 AS DOUBLE) AS cog,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 53) % 360 AS DOUBLE) END AS heading,
       CAST(event_id % 16 AS INTEGER) AS nav_status,
       CAST(30 + (event_id * 7) % 61 AS INTEGER) AS ship_type,
       CAST(NULL AS DOUBLE) AS rate_of_turn,
       CAST(ts AS TIMESTAMP) AS "timestamp",
       '{C.DEFAULT_SOURCE}' AS source,
       CAST((event_id // 64) * 64 + 63 - event_id % 64 AS BIGINT) AS "offset",
       event_id
FROM events
"""

AIS_POSITIONS_REDELIVERED_SQL = f"""
SELECT * FROM ({AIS_POSITIONS_SQL}) a
UNION ALL
SELECT * REPLACE ("offset" + {REDELIVERY_OFFSET_SHIFT} AS "offset")
FROM ({AIS_POSITIONS_SQL}) b WHERE event_id % 10 = 0
"""


# ---------------------------------------------------------------------------
# B. Voyage events (arrival / departure per study area) from ``events``
# ---------------------------------------------------------------------------

def traffic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    key = (F.lit(257000000) + F.col("user_id")).cast("string")
    return ev.select(
        _pick(F.col("user_id") % 5, USER_AREA).alias("study_area"),
        F.col("event_id").cast("string").alias("seilas_id"),
        key.alias("vessel_key"),
        key.alias("mmsi_nummer"),
        F.col("event_type").alias("skipstype"),
        _pick(F.col("event_id") % 7, EVENT_GROUP).alias("skipsgruppe"),
        F.col("ts").cast("timestamp_ntz").alias("event_time"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("arrival"))
         .otherwise(F.lit("departure")).alias("event_type"),
    )


def _sql_pick(expr: str, values: list) -> str:
    return _sql_case(expr, {i: v for i, v in enumerate(values) if v is not None})


TRAFFIC_EVENTS_SQL = f"""
SELECT {_sql_pick('user_id % 5', USER_AREA)} AS study_area,
       CAST(event_id AS VARCHAR) AS seilas_id,
       CAST(257000000 + user_id AS VARCHAR) AS vessel_key,
       CAST(257000000 + user_id AS VARCHAR) AS mmsi_nummer,
       event_type AS skipstype,
       {_sql_pick('event_id % 7', EVENT_GROUP)} AS skipsgruppe,
       CAST(ts AS TIMESTAMP) AS event_time,
       CASE WHEN event_type IN ('click', 'view') THEN 'arrival' ELSE 'departure' END AS event_type
FROM events
"""


# ---------------------------------------------------------------------------
# C. Raw voyage rows (33 text columns) from lineitem and its dimensions
# ---------------------------------------------------------------------------

def _nation_side(spark, sf_dir, prefix: str) -> DataFrame:
    """nation + region -> municipality, county, country code for one voyage end."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    nk = F.col("n_nationkey")
    code = (F.when(nk == 7, F.lit(None).cast("string"))
             .when(nk % 5 == 0, F.lit("SE")).otherwise(F.lit("NO")))
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select(nk.alias(f"{prefix}_nationkey"),
                    F.col("n_name").alias(f"{prefix}_nation_name"),
                    F.col("r_name").alias(f"{prefix}_county"),
                    _case(F.col("r_name"), REGION_MUNICIPALITY).alias(f"{prefix}_municipality"),
                    code.alias(f"{prefix}_country_code")))


def voyages_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw voyage rows with all 33 columns as text plus ``source_year`` and the
    file-order key (``order_1..order_4``) that "keep first" rules follow.

    ``nation``/``region`` are 25/5-row dimensions (fixed by the TPC-H shape), so
    broadcasting them is bounded; customer/supplier/part/orders are joined by
    key and left to the planner (AQE picks broadcast only when small).  What
    belongs to an order is joined to it before the lines are, so that lines go
    through no exchange by customer.
    """
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    dep = _nation_side(spark, sf_dir, "dep")
    arr = _nation_side(spark, sf_dir, "arr")

    ordered = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey"))
    j = (li.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(part, F.col("l_partkey") == F.col("p_partkey"))
         .join(F.broadcast(dep), F.col("c_nationkey") == F.col("dep_nationkey"))
         .join(F.broadcast(arr), F.col("s_nationkey") == F.col("arr_nationkey")))

    s = lambda c: F.col(c).cast("string")
    departure = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("l_partkey") % 24).cast("int"))
    arrival = F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_suppkey") % 24).cast("int"))
    pk10 = F.col("l_partkey") % 10
    mmsi = (F.lit(257000000) + F.col("l_suppkey")).cast("string")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return j.select(
        F.concat(s("l_orderkey"), F.lit("-"), s("l_linenumber")).alias("seilas_id"),
        s("l_suppkey").alias("skips_id"),
        F.when(F.col("l_suppkey") % 9 == 0, s("l_suppkey"))
         .otherwise((F.lit(9000000) + F.col("l_suppkey")).cast("string")).alias("imo_nummer"),
        F.when(pk10 == 0, F.concat(mmsi, F.lit(",0")))
         .when(pk10 == 1, F.lit("nan"))
         .when(pk10 == 2, F.lit("12345"))
         .otherwise(mmsi).alias("mmsi_nummer"),
        F.concat(F.lit("LA"), s("l_suppkey")).alias("kallesignal"),
        F.col("s_name").alias("fartoynavn"),
        (F.lit(1700) + F.col("l_partkey") % 330).cast("string").alias("byggeaar"),
        (F.col("p_size") * 100).cast("string").alias("bruttotonnasje_bt"),
        (F.col("p_size") * 250).cast("string").alias("doedvekttonn_dwt"),
        F.concat((F.col("l_quantity") * 12).cast("bigint").cast("string"), F.lit(","),
                 (F.col("l_linenumber") % 10).cast("string")).alias("lengde"),
        (F.col("l_quantity") * 3).cast("bigint").cast("string").alias("bredde"),
        (F.col("l_linenumber") * 5).cast("string").alias("dypgaaende"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("skipstype"),
        _case(F.col("p_type"), PART_GROUP).alias("skipsgruppe"),
        F.lit("NOR").alias("flaggkode"),
        F.col("arr_nation_name").alias("flaggstat"),
        F.when(F.col("l_returnflag") == "R", F.lit("Yes"))
         .when(F.col("l_returnflag") == "A", F.lit(" 1"))
         .otherwise(F.lit("no")).alias("farlig_last_hazmat"),
        s("c_nationkey").alias("avgangshavn_id"),
        F.concat(F.lit("P"), s("c_nationkey")).alias("avgangshavn_kode"),
        F.concat(F.lit("Port "), F.col("dep_nation_name")).alias("avgangshavn_navn"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit("not a time"))
         .otherwise(F.date_format(departure, fmt)).alias("etd_estimert_avgangstidspunkt"),
        F.col("dep_nation_name").alias("land_avgang"),
        F.col("dep_country_code").alias("landkode_avgang_totegn"),
        F.col("dep_county").alias("fylkesnavn_avgang"),
        F.col("dep_municipality").alias("kommunenavn_avgang"),
        s("s_nationkey").alias("ankomsthavn_id"),
        F.concat(F.lit("P"), s("s_nationkey")).alias("ankomsthavn_kode"),
        F.concat(F.lit("Port "), F.col("arr_nation_name")).alias("ankomsthavn_navn"),
        F.date_format(arrival, fmt).alias("ankomsttidspunkt"),
        F.col("arr_nation_name").alias("land_ankomst"),
        F.col("arr_country_code").alias("landkode_ankomst_totegn"),
        F.col("arr_county").alias("fylkesnavn_ankomst"),
        F.col("arr_municipality").alias("kommunenavn_ankomst"),
        F.year("o_orderdate").cast("int").alias("source_year"),
        F.col("l_partkey").alias("order_1"),
        F.col("l_suppkey").alias("order_2"),
        F.col("l_extendedprice").alias("order_3"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("order_4"),
    )


def _sql_nation_side(prefix: str) -> str:
    return f"""(SELECT n_nationkey AS {prefix}_nationkey, n_name AS {prefix}_nation_name,
        r_name AS {prefix}_county,
        {_sql_case('r_name', REGION_MUNICIPALITY)} AS {prefix}_municipality,
        CASE WHEN n_nationkey = 7 THEN NULL WHEN n_nationkey % 5 = 0 THEN 'SE' ELSE 'NO' END
          AS {prefix}_country_code
     FROM nation JOIN region ON n_regionkey = r_regionkey)"""


_FMT = "'%Y-%m-%d %H:%M:%S'"
VOYAGES_RAW_SQL = f"""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS seilas_id,
       CAST(l_suppkey AS VARCHAR) AS skips_id,
       CASE WHEN l_suppkey % 9 = 0 THEN CAST(l_suppkey AS VARCHAR)
            ELSE CAST(9000000 + l_suppkey AS VARCHAR) END AS imo_nummer,
       CASE WHEN l_partkey % 10 = 0 THEN CAST(257000000 + l_suppkey AS VARCHAR) || ',0'
            WHEN l_partkey % 10 = 1 THEN 'nan'
            WHEN l_partkey % 10 = 2 THEN '12345'
            ELSE CAST(257000000 + l_suppkey AS VARCHAR) END AS mmsi_nummer,
       'LA' || CAST(l_suppkey AS VARCHAR) AS kallesignal,
       s_name AS fartoynavn,
       CAST(1700 + l_partkey % 330 AS VARCHAR) AS byggeaar,
       CAST(p_size * 100 AS VARCHAR) AS bruttotonnasje_bt,
       CAST(p_size * 250 AS VARCHAR) AS doedvekttonn_dwt,
       CAST(CAST(l_quantity * 12 AS BIGINT) AS VARCHAR) || ',' || CAST(l_linenumber % 10 AS VARCHAR) AS lengde,
       CAST(CAST(l_quantity * 3 AS BIGINT) AS VARCHAR) AS bredde,
       CAST(l_linenumber * 5 AS VARCHAR) AS dypgaaende,
       p_type || ' ' || p_brand AS skipstype,
       {_sql_case('p_type', PART_GROUP)} AS skipsgruppe,
       'NOR' AS flaggkode,
       arr_nation_name AS flaggstat,
       CASE WHEN l_returnflag = 'R' THEN 'Yes' WHEN l_returnflag = 'A' THEN ' 1' ELSE 'no' END AS farlig_last_hazmat,
       CAST(c_nationkey AS VARCHAR) AS avgangshavn_id,
       'P' || CAST(c_nationkey AS VARCHAR) AS avgangshavn_kode,
       'Port ' || dep_nation_name AS avgangshavn_navn,
       CASE WHEN l_orderkey % 97 = 0 THEN 'not a time'
            ELSE strftime(o_orderdate + to_hours(CAST(l_partkey % 24 AS INTEGER)), {_FMT}) END
         AS etd_estimert_avgangstidspunkt,
       dep_nation_name AS land_avgang,
       dep_country_code AS landkode_avgang_totegn,
       dep_county AS fylkesnavn_avgang,
       dep_municipality AS kommunenavn_avgang,
       CAST(s_nationkey AS VARCHAR) AS ankomsthavn_id,
       'P' || CAST(s_nationkey AS VARCHAR) AS ankomsthavn_kode,
       'Port ' || arr_nation_name AS ankomsthavn_navn,
       strftime(l_shipdate + to_hours(CAST(l_suppkey % 24 AS INTEGER)), {_FMT}) AS ankomsttidspunkt,
       arr_nation_name AS land_ankomst,
       arr_country_code AS landkode_ankomst_totegn,
       arr_county AS fylkesnavn_ankomst,
       arr_municipality AS kommunenavn_ankomst,
       CAST(year(o_orderdate) AS INTEGER) AS source_year,
       l_partkey AS order_1, l_suppkey AS order_2, l_extendedprice AS order_3,
       CAST(l_shipdate AS TIMESTAMP) AS order_4
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey
JOIN {_sql_nation_side('dep')} d ON c_nationkey = dep_nationkey
JOIN {_sql_nation_side('arr')} a ON s_nationkey = arr_nationkey
"""


# ---------------------------------------------------------------------------
# A'. Raw AIS messages (NDJSON text lines) derived from view A
# ---------------------------------------------------------------------------

def raw_ais_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text line per position, in the provider's camelCase layout.

    Message time comes in three spellings (``Z``, ``+01:00`` local, no zone);
    a deterministic share of lines is broken: bad JSON, a JSON array, a
    blank line, a missing latitude, an unparsable time.
    """
    p = ais_positions(spark, sf_dir)
    eid = F.col("event_id")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ts = F.col("timestamp").cast("timestamp")
    msgtime = (F.when(eid % 50 == 0, F.lit("not-a-time"))
                .when(eid % 3 == 0, F.concat(F.date_format(ts, iso), F.lit("Z")))
                .when(eid % 3 == 1, F.concat(F.date_format(ts + F.expr("INTERVAL 1 HOUR"), iso),
                                             F.lit("+01:00")))
                .otherwise(F.date_format(ts, iso)))
    body = F.to_json(F.struct(
        F.col("mmsi").cast("bigint").alias("mmsi"),
        msgtime.alias("msgtime"),
        F.when(eid % 97 != 0, F.col("latitude")).alias("latitude"),
        F.col("longitude").alias("longitude"),
        F.col("vessel_name").alias("name"),
        F.col("sog").alias("speedOverGround"),
        F.col("cog").alias("courseOverGround"),
        F.col("heading").alias("trueHeading"),
        F.col("nav_status").alias("navigationalStatus"),
        F.col("ship_type").alias("shipType"),
        F.col("rate_of_turn").alias("rateOfTurn")))
    value = (F.when(eid % 89 == 0, F.lit("garbage{"))
              .when(eid % 83 == 0, F.lit("[1, 2]"))
              .when(eid % 79 == 0, F.lit(""))
              .otherwise(body))
    return p.select(value.alias("value"), F.col("offset"), eid.alias("event_id"))
