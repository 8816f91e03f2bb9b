"""Gridded and control tables projected from the star-schema tables.

The events become a 6 x 8 grid of fields every six hours (or hour), line items messages of
files, parts cache entries, and so on; each function has a SQL twin in SQL, a chain of common
table expressions, from which oracles are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import epoch_seconds, from_epoch

#: Seconds since 1970 of 2024-01-31T12:00, the moment that all reports take as now.
NOW = 1706702400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts and groups.
ROWS_A_TASK = 400_000


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of a stored table by key, in tasks whose size does not depend on the table's.

    Left to itself, adaptive execution merges partitions to one for each core, whose sorts and groups then grow with the table.
    Tables that are small enough for that are left to it. Rows are counted in the files' footers.
    """
    tasks = -(-rows.count() // ROWS_A_TASK)
    return rows.repartition(tasks, *key) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows


def grid(spark: SparkSession, sf_dir: str, step: int = 21600, lift: float = 0.0) -> DataFrame:
    """time, lat_i, lon_i, lat, lon, v: the largest value of a node's events in a step; NaN is a gap."""
    events = table(spark, sf_dir, "events")
    key = F.floor(epoch_seconds(F.col("ts")) / step).cast("long").alias("step")
    cells = events.groupBy(key, (F.col("event_id") % 48).cast("int").alias("node")).agg(F.max("value").alias("v"), F.max("event_id").alias("e"))
    lat_i, lon_i = F.floor(F.col("node") / 8).cast("int"), F.col("node") % 8
    v = F.when(F.col("e") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("v") + lift)
    rows = cells.select(from_epoch(F.col("step") * step).alias("time"), lat_i.alias("lat_i"), lon_i.alias("lon_i"), v.alias("v"))
    return rows.withColumns({"lat": (90 - 36 * F.col("lat_i")).cast("double"), "lon": (-180 + 45 * F.col("lon_i")).cast("double")})


#: Variable -> value made of a cell's v.
FORMULAS = {
    "2t": lambda v: 270 + v / 10,
    "10u": lambda v: v / 20 - 2,
    "10v": lambda v: 3 - v / 25,
    "msl": lambda v: 101325 + 10 * (v - 50),
    "tp_1h": lambda v: v / 100000,
    "tcc": lambda v: F.when(F.isnan(v), v).otherwise(F.least(v / 500, F.lit(1.0))),
    "2d": lambda v: 265 + v / 10,
    "i10fg": lambda v: v / 10,
}


def field(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """Long canonical rows: variable, time, lat_i, lon_i, lat, lon, value (float)."""
    cells = grid(spark, sf_dir, 3600, 1.0) if hourly else grid(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("variable"), f(F.col("v")).cast("float").alias("value")) for k, f in FORMULAS.items()]))
    return cells.select("time", "lat_i", "lon_i", "lat", "lon", pairs.alias("x")).select("x.variable", "time", "lat_i", "lon_i", "lat", "lon", "x.value")


#: Levels of the archive: the contract's, and some that a reader leaves out.
ARCHIVE_LEVELS = (10, 50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 775, 800, 850, 875, 925, 1000)


def level_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows of two level fields: variable, level, time, lat_i, lon_i, lat, lon, value (float), on the archive's levels."""
    cells = grid(spark, sf_dir).withColumn("level", F.explode(F.array(*map(F.lit, ARCHIVE_LEVELS))))
    values = {"t": 180 + F.col("level") / 10 + F.col("v") / 20, "z": 100 * (1000 - F.col("level")) + F.col("v")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("variable"), v.cast("float").alias("value")) for k, v in values.items()]))
    rows = cells.select("level", "time", "lat_i", "lon_i", "lat", "lon", pairs.alias("x"))
    return rows.select("x.variable", "level", "time", "lat_i", "lon_i", "lat", "lon", "x.value")


def point_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, vars, units."""
    rows = table(spark, sf_dir, "customer")
    fields = {"AUTOMOBILE": "t2m,wind,msl", "BUILDING": "2t", "FURNITURE": " msl, 10u,,msl", "HOUSEHOLD": "wind,d2m", "MACHINERY": "tcc,tp_1h"}
    asked = F.lit("2t")
    for k, v in fields.items():
        asked = F.when(F.col("c_mktsegment") == k, v).otherwise(asked)
    key = F.col("c_custkey")
    units = F.when(key % 2 == 0, "human").otherwise("si")
    return rows.select(key.alias("id"), (9 * key % 181 - 90).cast("double").alias("lat"), (13 * key % 360 - 180).cast("double").alias("lon"), asked.alias("vars"), units.alias("units"))


def grid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, bbox, variable, at (seconds), stride: boxes of all shapes, some backwards or empty."""
    rows = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    south = (k * 17 % 150 - 90).cast("int")
    north = F.when(k % 7 == 3, south - 10).otherwise(F.least(south + 20 + k * 5 % 90, F.lit(90))).cast("int")
    west = (k * 29 % 300 - 180).cast("int")
    east = F.least(west + 30 + k * 11 % 140, F.lit(180)).cast("int")
    text = F.concat_ws(",", south, west, north, east)
    bbox = F.when(k % 11 == 5, F.concat(text, F.lit(",1"))).when(k % 11 == 6, F.lit("a,b,c,d")).otherwise(text)
    variable = F.element_at(F.array(*map(F.lit, ("2t", "msl", "10u", "tcc"))), (k % 4 + 1).cast("int"))
    return rows.select(k.alias("id"), bbox.alias("bbox"), variable.alias("variable"), (F.lit(1704067200) + k * 39600 % 3000000).alias("at"), (1 + k % 3).cast("int").alias("stride"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, n, offset, length, param, level: the messages of a file by their place."""
    from pyspark.sql import Window

    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    length = (1000 * F.col("l_quantity")).cast("long")
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(order).alias("n"), length.alias("length"), F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    return rows.select(
        F.col("l_orderkey").alias("file"), "n", (F.col("upto") - F.col("length")).alias("offset"), "length", (F.col("l_partkey") % 6).cast("int").alias("param"), (F.col("l_suppkey") % 14).cast("int").alias("level")
    )


def cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, source_version, bytes, last_access, access_count, cost_ms, pinned."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", F.lit("era5"), F.col("p_type"), p.cast("string")).alias("key"),
        F.when(p % 3 == 0, "era5-final").otherwise("era5t").alias("source_version"),
        F.round(1000 * F.col("p_retailprice")).cast("long").alias("bytes"),
        (1706659200 - 600 * p).cast("long").alias("last_access"),
        (p % 5).cast("long").alias("access_count"),
        F.when(F.col("p_size") % 2 == 0, 200).otherwise(60000).cast("long").alias("cost_ms"),
        (F.col("p_size") % 10 == 0).alias("pinned"),
    )


def absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, reason, since, until: refusals that are remembered."""
    s = F.col("s_suppkey")
    since = F.lit(NOW) - 3600 * (s % 12)
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("era5/x/"), s.cast("string")).alias("key"), F.when(s % 2 == 0, "not_yet").otherwise("gone").alias("reason"), since.cast("long").alias("since"), (since + 21600).cast("long").alias("until")
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (timestamp), at (seconds), endpoint, area (null for some), hit, latency_ms."""
    return query_log_of(table(spark, sf_dir, "events"))


def query_log_of(events: DataFrame) -> DataFrame:
    """query_log of a table or a stream of events."""
    kind = F.col("event_type")
    endpoint = F.when(kind == "click", "forecast/point").when(kind == "view", "forecast/grid").when(kind == "purchase", "history/point").when(kind == "error", "history/grid").otherwise("coverage")
    return events.select(
        "event_id",
        "ts",
        epoch_seconds(F.col("ts")).alias("at"),
        endpoint.alias("endpoint"),
        F.when(kind != "signup", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("area"),
        (F.col("value") < 30).alias("hit"),
        F.floor(10 * F.col("value")).cast("long").alias("latency_ms"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """init (seconds), status: one run for each start, by the least status of its orders."""
    o = F.col("o_orderkey")
    day = epoch_seconds(F.date_trunc("DAY", F.col("o_orderdate")).cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").groupBy((day + 21600 * (o % 4)).cast("long").alias("init")).agg(F.min("o_orderstatus").alias("status"), F.count("*").alias("n"), F.max(o).alias("last_order"))


SQL = {
    "fx_grid": """fx_grid AS (SELECT make_timestamp((step * 21600 * 1000000)::BIGINT) AS time, (node // 8)::INT AS lat_i, (node % 8)::INT AS lon_i,
        (90 - 36 * (node // 8))::DOUBLE AS lat, (-180 + 45 * (node % 8))::DOUBLE AS lon, CASE WHEN e % 97 = 0 THEN 'NaN'::DOUBLE ELSE v END AS v
        FROM (SELECT floor(epoch_us(ts) / 1000000.0 / 21600)::BIGINT AS step, event_id % 48 AS node, max(value) AS v, max(event_id) AS e FROM events GROUP BY 1, 2))""",
    "fx_hour": """fx_hour AS (SELECT make_timestamp((step * 3600 * 1000000)::BIGINT) AS time, (node // 8)::INT AS lat_i, (node % 8)::INT AS lon_i,
        (90 - 36 * (node // 8))::DOUBLE AS lat, (-180 + 45 * (node % 8))::DOUBLE AS lon, CASE WHEN e % 97 = 0 THEN 'NaN'::DOUBLE ELSE v + 1 END AS v
        FROM (SELECT floor(epoch_us(ts) / 1000000.0 / 3600)::BIGINT AS step, event_id % 48 AS node, max(value) AS v, max(event_id) AS e FROM events GROUP BY 1, 2))""",
    "fx_point_request": """fx_point_request AS (SELECT c_custkey AS id, (9 * c_custkey % 181 - 90)::DOUBLE AS lat, (13 * c_custkey % 360 - 180)::DOUBLE AS lon,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 't2m,wind,msl' WHEN 'BUILDING' THEN '2t' WHEN 'FURNITURE' THEN ' msl, 10u,,msl' WHEN 'HOUSEHOLD' THEN 'wind,d2m'
        WHEN 'MACHINERY' THEN 'tcc,tp_1h' ELSE '2t' END AS vars, CASE WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'si' END AS units FROM customer)""",
    "fx_grid_request": """fx_grid_request AS (SELECT k AS id, CASE WHEN k % 11 = 5 THEN box || ',1' WHEN k % 11 = 6 THEN 'a,b,c,d' ELSE box END AS bbox,
        (['2t', 'msl', '10u', 'tcc'])[k % 4 + 1] AS variable, 1704067200 + k * 39600 % 3000000 AS sec, (1 + k % 3)::INT AS stride FROM (SELECT k, concat_ws(',', south, west,
        CASE WHEN k % 7 = 3 THEN south - 10 ELSE least(south + 20 + k * 5 % 90, 90) END, least(west + 30 + k * 11 % 140, 180)) AS box FROM
        (SELECT c_custkey::BIGINT AS k, c_custkey * 17 % 150 - 90 AS south, c_custkey * 29 % 300 - 180 AS west FROM customer)))""",
    "fx_message": """fx_message AS (SELECT file, n, (upto - length)::BIGINT AS "offset", length, param, level FROM (SELECT l_orderkey AS file,
        row_number() OVER w AS n, (1000 * l_quantity)::BIGINT AS length, sum((1000 * l_quantity)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
        (l_partkey % 6)::INT AS param, (l_suppkey % 14)::INT AS level FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice)))""",
    "fx_cache": """fx_cache AS (SELECT 'era5/' || p_type || '/' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'era5-final' ELSE 'era5t' END AS source_version,
        round(1000 * p_retailprice)::BIGINT AS bytes, 1706659200 - 600 * p_partkey AS last_access, p_partkey % 5 AS access_count,
        CASE WHEN p_size % 2 = 0 THEN 200 ELSE 60000 END::BIGINT AS cost_ms, p_size % 10 = 0 AS pinned FROM part)""",
    "fx_absent": """fx_absent AS (SELECT 'era5/x/' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'not_yet' ELSE 'gone' END AS reason,
        1706702400 - 3600 * (s_suppkey % 12) AS since, 1706702400 - 3600 * (s_suppkey % 12) + 21600 AS until FROM supplier)""",
    "fx_log": """fx_log AS (SELECT event_id, ts, floor(epoch_us(ts) / 1000000.0)::BIGINT AS sec, CASE event_type WHEN 'click' THEN 'forecast/point' WHEN 'view' THEN 'forecast/grid'
        WHEN 'purchase' THEN 'history/point' WHEN 'error' THEN 'history/grid' ELSE 'coverage' END AS endpoint,
        CASE WHEN event_type <> 'signup' THEN 'u' || user_id END AS area, value < 30 AS hit, floor(10 * value)::BIGINT AS latency_ms FROM events)""",
    "fx_run": """fx_run AS (SELECT (epoch_us(date_trunc('day', o_orderdate)::TIMESTAMP) // 1000000 + 21600 * (o_orderkey % 4))::BIGINT AS init, min(o_orderstatus) AS status,
        count(*) AS n, max(o_orderkey) AS last_order FROM orders GROUP BY 1)""",
}
_UNPIVOT = {
    "2t": "270 + v / 10", "10u": "v / 20 - 2", "10v": "3 - v / 25", "msl": "101325 + 10 * (v - 50)", "tp_1h": "v / 100000",
    "tcc": "CASE WHEN isnan(v) THEN v ELSE least(v / 500, 1.0) END", "2d": "265 + v / 10", "i10fg": "v / 10",
}
for _name, _of in (("fx_field", "fx_grid"), ("fx_hourly", "fx_hour")):
    SQL[_name] = f"{_name} AS (" + " UNION ALL ".join(f"SELECT '{k}' AS variable, time, lat_i, lon_i, lat, lon, ({x})::FLOAT AS value FROM {_of}" for k, x in _UNPIVOT.items()) + ")"
SQL["fx_level"] = f"""fx_level AS (SELECT variable, level::INT AS level, time, lat_i, lon_i, lat, lon, (CASE variable WHEN 't' THEN 180 + level / 10 + v / 20 ELSE 100 * (1000 - level) + v END)::FLOAT AS value
    FROM fx_grid, (SELECT unnest({list(ARCHIVE_LEVELS)}) AS level), (VALUES ('t'), ('z')) k(variable))"""
_NEEDS = {"fx_level": ["fx_grid"], "fx_field": ["fx_grid"], "fx_hourly": ["fx_hour"]}


def with_tables(body: str, *names: str) -> str:
    """SQL that sees the named fixtures: body is a SELECT or begins with further 'name AS (...)' and a SELECT."""
    order = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    tables = ", ".join(SQL[x] for x in order)
    return f"WITH {tables} {body}" if body.lstrip().upper().startswith("SELECT") else f"WITH {tables}, {body}"
