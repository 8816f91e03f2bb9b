"""Queries of the request and reading operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import coordinate, epoch_seconds, from_epoch, iso, nan_to_null, round_to, unit_label, wind_speed
from ..operators import reading as R
from ..operators import requests as Q
from ..operators import tiles as T
from ..sources import fixtures as fx
from ..sources import layers as L
from ..sources.fixtures import with_tables
from .book import query

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
#: The catalogue as SQL rows: asked, name, first and second input, human scale and offset.
_CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{n}', '{i}', '{j}', {s!r}::DOUBLE, {o!r}::DOUBLE, '{si}', '{hu}')"
    for a, n, i, j, s, o, si, hu in [
        (a, a, canon.ALIASES.get(a, a), canon.ALIASES.get(a, a), *canon.HUMAN.get(canon.ALIASES.get(a, a), ("", 1.0, 0.0))[1:], canon.VARIABLES[canon.ALIASES.get(a, a)][0],
         canon.HUMAN.get(canon.ALIASES.get(a, a), (canon.LABELS.get(canon.VARIABLES[canon.ALIASES.get(a, a)][0], canon.VARIABLES[canon.ALIASES.get(a, a)][0]),))[0])
        for a in [*canon.VARIABLES, *canon.ALIASES]
    ] + [(w, "wind_speed", "10u", "10v", 1.0, 0.0, "m s-1", "m/s") for w in ("wind", "wind_speed")]
) + ") AS t(asked, name, first, second, scale, off, si, human))"
_RESOLVED = f"""{_CATALOG}, parts AS (SELECT id, unnest(range(len(string_split(vars, ',')))) AS pos, trim(unnest(string_split(vars, ','))) AS asked FROM fx_point_request),
    resolved AS (SELECT id, name, min(pos) AS pos, arg_min(first, pos) AS first, arg_min(second, pos) AS second, arg_min(scale, pos) AS scale, arg_min(off, pos) AS off,
    arg_min(si, pos) AS si, arg_min(human, pos) AS human FROM parts JOIN catalog USING (asked) GROUP BY id, name)"""
_NODES = """lats AS (SELECT (90 - 36 * i)::DOUBLE AS lat, i::INT AS lat_i FROM range(6) t(i)), lons AS (SELECT (-180 + 45 * i)::DOUBLE AS lon, i::INT AS lon_i FROM range(8) t(i)),
    nodes AS (SELECT id, (SELECT lat_i FROM lats ORDER BY abs(lats.lat - r.lat), -lats.lat LIMIT 1) AS lat_i, (SELECT lon_i FROM lons ORDER BY abs(lons.lon - r.lon), -lons.lon LIMIT 1) AS lon_i,
    r.units FROM fx_point_request r)"""


def axes(spark):
    """The 6 x 8 axes of the fixtures."""
    lat = spark.range(6).select(F.col("id").cast("int").alias("lat_i"), (90 - 36 * F.col("id")).cast("double").alias("lat"))
    lon = spark.range(8).select(F.col("id").cast("int").alias("lon_i"), (-180 + 45 * F.col("id")).cast("double").alias("lon"))
    return lat, lon


@query("nearest_node", with_tables(f"{_NODES} SELECT id, lat_i, lon_i, (90 - 36 * lat_i)::DOUBLE AS node_lat, (-180 + 45 * lon_i)::DOUBLE AS node_lon FROM nodes", "fx_point_request"))
def nearest_node(spark, d):
    return R.nearest_node(fx.point_requests(spark, d), *axes(spark))


@query("resolve_fields", with_tables(f"{_RESOLVED} SELECT id, name, pos::INT AS pos FROM resolved", "fx_point_request"))
def resolve_fields(spark, d):
    return Q.resolve_fields(fx.point_requests(spark, d)).where("known").select("id", "name", "pos")


@query(
    "canonical_inputs",
    with_tables(
        f"""{_RESOLVED}, each AS (SELECT id, pos, 0 AS k, first AS v FROM resolved UNION ALL SELECT id, pos, 1, second FROM resolved WHERE second <> first),
    firsts AS (SELECT id, v, min(pos * 10 + k) AS place FROM each GROUP BY id, v) SELECT id, string_agg(v, ',' ORDER BY place) AS inputs FROM firsts GROUP BY id""",
        "fx_point_request",
    ),
)
def canonical_inputs(spark, d):
    rows = Q.canonical_inputs(Q.resolve_fields(fx.point_requests(spark, d)))
    return rows.select("id", F.array_join("inputs", ",").alias("inputs"))


_SERIES = with_tables(
        f"""{_RESOLVED}, {_NODES} SELECT r.id, r.name, {ISO.format('a.time')} AS time, round(CASE WHEN isnan(x) THEN NULL WHEN units = 'human' THEN x * scale + off ELSE x END, 6) AS value
    FROM (SELECT r.*, n.lat_i, n.lon_i, n.units FROM resolved r JOIN nodes n USING (id)) r JOIN fx_field a ON a.variable = r.first AND a.lat_i = r.lat_i AND a.lon_i = r.lon_i
    JOIN fx_field b ON b.variable = r.second AND b.lat_i = r.lat_i AND b.lon_i = r.lon_i AND b.time = a.time,
    LATERAL (SELECT CASE WHEN r.first = r.second THEN a.value::DOUBLE ELSE sqrt(a.value::DOUBLE * a.value::DOUBLE + b.value::DOUBLE * b.value::DOUBLE) END AS x)
    """,
        "fx_point_request",
        "fx_field",
    )
#: One row for each answer: every value counts in total and, with a weight that depends on its moment, in weighted.
_POINT_SERIES = f"""SELECT id, name, count(*) AS n, count(value) AS known, min(time) AS first, max(time) AS last, sum(round(value * 1000)::BIGINT)::BIGINT AS total,
    sum(round(value * 1000)::BIGINT * (epoch_us(strptime(time, '%Y-%m-%dT%H:%M:%SZ')) // 3600000000 % 997))::BIGINT AS weighted FROM ({_SERIES}) GROUP BY id, name"""


def _answers(series):
    milli = F.round(F.round("value", 6) * 1000).cast("long")
    weight = F.floor(epoch_seconds(F.col("time")) / 3600) % 997
    return series.groupBy("id", "name").agg(F.count("*").alias("n"), F.count("value").alias("known"), iso(F.min("time")).alias("first"), iso(F.max("time")).alias("last"), F.sum(milli).alias("total"), F.sum(milli * weight).alias("weighted"))


@query("point_series", _SERIES)
def point_series(spark, d):
    """The flagship: every request's fields at its node over all steps, in its units."""
    requests = fx.point_requests(spark, d)
    nodes = R.nearest_node(requests, *axes(spark))
    rows = R.point_series(fx.field(spark, d), nodes, Q.resolve_fields(requests), requests.select("id", "units"))
    return rows.select("id", "name", iso(F.col("time")).alias("time"), F.round("value", 6).alias("value"))


@query("point_series_stored", _POINT_SERIES)
def point_series_stored(spark, d):
    """The same answers from a layer that is stored in buckets of nodes."""
    path = L.scratch(spark)
    table = "series_" + path.rsplit("-", 1)[1]
    L.write_series_table(fx.field(spark, d), table, path, "points", buckets=8)
    requests = fx.point_requests(spark, d)
    rows = R.point_series(spark.table(table), R.nearest_node(requests, *axes(spark)), Q.resolve_fields(requests), requests.select("id", "units"))
    return _answers(rows)


@query("unit_convert", with_tables(f"{_CATALOG} SELECT variable, {ISO.format('time')} AS time, lat_i, lon_i, round(value::DOUBLE * scale + off, 6) AS human FROM fx_field JOIN catalog ON asked = variable WHERE NOT isnan(value)", "fx_field"))
def unit_convert(spark, d):
    catalog = F.broadcast(canon.catalog(spark).select(F.col("asked").alias("variable"), "scale", "offset"))
    rows = fx.field(spark, d).join(catalog, "variable").where(~F.isnan("value"))
    return rows.select("variable", iso(F.col("time")).alias("time"), "lat_i", "lon_i", F.round(F.col("value").cast("double") * F.col("scale") + F.col("offset"), 6).alias("human"))


@query(
    "wind_speed",
    with_tables(
        f"SELECT {ISO.format('u.time')} AS time, u.lat_i, u.lon_i, CASE WHEN isnan(u.value) THEN NULL ELSE round(sqrt(u.value::DOUBLE ** 2 + v.value::DOUBLE ** 2), 6) END AS speed FROM fx_field u JOIN fx_field v USING (time, lat_i, lon_i) WHERE u.variable = '10u' AND v.variable = '10v'",
        "fx_field",
    ),
)
def wind(spark, d):
    part = lambda k: F.max(F.when(F.col("variable") == k, F.col("value")))
    rows = fx.field(spark, d).where("variable in ('10u', '10v')").groupBy("time", "lat_i", "lon_i").agg(part("10u").alias("u"), part("10v").alias("v"))
    return rows.select(iso(F.col("time")).alias("time"), "lat_i", "lon_i", F.round(nan_to_null(wind_speed(F.col("u"), F.col("v"))), 6).alias("speed"))


@query("round_by_unit", with_tables("SELECT variable, lat_i, lon_i, round_even(max(value)::DOUBLE, CASE variable WHEN 'msl' THEN 0 WHEN '2t' THEN 1 WHEN '2d' THEN 1 WHEN '10u' THEN 1 WHEN '10v' THEN 1 WHEN 'i10fg' THEN 1 ELSE 3 END) AS value FROM fx_field WHERE NOT isnan(value) GROUP BY variable, lat_i, lon_i", "fx_field"))
def round_by_unit(spark, d):
    info = F.broadcast(canon.catalog(spark).select(F.col("asked").alias("variable"), "digits_si"))
    rows = fx.field(spark, d).where(~F.isnan("value")).groupBy("variable", "lat_i", "lon_i").agg(F.max("value").cast("double").alias("v")).join(info, "variable")
    return rows.select("variable", "lat_i", "lon_i", round_to(F.col("v"), F.col("digits_si")).alias("value"))


@query("nan_to_null", with_tables("SELECT variable, count(*) AS n, count(CASE WHEN NOT isnan(value) THEN 1 END) AS known FROM fx_field GROUP BY variable", "fx_field"))
def gaps(spark, d):
    return fx.field(spark, d).groupBy("variable").agg(F.count("*").alias("n"), F.count(nan_to_null(F.col("value"))).alias("known"))


@query("unit_label", with_tables(f"{_RESOLVED} SELECT r.id, r.name, CASE WHEN q.units = 'human' THEN r.human ELSE r.si END AS unit FROM resolved r JOIN fx_point_request q USING (id)", "fx_point_request"))
def labels(spark, d):
    requests = fx.point_requests(spark, d)
    rows = Q.resolve_fields(requests).where("known").join(requests.select("id", "units"), "id")
    return rows.select("id", "name", unit_label(F.col("units"), F.col("unit_si"), F.col("unit_human")).alias("unit"))


@query("iso_time", f"SELECT event_id, {ISO.format('ts')} AS time FROM events")
def iso_time(spark, d):
    return fx.table(spark, d, "events").select("event_id", iso(F.col("ts")).alias("time"))


@query("coord_round", "SELECT s_suppkey, round_even(s_suppkey / 7.0::DOUBLE, 6) AS coord FROM supplier")
def coord_round(spark, d):
    return fx.table(spark, d, "supplier").select("s_suppkey", coordinate(F.col("s_suppkey") / 7.0).alias("coord"))


@query("offered_fields", with_tables("s AS (SELECT DISTINCT variable FROM fx_field) SELECT CASE variable WHEN '2t' THEN 't2m' WHEN '2d' THEN 'd2m' ELSE variable END AS name FROM s UNION SELECT 'wind' FROM s WHERE variable IN ('10u', '10v') HAVING count(*) = 2", "fx_field"))
def offered(spark, d):
    stored = fx.field(spark, d).select(F.lit(1).alias("run"), "variable").distinct()
    return Q.offered_fields(stored, "run").select("name")


_STEP_OF = "CASE id % 3 WHEN 0 THEN 6 WHEN 1 THEN 1 ELSE 3 END"


def _inputs(spark, d):
    fields = Q.resolve_fields(fx.point_requests(spark, d))
    return Q.canonical_inputs(fields).select("id", F.explode("inputs").alias("variable"))


_INPUTS = f"{_RESOLVED}, inputs AS (SELECT DISTINCT id, v FROM (SELECT id, first AS v FROM resolved UNION ALL SELECT id, second FROM resolved))"
_SERIES = ", ".join(f"'{x}'" for x in canon.SERIES)


@query(
    "choose_layer",
    with_tables(
        f"""{_INPUTS} SELECT id, CASE {_STEP_OF} WHEN 6 THEN 'coarse' WHEN 1 THEN 'hourly' END AS layer, CASE WHEN {_STEP_OF} = 3 THEN 'step'
    WHEN {_STEP_OF} = 1 AND bool_or(v NOT IN ({_SERIES})) THEN 'vars:' || string_agg(CASE WHEN v NOT IN ({_SERIES}) THEN v END, ',' ORDER BY v) END AS reason FROM inputs GROUP BY id""",
        "fx_point_request",
    ),
)
def choose_layer(spark, d):
    step = F.when(F.col("id") % 3 == 0, 6).when(F.col("id") % 3 == 1, 1).otherwise(3)
    return Q.choose_layer(_inputs(spark, d).withColumn("step_hours", step))


@query("point_layer", with_tables(f"{_INPUTS} SELECT id, CASE WHEN bool_and(v IN ({_SERIES})) THEN 'points' ELSE 'coarse' END AS layer FROM inputs GROUP BY id", "fx_point_request"))
def point_layer(spark, d):
    present = spark.createDataFrame([("coarse",), ("points",)], "layer string")
    return Q.point_layer(_inputs(spark, d), present)


@query("validate_point", "SELECT c_custkey AS id, CASE WHEN abs(c_custkey % 200 - 100) > 90 THEN 'lat' WHEN abs(c_custkey % 380 - 190) > 180 THEN 'lon' WHEN c_custkey % 5 = 4 THEN 'units' WHEN c_custkey % 7 > 4 THEN 'range' END AS code FROM customer")
def validate_point(spark, d):
    k = F.col("c_custkey")
    rows = fx.table(spark, d, "customer").select(
        k.alias("id"), (k % 200 - 100).alias("lat"), (k % 380 - 190).alias("lon"), F.when(k % 5 == 4, "feet").otherwise("si").alias("units"), (k % 7).alias("start"), F.lit(4).alias("stop")
    )
    return Q.validate_point(rows).select("id", "code")


_BOXES = """boxes AS (SELECT *, CASE WHEN len(p) <> 4 THEN 'shape' WHEN south IS NULL OR west IS NULL OR north IS NULL OR east IS NULL THEN 'number'
    WHEN NOT (south BETWEEN -90 AND 90 AND north BETWEEN -90 AND 90 AND west BETWEEN -180 AND 180 AND east BETWEEN -180 AND 180) THEN 'range'
    WHEN NOT (south < north AND west < east) THEN 'order' END AS box_code FROM (SELECT *, try_cast(p[1] AS DOUBLE) AS south, try_cast(p[2] AS DOUBLE) AS west,
    try_cast(p[3] AS DOUBLE) AS north, try_cast(p[4] AS DOUBLE) AS east FROM (SELECT *, string_split(bbox, ',') AS p FROM fx_grid_request)))"""


@query("parse_bbox", with_tables(f"{_BOXES} SELECT id, south, west, north, east, box_code FROM boxes", "fx_grid_request"))
def parse_bbox(spark, d):
    return Q.parse_bbox(fx.grid_requests(spark, d)).select("id", "south", "west", "north", "east", "box_code")


@query("parse_moment", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE epoch_us(date_trunc('second', ts)) // 1000000 - CASE WHEN event_id % 5 = 2 THEN 10800 ELSE 0 END END AS at FROM events")
def parse_moment(spark, d):
    text = iso(F.col("ts"))
    k = F.col("event_id") % 5
    bare = F.substring(text, 1, 19)
    asked = F.when(k == 0, text).when(k == 1, bare).when(k == 2, F.concat(bare, F.lit("+03:00"))).when(k == 3, F.concat(bare, F.lit("Z"))).otherwise("soon")
    rows = Q.parse_moment(fx.table(spark, d, "events").select("event_id", asked.alias("asked")), "asked")
    return rows.select("event_id", F.unix_seconds("moment").alias("at"))


def _valid_boxes(spark, d):
    return Q.parse_bbox(fx.grid_requests(spark, d)).where("box_code is null")


_WINDOW = f"""{_BOXES}, sizes AS (SELECT id, stride, (SELECT count(*) FROM range(721) t(i) WHERE 90 - i * 0.25 BETWEEN south AND north) AS ny,
    (SELECT count(*) FROM range(1440) t(i) WHERE -180 + i * 0.25 BETWEEN west AND east) AS nx FROM boxes WHERE box_code IS NULL)"""


@query(
    "limit_points",
    with_tables(
        f"""{_WINDOW} SELECT id, ny, nx, (ceil(ny / stride) * ceil(nx / stride))::BIGINT AS points, (SELECT min(s) FROM range(1, 2000) t(s) WHERE ceil(ny / s) * ceil(nx / s) <= 50000) AS suggested,
    CASE WHEN ceil(ny / stride) * ceil(nx / stride) = 0 THEN 'coverage' WHEN ceil(ny / stride) * ceil(nx / stride) > 50000 THEN 'points' END AS code FROM sizes""",
        "fx_grid_request",
    ),
)
def limit_points(spark, d):
    rows = Q.limited_window(_valid_boxes(spark, d), canon.axis_lat(spark), canon.axis_lon(spark))
    return rows.select("id", "ny", "nx", "points", "suggested", "code")


@query("suggest_stride", "SELECT p_partkey, (SELECT min(s) FROM range(1, 3000) t(s) WHERE ceil((1 + p_partkey % 721) / s) * ceil((1 + p_partkey * 7 % 1440) / s) <= 5000) AS stride FROM part")
def suggest_stride(spark, d):
    from ..functions.fields import suggested_stride

    k = F.col("p_partkey")
    rows = fx.table(spark, d, "part").select("p_partkey", (1 + k % 721).cast("int").alias("ny"), (1 + k * 7 % 1440).cast("int").alias("nx"))
    return rows.select("p_partkey", suggested_stride(F.col("ny"), F.col("nx"), 5000).cast("long").alias("stride"))


@query("limit_steps", with_tables("SELECT lat_i, lon_i, count(DISTINCT time) AS requested, count(DISTINCT time) > 500 AS refused FROM fx_hourly GROUP BY lat_i, lon_i", "fx_hourly"))
def limit_steps(spark, d):
    rows = fx.field(spark, d, hourly=True).withColumn("id", F.struct("lat_i", "lon_i"))
    return Q.limit_steps(rows).select("id.lat_i", "id.lon_i", "requested", "refused")


@query("surface_only", "SELECT l_linenumber AS n, count(*) AS kept FROM lineitem WHERE l_partkey % 5 > 1 GROUP BY 1")
def surface_only(spark, d):
    variable = F.element_at(F.array(*map(F.lit, ("t", "z", "2t", "msl", "tcc"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = Q.surface_only(fx.table(spark, d, "lineitem").withColumn("variable", variable))
    return rows.groupBy(F.col("l_linenumber").alias("n")).agg(F.count("*").alias("kept"))


@query("hourly_horizon", with_tables("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND epoch_us(o_orderdate) // 1000000 > (SELECT max(epoch_us(time) // 1000000) FROM fx_hour) - 800000000 + o_orderkey * 1000 AS beyond FROM orders", "fx_hour"))
def hourly_horizon(spark, d):
    last = fx.grid(spark, d, 3600, 1.0).agg(F.max(epoch_seconds(F.col("time"))).alias("last"))
    k = F.col("o_orderkey")
    rows = fx.table(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, 1).otherwise(6).alias("step_hours"), (epoch_seconds(F.col("o_orderdate").cast("timestamp_ntz")) + 800000000 - k * 1000).alias("stop"))
    return Q.hourly_horizon(rows, last).select("id", "beyond")


_STEPS = "steps AS (SELECT DISTINCT epoch_us(time) // 1000000 AS sec FROM fx_grid), ends AS (SELECT min(sec) AS a, max(sec) AS b, (SELECT sec FROM steps ORDER BY sec LIMIT 1 OFFSET 1) - min(sec) AS d FROM steps)"


@query(
    "nearest_time",
    with_tables(
        f"""{_STEPS}, asked AS (SELECT o_orderkey AS id, 1703980800 + o_orderkey * 977 % 3000000 AS sec FROM orders), near AS (SELECT id, arg_min(s.sec, abs(s.sec - q.sec) * 10000000000 - s.sec) AS step, any_value(q.sec) AS w
    FROM asked q, steps s GROUP BY id) SELECT id, CASE WHEN w BETWEEN a - d // 2 AND b + d // 2 THEN step END AS step, CASE WHEN w BETWEEN a - d // 2 AND b + d // 2 THEN NULL ELSE 'coverage' END AS code FROM near, ends""",
        "fx_grid",
    ),
)
def nearest_time(spark, d):
    times = fx.grid(spark, d).select(epoch_seconds(F.col("time")).alias("at")).distinct()
    asked = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (1703980800 + F.col("o_orderkey") * 977 % 3000000).alias("at"))
    return R.nearest_step(asked, times)


_NODES_OF = f"""{_BOXES}, rows_ AS (SELECT id, i::INT AS lat_i, (90 - 36 * i)::DOUBLE AS lat, stride, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k FROM boxes, range(6) t(i) WHERE box_code IS NULL AND 90 - 36 * i BETWEEN south AND north),
    cols AS (SELECT id, i::INT AS lon_i, (-180 + 45 * i)::DOUBLE AS lon, stride, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k FROM boxes, range(8) t(i) WHERE box_code IS NULL AND -180 + 45 * i BETWEEN west AND east),
    win AS (SELECT r.id, lat_i, lon_i, lat, lon FROM rows_ r JOIN cols c ON r.id = c.id AND r.k % r.stride = 0 AND c.k % c.stride = 0)"""


@query("bbox_window", with_tables(f"{_NODES_OF} SELECT id, lat_i, lon_i FROM win", "fx_grid_request"))
def bbox_window(spark, d):
    return R.window_nodes(_valid_boxes(spark, d), *axes(spark)).select("id", "lat_i", "lon_i")


@query("stride_thin", "SELECT s, (SELECT count(*) FROM range(721) t(i) WHERE i % s = 0) AS ny, (SELECT count(*) FROM range(1440) t(i) WHERE i % s = 0) AS nx FROM (SELECT DISTINCT (1 + c_custkey % 700)::INT AS s FROM customer)")
def stride_thin(spark, d):
    """Rows and columns that each stride leaves of the whole grid."""
    boxes = fx.table(spark, d, "customer").select((1 + F.col("c_custkey") % 700).cast("int").alias("stride")).distinct()
    boxes = boxes.select(F.col("stride").alias("id"), "stride", F.lit(-90.0).alias("south"), F.lit(-180.0).alias("west"), F.lit(90.0).alias("north"), F.lit(180.0).alias("east"))
    nodes = R.window_nodes(boxes, canon.axis_lat(spark), canon.axis_lon(spark), limit=None)
    return nodes.groupBy(F.col("id").alias("s")).agg(F.count_distinct("lat_i").alias("ny"), F.count_distinct("lon_i").alias("nx"))


def _wanted(spark, d):
    boxes = _valid_boxes(spark, d)
    times = fx.grid(spark, d).select(epoch_seconds(F.col("time")).alias("at")).distinct()
    steps = R.nearest_step(boxes, times).where("step is not null")
    return boxes.join(steps, "id").select("id", "variable", from_epoch(F.col("step")).alias("time"), "stride", F.when(F.col("id") % 2 == 0, "human").otherwise("si").alias("units"))


_WANTED = f"""{_NODES_OF}, {_STEPS}, near AS (SELECT id, variable, stride, arg_min(s.sec, abs(s.sec - q.sec) * 10000000000 - s.sec) AS step, any_value(q.sec) AS w FROM boxes q, steps s WHERE box_code IS NULL GROUP BY ALL),
    wanted AS (SELECT id, variable, stride, make_timestamp(step * 1000000) AS time FROM near, ends WHERE w BETWEEN a - d // 2 AND b + d // 2)"""


@query("grid_window", with_tables(f"{_WANTED} SELECT w.id, w.lat_i, w.lon_i, round(CASE WHEN isnan(f.value) THEN NULL ELSE f.value::DOUBLE END, 6) AS value FROM win w JOIN wanted q USING (id) LEFT JOIN fx_field f ON f.variable = q.variable AND f.time = q.time AND f.lat_i = w.lat_i AND f.lon_i = w.lon_i", "fx_grid_request", "fx_field"))
def grid_window(spark, d):
    rows = T.grid_window(T.tiled(fx.field(spark, d)), T.window_tiles(_valid_boxes(spark, d), *axes(spark)), _wanted(spark, d))
    return rows.select("id", "lat_i", "lon_i", F.round(nan_to_null(F.col("value")), 6).alias("value"))


@query(
    "compact_grid",
    with_tables(
        f"""{_WANTED}, {_CATALOG}, cells AS (SELECT w.id, q.stride, w.lat_i, w.lon_i, w.lat, w.lon, CASE WHEN f.value IS NULL OR isnan(f.value) THEN 'null' WHEN q.id % 2 = 0 THEN
    printf('%.3f', round_even(f.value::DOUBLE * scale + off, CASE human WHEN '1' THEN 3 ELSE 1 END) + 0.0::DOUBLE) ELSE printf('%.3f', round_even(f.value::DOUBLE, CASE si WHEN 'Pa' THEN 0 WHEN '1' THEN 3 ELSE 1 END) + 0.0::DOUBLE) END AS v
    FROM win w JOIN wanted q USING (id) JOIN catalog c ON c.asked = q.variable LEFT JOIN fx_field f ON f.variable = q.variable AND f.time = q.time AND f.lat_i = w.lat_i AND f.lon_i = w.lon_i)
    SELECT id, max(lat) AS lat0, min(lon) AS lon0, (-36.0 * any_value(stride))::DOUBLE AS dlat, (45.0 * any_value(stride))::DOUBLE AS dlon, count(DISTINCT lat_i) AS ny, count(DISTINCT lon_i) AS nx,
    string_agg(v, ',' ORDER BY lat_i, lon_i) AS values FROM cells GROUP BY id""",
        "fx_grid_request",
        "fx_field",
    ),
)
def compact_grid(spark, d):
    rows = T.compact_grid(T.tiled(fx.field(spark, d)), T.window_tiles(_valid_boxes(spark, d), *axes(spark)), _wanted(spark, d), canon.catalog(spark))
    text = F.array_join(F.transform("values", lambda v: F.when(v.isNull(), "null").otherwise(F.format_string("%.3f", v))), ",")
    return rows.select("id", "lat0", "lon0", "dlat", "dlon", "ny", "nx", text.alias("values"))


@query("time_window", with_tables("SELECT variable, count(*) AS n FROM fx_field WHERE time BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-09 18:00:00' GROUP BY variable", "fx_field"))
def time_window(spark, d):
    rows = R.time_window(fx.field(spark, d), F.lit("2024-01-03T00:00:00").cast("timestamp_ntz"), F.lit("2024-01-09T18:00:00").cast("timestamp_ntz"))
    return rows.groupBy("variable").agg(F.count("*").alias("n"))


_COVER = "SELECT {step} AS step_hours, {first} AS first, {last} AS last, count(DISTINCT time) AS steps, (SELECT string_agg(DISTINCT variable, ',' ORDER BY variable) FROM {t}) AS names FROM {t}"
_COVERAGE = with_tables(
    " UNION ALL ".join(_COVER.format(step=s, first=ISO.format("min(time)"), last=ISO.format("max(time)"), t=t) for s, t in ((6, "fx_field"), (1, "fx_hourly"))), "fx_field", "fx_hourly"
)


def _coverage(spark, d):
    both = fx.field(spark, d).withColumn("step_hours", F.lit(6)).unionByName(fx.field(spark, d, hourly=True).withColumn("step_hours", F.lit(1)))
    return R.coverage(both, ["step_hours"])


@query("coverage", _COVERAGE)
def coverage(spark, d):
    return _coverage(spark, d).select("step_hours", iso(F.col("first")).alias("first"), iso(F.col("last")).alias("last"), "steps", F.array_join("names", ",").alias("names"))


@query("coverage_report", f"SELECT step_hours, steps, 50000 AS max_points, 500 AS max_steps, list_aggregate(list_sort(list_concat(['wind'], list_transform(string_split(names, ','), lambda x: CASE x WHEN '2t' THEN 't2m' WHEN '2d' THEN 'd2m' ELSE x END))), 'string_agg', ',') AS names FROM ({_COVERAGE})")
def coverage_report(spark, d):
    spans = _coverage(spark, d)
    names = Q.offered_fields(spans.select("step_hours", F.explode("names").alias("variable")), "step_hours").groupBy("step_hours").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return spans.drop("names").join(names, "step_hours").select("step_hours", "steps", F.lit(canon.MAX_POINTS).alias("max_points"), F.lit(canon.MAX_STEPS).alias("max_steps"), "names")


@query("layer_span", with_tables(f"SELECT {ISO.format('min(time)')} AS first, {ISO.format('max(time)')} AS last FROM fx_field", "fx_field"))
def layer_span(spark, d):
    return R.layer_span(fx.field(spark, d)).select(iso(F.col("first")).alias("first"), iso(F.col("last")).alias("last"))


@query("answer_fingerprint", with_tables("SELECT id, substr(sha256('{\"id\":' || id || ',\"vars\":\"' || vars || '\",\"units\":\"' || units || '\"}'), 1, 32) AS etag FROM fx_point_request", "fx_point_request"))
def answer_fingerprint(spark, d):
    return R.fingerprint(fx.point_requests(spark, d), ["id", "vars", "units"]).select("id", "etag")


@query("freshness", with_tables("SELECT init, round_even((1706702400 - init) / 3600.0::DOUBLE, 1) AS age_hours, init + 21600 AS next_expected FROM fx_run", "fx_run"))
def freshness(spark, d):
    return R.freshness(fx.runs(spark, d), fx.NOW).select("init", "age_hours", "next_expected")


@query("published_run", with_tables("SELECT init FROM fx_run WHERE status = 'F' AND init = (SELECT arg_max(init, last_order) FROM fx_run WHERE status = 'F')", "fx_run"))
def published_run(spark, d):
    runs = fx.runs(spark, d).select(F.col("init").alias("run_id"), (F.col("status") == "F").alias("published"), "last_order")
    pointer = runs.where("published").select(F.col("last_order").alias("seq"), "run_id")
    return R.published_run(pointer, runs).select(F.col("run_id").alias("init"))


@query("availability", with_tables("SELECT o_orderkey AS id, CASE WHEN (SELECT max(init) FROM fx_run WHERE status = 'F') IS NULL THEN 'no_forecast' WHEN o_orderkey % 3 = 2 THEN 'no_layer' END AS code FROM orders", "fx_run"))
def availability(spark, d):
    published = fx.runs(spark, d).where("status = 'F'").select(F.col("init").alias("run_id"))
    present = published.select("run_id", F.explode(F.array(F.lit("coarse"), F.lit("hourly"))).alias("layer"))
    asked = F.element_at(F.array(F.lit("coarse"), F.lit("hourly"), F.lit("points")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), asked.alias("layer"))
    return Q.availability(rows, published, present).select("id", "code")


@query("health_report", with_tables(f"SELECT CASE WHEN count(*) = 0 THEN 'no_forecast' ELSE 'ok' END AS status, round_even((1706702400 - max(init)) / 3600.0::DOUBLE, 1) AS age_hours, (SELECT count(DISTINCT time) FROM fx_field) AS coarse_steps FROM fx_run WHERE status = 'F'", "fx_run", "fx_field"))
def health_report(spark, d):
    run = fx.runs(spark, d).where("status = 'F'").agg(F.max("init").alias("init"), F.count("*").alias("n"))
    steps = R.coverage(fx.field(spark, d).withColumn("step_hours", F.lit(6)), ["step_hours"]).select(F.col("steps").alias("coarse_steps"))
    rows = R.freshness(run, fx.NOW).crossJoin(steps)
    return rows.select(F.when(F.col("n") == 0, "no_forecast").otherwise("ok").alias("status"), "age_hours", "coarse_steps")


@query(
    "point_answers",
    with_tables(
        f"""{_RESOLVED}, {_STEPS}, period AS (SELECT c_custkey AS id, 1703635200 + c_custkey * 7919 % 40 * 86400 AS start, 1703635200 + (c_custkey * 7919 % 40 + c_custkey % 20) * 86400 AS stop FROM customer),
    inside AS (SELECT p.id, count(s.sec) AS steps FROM period p LEFT JOIN steps s ON s.sec BETWEEN p.start AND p.stop GROUP BY p.id)
    SELECT id, steps, CASE WHEN steps = 0 THEN 'coverage' WHEN steps > 40 THEN 'steps' END AS code, CASE WHEN steps BETWEEN 1 AND 40 THEN coalesce(n, 0) ELSE 0 END AS n FROM inside LEFT JOIN
    (SELECT r.id, count(*) AS n FROM resolved r JOIN nodes_of n USING (id) JOIN period p USING (id) JOIN fx_field a ON a.variable = r.first AND a.lat_i = n.lat_i AND a.lon_i = n.lon_i AND epoch_us(a.time) // 1000000 BETWEEN p.start AND p.stop
    JOIN fx_field b ON b.variable = r.second AND b.lat_i = n.lat_i AND b.lon_i = n.lon_i AND b.time = a.time GROUP BY r.id) USING (id)""".replace(", period AS", f", {_NODES}, nodes_of AS (SELECT id, lat_i, lon_i FROM nodes), period AS"),
        "fx_point_request",
        "fx_grid",
        "fx_field",
    ),
)
def point_answers(spark, d):
    """Requests with a period: how many values each gets, or why it gets none."""
    k = F.col("id")
    start = 1703635200 + k * 7919 % 40 * 86400
    requests = fx.point_requests(spark, d).withColumns({"start": start, "stop": start + k % 20 * 86400})
    series, refused = R.limited_point_series(fx.field(spark, d), requests, R.nearest_node(requests, *axes(spark)), Q.resolve_fields(requests), limit=40)
    times = fx.grid(spark, d).select(epoch_seconds(F.col("time")).alias("at")).distinct()
    out = R.limited_series(requests, times, 40).select("id", "steps").join(refused.select("id", "code"), "id", "left")
    return out.join(series.groupBy("id").agg(F.count("*").alias("n")), "id", "left").fillna(0, ["n"])
