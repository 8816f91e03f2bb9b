"""Queries of the validators: every artifact (a day of the fields) is checked at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import iso
from ..operators import normalize as N
from ..operators import validate as V
from ..sources import fixtures as fx
from ..sources.fixtures import with_tables
from .book import query

_DAY = "strftime(date_trunc('day', time), '%Y-%m-%d')"
_F = f"f AS (SELECT *, {_DAY} AS artifact, CASE WHEN NOT isnan(value) THEN value::DOUBLE END AS x FROM fx_field)"
_RANGES = "ranges AS (SELECT * FROM (VALUES ('2t', 180.0, 340.0), ('10u', -120.0, 120.0), ('10v', -120.0, 120.0), ('msl', 87000.0, 108500.0), ('2d', 150.0, 320.0), ('tcc', 0.0, 1.0), ('i10fg', 0.0, 150.0), ('tp_1h', 0.0, 0.5)) t(variable, lo, hi))"
_STATS = f"{_F}, {_RANGES}, s AS (SELECT artifact, variable, count(*) AS n, count(*) - count(x) AS holes, min(x) AS low, max(x) AS high FROM f GROUP BY ALL)"
KEY = ["artifact"]
_HOURLY = str([*canon.LAYERS["hourly"][0], *canon.LAYERS["hourly"][1]])


def artifacts(spark, d):
    return fx.field(spark, d).withColumn("artifact", F.substring(iso(F.col("time")), 1, 10))


@query("nan_fraction", with_tables(f"{_STATS} SELECT artifact, variable AS field, holes / n::DOUBLE <= 0.001 AS passed FROM s", "fx_field"))
def nan_fraction(spark, d):
    return V.physics_checks(V.profile(artifacts(spark, d), KEY), KEY).where("name = 'nan_fraction'").select("artifact", "field", "passed")


@query("physical_range", with_tables(f"{_STATS} SELECT artifact, variable AS field, low IS NOT NULL AND low >= lo AND high <= hi AS passed FROM s JOIN ranges USING (variable)", "fx_field"))
def physical_range(spark, d):
    return V.physics_checks(V.profile(artifacts(spark, d), KEY), KEY).where("name = 'physical_range'").select("artifact", "field", "passed")


@query("not_constant", with_tables(f"{_STATS} SELECT artifact, variable AS field, low IS NULL OR low <> high AS passed FROM s", "fx_field"))
def not_constant(spark, d):
    return V.physics_checks(V.profile(artifacts(spark, d), KEY), KEY).where("name = 'not_constant'").select("artifact", "field", "passed")


_MEAN = "SELECT artifact, sum(x * cos(radians(lat))) / sum(cos(radians(lat))) AS mean FROM f WHERE variable = '2t' AND x IS NOT NULL GROUP BY artifact"


@query("global_mean_2t", with_tables(f"{_F} SELECT artifact, round(mean, 5) AS mean, coalesce(mean BETWEEN 283 AND 292, false) AS passed FROM ({_MEAN})", "fx_field"))
def global_mean(spark, d):
    return V.global_mean(artifacts(spark, d), KEY).where("mean is not null").select("artifact", F.round("mean", 5).alias("mean"), "passed")


_JUMP = "SELECT variable, max(j) AS jump FROM (SELECT variable, abs(x - lag(value::DOUBLE) OVER (PARTITION BY lat_i, lon_i ORDER BY time)) AS j FROM f WHERE variable = '2t') WHERE NOT isnan(j) GROUP BY variable"


@query("step_jump", with_tables(f"{_F} SELECT round(jump, 4) AS jump, jump <= 15 AS passed FROM ({_JUMP})", "fx_field"))
def step_jump(spark, d):
    return V.step_jump(fx.field(spark, d).withColumn("artifact", F.lit("all")), KEY).select(F.round("jump", 4).alias("jump"), "passed")


@query("grid_shape", with_tables(f"{_F} SELECT artifact, count(DISTINCT lat) || 'x' || count(DISTINCT lon) AS got, count(DISTINCT lat) = 6 AND count(DISTINCT lon) = 8 AS passed FROM f GROUP BY artifact", "fx_field"))
def grid_shape(spark, d):
    return V.grid_shape(artifacts(spark, d), KEY, (6, 8)).select("artifact", "got", "passed")


@query("lon_range", with_tables(f"{_F} SELECT artifact, min(lon) = -180 AND max(lon) = 135 AS passed FROM f GROUP BY artifact", "fx_field"))
def lon_range(spark, d):
    return V.lon_range(artifacts(spark, d), KEY, last=135.0).select("artifact", "passed")


@query("axis_monotonic", with_tables(f"{_F}, ax AS (SELECT DISTINCT artifact, 'lat_descending' AS name, lat_i AS i, -lat AS place FROM f UNION SELECT DISTINCT artifact, 'lon_ascending', lon_i, CASE WHEN artifact LIKE '%-05' AND lon_i = 3 THEN -999 ELSE lon END FROM f) SELECT artifact, name, coalesce(bool_and(place > before), true) AS passed FROM (SELECT *, lag(place) OVER (PARTITION BY artifact, name ORDER BY i) AS before FROM ax) GROUP BY ALL", "fx_field"))
def axis_monotonic(spark, d):
    """On every fifth of a month, one longitude is out of order."""
    odd = F.col("artifact").endswith("-05") & (F.col("lon_i") == 3)
    return V.axis_monotonic(artifacts(spark, d).withColumn("lon", F.when(odd, -999.0).otherwise(F.col("lon"))), KEY).select("artifact", "name", "passed")


@query("time_unique", with_tables(f"{_F} SELECT DISTINCT artifact, artifact NOT LIKE '%-05' AS passed FROM f", "fx_field"))
def time_unique(spark, d):
    field = artifacts(spark, d)
    return V.time_unique(field.unionByName(field.where("artifact like '%-05'")), KEY).select("artifact", "passed")


@query("time_regular", with_tables(f"{_F}, t AS (SELECT artifact, time, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY artifact ORDER BY time) AS d FROM (SELECT DISTINCT artifact, time FROM f)) SELECT artifact, coalesce(bool_and(d = 21600000000), true) AS passed FROM t GROUP BY artifact", "fx_field"))
def time_regular(spark, d):
    return V.time_regular(artifacts(spark, d), KEY, 6).select("artifact", "passed")


@query("fields_present", with_tables(f"{_F}, have AS (SELECT artifact, list(DISTINCT variable) AS v FROM f WHERE NOT (artifact LIKE '%-05' AND variable = 'msl') GROUP BY artifact) SELECT artifact, array_to_string(list_sort([x FOR x IN {_HOURLY} IF NOT list_contains(v, x)]), ',') AS lost, list_has_all(v, {_HOURLY}) AS passed FROM have", "fx_field"))
def fields_present(spark, d):
    """On every fifth of a month, one field is missing."""
    rows = artifacts(spark, d).where("not (artifact like '%-05' and variable = 'msl')")
    return V.fields_present(rows, KEY, "hourly").select("artifact", F.col("got").alias("lost"), "passed")


@query("levels_match", "SELECT o AS artifact, l = [50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000] AS passed FROM (SELECT o_custkey AS o, list_sort(list(DISTINCT ([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000])[o_orderkey % 13 + 1])) AS l FROM orders GROUP BY 1)")
def levels_match(spark, d):
    level = F.element_at(F.array(*map(F.lit, canon.LEVELS)), (F.col("o_orderkey") % 13 + 1).cast("int"))
    rows = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("artifact"), F.lit("t").alias("variable"), level.alias("level"))
    return V.levels_match(rows, KEY).select("artifact", "passed")


@query("units_match", "SELECT p_partkey AS id, p_partkey % 4 = 0 OR p_partkey % 4 = 3 AND p_partkey % 3 = 0 AS passed FROM part".replace(" OR p_partkey % 4 = 3 AND p_partkey % 3 = 0", ""))
def units_match(spark, d):
    k = F.col("p_partkey") % 4
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 3, "xyz").otherwise("2t").alias("variable"), F.when(k == 0, "K").when(k == 1, "degC").when(k == 3, "K").alias("units"))
    return V.units_match(rows, ["id"]).select("id", "passed")


@query("valid_time_consistent", with_tables(f"{_F} SELECT DISTINCT artifact, artifact NOT LIKE '%-07' AS passed FROM f", "fx_field"))
def valid_time_consistent(spark, d):
    lead = F.hour("time")
    init = F.date_trunc("DAY", "time").cast("timestamp_ntz")
    rows = artifacts(spark, d).withColumns({"init_time": init, "lead_hours": F.when(F.col("artifact").endswith("-07"), lead + 1).when(F.col("artifact").endswith("-08"), None).otherwise(lead)})
    return V.valid_time_consistent(rows, KEY).select("artifact", "passed")


@query("messages_parsed", with_tables("SELECT file, count(*) AS expected, count(DISTINCT param * 100 + level) AS got, count(*) = count(DISTINCT param * 100 + level) AS passed FROM fx_message GROUP BY file", "fx_message"))
def messages_parsed(spark, d):
    rows = fx.messages(spark, d)
    return V.messages_parsed(rows, rows.select("file", "param", "level")).select("file", F.col("expected").cast("long").alias("expected"), F.col("got").cast("long").alias("got"), "passed")


def whole_artifacts(spark, d):
    """Days of surface and level fields; on every fifth of a month, one level is missing."""
    levels = fx.level_field(spark, d).where(F.col("level").isin(list(canon.LEVELS)))
    rows = N.with_level(fx.field(spark, d)).unionByName(levels).withColumn("artifact", F.substring(iso(F.col("time")), 1, 10))
    return rows.where("not (artifact like '%-05' and level <=> 500)")


def metadata(spark, d):
    """Units (one wrong on every sixth of a month, one unknown on every eighth) and lead times (wrong on every seventh)."""
    day = F.substring(iso(F.col("time")), 1, 10).alias("artifact")
    days = fx.grid(spark, d).select(day, "time").distinct()
    known = canon.variables(spark).where(F.col("variable").isin([*fx.FORMULAS, "t", "z"])).select("variable", F.col("units").alias("is"))
    wrong = F.col("artifact").endswith("-06") & (F.col("variable") == "2t")
    units = days.select("artifact").distinct().crossJoin(F.broadcast(known)).where("not (artifact like '%-08' and variable = 'msl')")
    lead = F.when(F.col("artifact").endswith("-07"), F.hour("time") + 1).when(F.col("artifact").endswith("-09"), None).otherwise(F.hour("time"))
    leads = days.select("artifact", "time", F.date_trunc("DAY", "time").cast("timestamp_ntz").alias("init_time"), lead.alias("lead_hours"))
    return units.select("artifact", "variable", F.when(wrong, "degC").otherwise(F.col("is")).alias("units")), leads


def day_messages(spark, d):
    """Messages of the days of January: artifact, file, param, level."""
    day = F.format_string("2024-01-%02d", (F.col("file") % 31 + 1).cast("int"))
    return fx.messages(spark, d).select(day.alias("artifact"), "file", "param", "level")


def _all_checks(spark, d, levels=None):
    units, leads = metadata(spark, d)
    listing = day_messages(spark, d)
    return V.validate(whole_artifacts(spark, d), KEY, "points", levels, units, leads, listing, listing, (6, 8), 135.0)


_POINTS = str([*canon.LAYERS["points"][0], *canon.LAYERS["points"][1]])
_WHOLE = f"""f AS (SELECT *, {_DAY} AS artifact, CASE WHEN NOT isnan(value) THEN value::DOUBLE END AS x FROM (SELECT variable, NULL::INT AS level, time, lat_i, lon_i, lat, lon, value FROM fx_field UNION ALL
    SELECT * FROM fx_level WHERE level IN {canon.LEVELS}) WHERE NOT ({_DAY} LIKE '%-05' AND level IS NOT DISTINCT FROM 500))"""
_UNITS = ", ".join(f"('{k}', '{canon.VARIABLES[k][0]}', {canon.VARIABLES[k][1]}, {canon.VARIABLES[k][2]})" for k in [*fx.FORMULAS, "t", "z"])
_FAMILIES = f"""{_WHOLE}, ranges AS (SELECT * FROM (VALUES {_UNITS}) t(variable, unit, lo, hi)), s AS (SELECT artifact, variable, count(*) AS n, count(*) - count(x) AS holes, min(x) AS low, max(x) AS high FROM f GROUP BY ALL),
    shape AS (SELECT artifact, count(DISTINCT lat) = 6 AND count(DISTINCT lon) = 8 AS ok, min(lon) = -180 AND max(lon) = 135 AS lon_ok FROM f GROUP BY artifact),
    reg AS (SELECT artifact, coalesce(bool_and(d = 21600000000), true) AS ok FROM (SELECT artifact, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY artifact ORDER BY time) AS d FROM (SELECT DISTINCT artifact, time FROM f)) GROUP BY artifact),
    jump AS (SELECT artifact, coalesce(max(j) <= 15, true) AS ok FROM (SELECT artifact, CASE WHEN NOT isnan(j) THEN j END AS j FROM (SELECT artifact, abs(value::DOUBLE - lag(value::DOUBLE) OVER (PARTITION BY artifact, lat_i, lon_i ORDER BY time)) AS j FROM f WHERE variable = '2t')) GROUP BY artifact),
    mean AS (SELECT artifact, coalesce(sum(x * cos(radians(lat))) / sum(CASE WHEN x IS NOT NULL THEN cos(radians(lat)) END) BETWEEN 283 AND 292, false) AS ok FROM f WHERE variable = '2t' GROUP BY artifact),
    checks AS (SELECT artifact, 'structure' AS level, 'grid_shape:lat,lon' AS c, ok FROM shape UNION ALL SELECT artifact, 'structure', 'lon_range:lon', lon_ok FROM shape UNION ALL SELECT artifact, 'structure', 'time_regular:time', ok FROM reg
    UNION ALL SELECT artifact, 'sanity', 'step_jump_2t:2t', ok FROM jump UNION ALL SELECT artifact, 'sanity', 'global_mean_2t:2t', ok FROM mean UNION ALL SELECT artifact, 'physics', 'nan_fraction:' || variable, holes / n::DOUBLE <= 0.001 FROM s
    UNION ALL SELECT artifact, 'physics', 'physical_range:' || variable, low IS NOT NULL AND low >= lo AND high <= hi FROM s JOIN ranges USING (variable) UNION ALL SELECT artifact, 'sanity', 'not_constant:' || variable, low IS NULL OR low <> high FROM s
    UNION ALL SELECT artifact, 'structure', 'lat_descending:lat', coalesce(bool_and(d < 0), true) FROM (SELECT artifact, lat - lag(lat) OVER (PARTITION BY artifact ORDER BY lat_i) AS d FROM (SELECT DISTINCT artifact, lat_i, lat FROM f)) GROUP BY artifact
    UNION ALL SELECT artifact, 'structure', 'lon_ascending:lon', coalesce(bool_and(d > 0), true) FROM (SELECT artifact, lon - lag(lon) OVER (PARTITION BY artifact ORDER BY lon_i) AS d FROM (SELECT DISTINCT artifact, lon_i, lon FROM f)) GROUP BY artifact
    UNION ALL SELECT artifact, 'structure', 'time_unique:time', count(*) = count(DISTINCT (variable, level, lat_i, lon_i, time)) FROM f GROUP BY artifact
    UNION ALL SELECT artifact, 'structure', 'levels_match:level', list_sort(list(DISTINCT level) FILTER (level IS NOT NULL)) = {list(canon.LEVELS)} FROM f GROUP BY artifact
    UNION ALL SELECT artifact, 'structure', 'fields_present:points', list_has_all(list(DISTINCT variable), {_POINTS}) FROM f GROUP BY artifact
    UNION ALL SELECT artifact, 'semantics', 'units_match:' || variable, NOT (artifact LIKE '%-06' AND variable = '2t' OR artifact LIKE '%-08' AND variable = 'msl') FROM s
    UNION ALL SELECT artifact, 'semantics', 'time_naive_utc:time', true FROM shape UNION ALL SELECT artifact, 'semantics', 'valid_time_consistent:time', artifact NOT LIKE '%-07' FROM shape
    UNION ALL SELECT printf('2024-01-%02d', file % 31 + 1), 'grib', 'messages_parsed:messages', count(*) = count(DISTINCT (file, param, level)) FROM fx_message GROUP BY 1)"""
_OF = ("fx_field", "fx_level", "fx_message")


@query("checks_summary", with_tables(f"{_FAMILIES} SELECT artifact, bool_and(ok) AS ok, coalesce(string_agg(CASE WHEN NOT ok THEN c END, ',' ORDER BY c), '') AS failed FROM checks GROUP BY artifact", *_OF))
def checks_summary(spark, d):
    return V.summary(_all_checks(spark, d), KEY)


@query("validate", with_tables(f"{_FAMILIES} SELECT artifact, split_part(c, ':', 1) AS name, count(*) AS n, count(*) FILTER (ok) AS passed FROM checks GROUP BY ALL", *_OF))
def validate(spark, d):
    return _all_checks(spark, d).groupBy("artifact", "name").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query("write_check_report", with_tables(f"{_FAMILIES} SELECT artifact, bool_and(ok) AS ok, count(*) AS checks, count(*) FILTER (NOT ok) AS failed, true AS told FROM checks GROUP BY artifact", *_OF))
def check_report(spark, d):
    rows = V.report_documents(_all_checks(spark, d), KEY)
    parsed = F.from_json("report", "ok boolean, checks array<struct<name: string, field: string, passed: boolean, got: string, expected: string>>")
    said = F.col("x.checks")
    told = lambda c: c["got"].isNotNull() & c["expected"].isNotNull() & c["field"].isNotNull()
    rows = rows.select("artifact", parsed.alias("x"))
    return rows.select("artifact", "x.ok", F.size(said).cast("long").alias("checks"), F.size(F.filter(said, lambda c: ~c["passed"])).cast("long").alias("failed"), F.forall(F.filter(said, lambda c: ~c["passed"]), told).alias("told"))
