"""Checks that pass, fail or do not apply."""

import pytest
from pyspark.sql import functions as F

from meridian.functions import canon
from meridian.operators import validate as V


def _checks(spark, rows):
    frame = spark.createDataFrame(rows, "artifact string, variable string, value float")
    return {(r["name"], r["field"]): r["passed"] for r in V.physics_checks(V.profile(frame, ["artifact"]), ["artifact"]).collect()}


def test_fields_without_a_range_have_no_range_check(spark):
    got = _checks(spark, [("a", "mystery", 1.0), ("a", "mystery", 2.0), ("a", "2t", 280.0), ("a", "2t", 999.0)])
    assert ("physical_range", "mystery") not in got and got["physical_range", "2t"] is False
    assert got["not_constant", "mystery"] and got["nan_fraction", "mystery"]


def test_a_field_of_gaps_only_has_no_range(spark):
    nan = float("nan")
    got = _checks(spark, [("a", "2t", nan), ("a", "2t", nan), ("a", "msl", 101325.0), ("a", "msl", 101325.0), ("a", "mystery", nan)])
    assert got["nan_fraction", "2t"] is False and got["not_constant", "2t"] and got["physical_range", "2t"] is False
    assert got["not_constant", "msl"] is False and ("physical_range", "mystery") not in got


def _names(checks):
    return {(r["level"], r["name"], r["field"]): (r["passed"], r["got"], r["expected"]) for r in checks.collect()}


def _artifact(spark, levels=canon.LEVELS, times=2):
    """One artifact on a 2 x 2 grid: 2t, and t on levels."""
    nodes = [(i, j, 90.0 - 180 * i, -180.0 + 180 * j) for i in range(2) for j in range(2)]
    rows = [("a", v, level, step, *n, 287.0 + step + n[1] / 10) for v, ls in (("2t", [None]), ("t", levels)) for level in ls for step in range(times) for n in nodes]
    frame = spark.createDataFrame(rows, "artifact string, variable string, level int, step int, lat_i int, lon_i int, lat double, lon double, value float")
    return frame.withColumn("time", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 6 * step)")).drop("step")


def _metadata(spark, units, leads):
    rows = spark.createDataFrame([("a", *x) for x in leads], "artifact string, step int, lead_hours int").selectExpr("artifact", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 6 * step) as time", "timestamp_ntz '2024-01-01' as init_time", "lead_hours")
    return spark.createDataFrame([("a", *x) for x in units], "artifact string, variable string, units string"), rows


def test_all_levels_of_checks_in_one_result(spark):
    units, leads = _metadata(spark, [("2t", "degC"), ("t", "K")], [(0, 0), (1, 7)])
    listing = spark.createDataFrame([("a", 1, None), ("a", 2, 500), ("a", 2, 500)], "artifact string, param int, level int")
    got = _names(V.validate(_artifact(spark, (50, 500)), ["artifact"], "points", None, units, leads, listing, listing, (2, 2), 0.0))
    structure = {n for level, n, _ in got if level == "structure"}
    assert structure == {"grid_shape", "lat_descending", "lon_range", "lon_ascending", "levels_match", "fields_present", "time_unique", "time_regular"}
    assert {(n, f): x[0] for (level, n, f), x in got.items() if level == "semantics"} == {("units_match", "2t"): False, ("units_match", "t"): True, ("time_naive_utc", "time"): True, ("valid_time_consistent", "time"): False}
    assert got["semantics", "units_match", "2t"] == (False, "degC", "K")
    assert got["semantics", "valid_time_consistent", "time"] == (False, "2024-01-01T06:00:00Z", "2024-01-01T07:00:00Z")
    assert got["structure", "levels_match", "level"][:2] == (False, "50,500") and got["grib", "messages_parsed", "messages"] == (False, "2", "3")
    assert got["structure", "fields_present", "points"][0] is False
    whole = _names(V.validate(_artifact(spark), ["artifact"], "points", ["structure"], shape=(2, 2), last_lon=0.0))
    assert whole["structure", "levels_match", "level"][0] and {x[0] for x in whole} == {"structure"}
    assert whole["structure", "time_unique", "time"][0]  # a node has a value for each level
    surface = _names(V.validate(_artifact(spark).where("variable = '2t'"), ["artifact"], "points", shape=(2, 2), last_lon=0.0))
    assert surface["structure", "levels_match", "level"][0] and surface["semantics", "units_match", "2t"] == (False, "none", "K") and surface["semantics", "valid_time_consistent", "time"][0]
    flat = _names(V.validate(_artifact(spark).withColumn("level", F.lit(None).cast("int")).dropDuplicates(["variable", "time", "lat_i", "lon_i"]), ["artifact"], "points", shape=(2, 2), last_lon=0.0))
    assert flat["structure", "levels_match", "level"][0] is False  # level fields without levels
    static = _names(V.validate(_artifact(spark), ["artifact"], "points", shape=(2, 2), last_lon=0.0, static=True))
    assert "lsm" in static["structure", "fields_present", "points"][1]


def test_unknown_levels_and_layers_are_refused(spark):
    field = _artifact(spark)
    for levels, layer, text in ((["structure", "magic"], "points", "magic"), (["grib"], "points", "listing"), (None, "nowhere", "nowhere")):
        with pytest.raises(ValueError, match=text):
            V.validate(field, ["artifact"], layer, levels)


def test_time_without_zone(spark):
    rows = spark.sql("select timestamp_ntz '2024-01-01' as time, 1 as v")
    assert V.time_naive(rows) and not V.time_naive(rows.selectExpr("cast(time as timestamp) as time"))


def test_all_checks_take_one_scan(spark):
    from conftest import SMALL

    from meridian.plans import registry

    plan = registry.QUERIES["validate"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 9 and plan.count("Exchange") <= 24
