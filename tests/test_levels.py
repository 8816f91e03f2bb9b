"""Level fields: stored, scanned and ordered by level; layers of runs read through the pointer."""

import pytest

from meridian.functions import canon
from meridian.operators import normalize as N
from meridian.sources import layers as L


def some(spark, levels=(10, 50, 500, 1000), times=2):
    rows = [(v, level, f"2024-01-0{t + 1} 00:00:00", i, j, 90.0 - 180 * i, -180.0 + 90 * j, float(100 * t + (level or 0) + i + j)) for v, ls in (("2t", [None]), ("t", levels)) for level in ls for t in range(times) for i in range(2) for j in range(3)]
    return spark.createDataFrame(rows, "variable string, level int, time string, lat_i int, lon_i int, lat double, lon double, value float").selectExpr("variable", "level", "cast(time as timestamp_ntz) as time", "lat_i", "lon_i", "lat", "lon", "value")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_levels_reach_the_scan(spark, tmp_path):
    L.write_layer(some(spark), str(tmp_path / "x"), "coarse")
    rows = L.scan_archive_slice(spark, str(tmp_path / "x"), "t", "2024-01-02T00:00:00")
    assert [r["level"] for r in rows.collect()] == sorted([50, 500, 1000] * 6)
    pushed = str(scan_of(rows).metadata().get("PushedFilters").get())
    assert "In(level, [" in pushed and "time" in pushed
    assert [r["level"] for r in L.scan_archive_slice(spark, str(tmp_path / "x"), "t", "2024-01-01T00:00:00", [10]).collect()] == [10] * 6
    surface = L.scan_archive_slice(spark, str(tmp_path / "x"), "2t", "2024-01-01T00:00:00", [500]).collect()
    assert len(surface) == 6 and surface[0]["level"] is None and (surface[0]["lat"], surface[0]["lon"]) == (90.0, -180.0)
    both = L.scan_layer(spark, str(tmp_path / "x"), ["2t", "t"], levels=[500])
    assert {(r["variable"], r["level"]) for r in both.collect()} == {("2t", None), ("t", 500)}


def test_canonical_order_and_place(spark):
    rows = some(spark, canon.LEVELS[::-1], 1)
    places = sorted((r["place"] for r in N.canonical_place(rows.where("variable = 't'"), 2, 3).collect()))
    assert places == list(range(13 * 6))
    ordered = N.in_canonical_order(rows.where("variable = 't'")).collect()
    keys = [(r["level"], -r["lat"], r["lon"]) for r in ordered]
    assert keys == sorted(keys) and N.canonical_place(some(spark, (775,), 1).where("variable = 't'"), 2, 3).where("place is null").count() == 6


def test_a_run_is_found_through_the_pointer_and_others_are_not_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, shift in (("2024-01-01T00Z", 0), ("2024-01-01T06Z", 1000), ("2024-01-01T12Z", 2000)):
        L.write_run(some(spark).withColumn("value", fn(shift)), path, run, "coarse")
    with pytest.raises(Exception, match="(?i)exist"):
        L.write_run(some(spark), path, "2024-01-01T06Z", "coarse")
    spark.createDataFrame([(1, "2024-01-01T00Z"), (3, "2024-01-01T06Z"), (2, "2024-01-01T12Z")], "seq long, current string").write.parquet(str(tmp_path / "pointer"))
    pointer = spark.read.parquet(str(tmp_path / "pointer"))
    rows = L.scan_run(spark, path, pointer, "coarse", ["t"], levels=[500])
    assert "dynamicpruning" in plan(rows) and ("In(level" in plan(rows) or "EqualTo(level,500)" in plan(rows))
    got = rows.collect()
    assert len(got) == 12 and {r["run_id"] for r in got} == {"2024-01-01T06Z"} and all(1000 <= r["value"] < 2000 for r in got)
    one = len(list((tmp_path / "runs" / "run_id=2024-01-01T06Z" / "layer=coarse" / "variable=t").glob("*.parquet")))
    assert sorted(files_read(rows)) == sorted([one, len(list((tmp_path / "pointer").glob("*.parquet")))])


def fn(shift):
    from pyspark.sql import functions as F

    return (F.col("value") + shift).cast("float")


def scan_of(frame):
    """The first scan of files in a plan."""
    todo = [frame._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            return node
        todo.extend(node.children().apply(k) for k in range(node.children().size()))


def files_read(frame):
    """How many files each scan of a frame that ran has read."""
    out, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            found = node.metrics().get("numFiles")
            if found.isDefined():
                out.append(found.get().value())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo.extend(children.apply(k) for k in range(children.size()))
    return out


def test_an_artifact_keeps_its_metadata(spark, tmp_path):
    units = spark.createDataFrame([("2t", "K")], "variable string, units string")
    leads = spark.sql("select timestamp_ntz '2024-01-01' as time, timestamp_ntz '2024-01-01' as init_time, 0 as lead_hours")
    L.write_artifact(some(spark), units, leads, str(tmp_path / "a"), "coarse")
    field, u, t = L.read_artifact(spark, str(tmp_path / "a"))
    assert field.count() == some(spark).count() and u.collect() == units.collect() and t.select(*leads.columns).collect() == leads.collect()
