"""Snapshots and pointers, buckets of nodes, checks from the pass that writes, weights, exports and replaced data."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from meridian.operators import history as H
from meridian.operators import reading as R
from meridian.operators import requests as Q
from meridian.operators import runs as U
from meridian.operators import validate as V
from meridian.plans.requests import axes
from meridian.sources import fixtures as fx
from meridian.sources import layers as L
from meridian.sources import snapshots


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, n long")


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(LookupError):
        snapshots.read(spark, path)
    assert snapshots.read(spark, path, "key string").count() == 0
    assert snapshots.commit(table(spark, ("a", 1)), path) == 1
    # The writer dies between the rows and the pointer.
    real = snapshots.POINTER
    monkeypatch.setattr(snapshots, "POINTER", "broken")
    with pytest.raises(Exception):  # noqa: B017
        snapshots.commit(table(spark, ("b", 2)), path, after=1)
    monkeypatch.setattr(snapshots, "POINTER", real)
    assert len(list((tmp_path / "t" / "snapshots").iterdir())) == 2
    assert [tuple(r) for r in snapshots.read(spark, path).collect()] == [("a", 1)]
    # The next one takes the number that was left free, and sees the old table.
    rows = snapshots.update(spark, path, lambda old: old.withColumn("n", F.col("n") + 10))
    assert [tuple(r) for r in rows.collect()] == [("a", 11)] and snapshots.newest(spark, path)[0] == 2


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(table(spark, ("a", 1)), path)
    held = snapshots.read(spark, path)
    snapshots.commit(table(spark, ("b", 2)), path, after=1)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(table(spark, ("c", 3)), path, after=1)
    assert [tuple(r) for r in snapshots.read(spark, path).collect()] == [("b", 2)]
    assert [tuple(r) for r in held.collect()] == [("a", 1)]  # a reader keeps the snapshot that it began with


def above_fields(frame):
    """Exchanges between the scan of the bucketed fields and the result."""
    found = []

    def walk(node, above):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.inputPlan(), above)
        if "Exchange" in name and "Broadcast" not in name:
            above = above + [name]
        if "Scan parquet" in name and "Bucketed: true" in node.simpleString(10_000) + node.verboseStringWithOperatorId():
            found.append(above)
        for k in range(node.children().size()):
            walk(node.children().apply(k), above)

    walk(frame._jdf.queryExecution().executedPlan(), [])
    return found


def test_point_series_of_buckets_have_no_exchange_above_the_fields(spark, tmp_path):
    L.write_series_table(fx.field(spark, SMALL), "series_test", str(tmp_path / "s"), "points", buckets=4)
    requests = fx.point_requests(spark, SMALL)
    ask = lambda field: R.point_series(field, R.nearest_node(requests, *axes(spark)), Q.resolve_fields(requests), requests.select("id", "units"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # requests too large to be sent to every task
    try:
        rows = ask(spark.table("series_test"))
        assert above_fields(rows) == [[]]
        stored = rows.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, stored)) == sorted(map(key, ask(fx.field(spark, SMALL)).collect()))
    spark.sql("drop table series_test")


def test_checks_of_the_write_are_those_of_a_scan(spark, tmp_path):
    field = fx.field(spark, SMALL).withColumn("value", F.when(F.col("variable") == "tcc", float("nan")).otherwise(F.col("value")).cast("float"))
    stats = L.write_checked(field, str(tmp_path / "x"), "analysis").withColumn("a", F.lit(1))
    stored = spark.read.schema(L.FIELD).parquet(str(tmp_path / "x")).withColumn("a", F.lit(1))
    checks = lambda s: sorted(map(tuple, V.physics_checks(s, ["a"]).collect()), key=str)
    assert checks(stats) == checks(V.profile(stored, ["a"])) and {"tp_1h", "i10fg"} & {r["variable"] for r in stats.collect()} == set()
    assert ("physical_range", "tcc", False) in {(x[2], x[3], x[4]) for x in checks(stats)}


def test_weights_of_layers_runs_and_pinned(spark):
    want = {r["layer"]: r["bytes"] for r in U.layer_bytes(spark).collect()}
    assert [round(want[x] / 1e9, 1) for x in ("coarse", "hourly", "points", "previous")] == [15.0, 2.4, 1.3, 1.3]
    stored = spark.createDataFrame([("r", "coarse", 10), ("r", "coarse", 5), ("r", "hourly", 2), ("r", "points", 1), ("r", "previous", 1), ("r", "analysis", 7), ("q", "points", 3)], "run_id string, layer string, values long")
    got = {(r["scope"], r["run_id"], r["name"]): (r["bytes"], r["expected"]) for r in U.layer_weights(stored).collect()}
    assert got["run", "r", "run"] == (68, want["coarse"] + want["hourly"]) and abs(got["run", "r", "run"][1] / 1e9 - 17.4) < 0.1
    assert got["pinned", "r", "pinned"][0] == 76 and abs(got["pinned", "r", "pinned"][1] / 1e9 - 20.1) < 0.1
    assert got["layer", "r", "analysis"] == (28, want["analysis"]) and got["pinned", "q", "pinned"] == (12, want["points"]) and ("run", "q", "run") not in got
    assert len(got) == 9


def test_exports_are_written_with_their_origin(spark, tmp_path):
    field = fx.field(spark, SMALL)
    rows = H.export_region(field, -90, 90, -180, 180, ["2t"], "2024-01-02T00:00:00", "2024-01-03T00:00:00")
    job = H.write_export(rows, str(tmp_path), "exp_1", "era5-final", "2024-01-01T00:00:00Z", 1000)
    stored = spark.read.parquet(job.first()["url"])
    assert stored.count() == rows.count() > 0 and {tuple(r) for r in stored.select("source", "init_time", "variable").distinct().collect()} == {("era5-final", "2024-01-01T00:00:00Z", "2t")}
    assert 0 < rows.count() < field.where("variable = '2t'").count()
    jobs = spark.read.schema(H.JOB).option("recursiveFileLookup", "true").json(str(tmp_path / "jobs"))
    asked = spark.createDataFrame([("exp_1",), ("exp_2",)], "job_id string")
    code = lambda now: {r["job_id"]: (r["code"], r["url"] is not None) for r in H.export_status(asked, jobs, now).collect()}
    assert code(999) == {"exp_1": (200, True), "exp_2": (404, False)} and code(1000)["exp_1"] == (410, False)
    with pytest.raises(Exception, match="(?i)exist"):
        H.write_export(rows, str(tmp_path), "exp_1", "era5-final", "2024-01-01T00:00:00Z", 1000)


def test_final_data_makes_preliminary_cache_rows_stale(spark):
    index = spark.createDataFrame([("a", "era5t"), ("a", "era5-final"), ("b", "era5t")], "key string, source_version string")
    final = spark.createDataFrame([("a",)], "key string")
    assert [tuple(r) for r in H.stale(index, final).collect()] == [("a", "era5t")]
