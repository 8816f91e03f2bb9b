"""Worked examples with values that can be checked by hand, refusals included."""

import pytest
from pyspark.sql import functions as F

from meridian.functions import canon, fields
from meridian.operators import cache, messages, normalize, reading, requests, runs, validate
from meridian.plans.requests import axes


def one(frame):
    return frame.collect()[0]


def test_accumulation(spark):
    rows = spark.createDataFrame([("a", 0, 6, 1.0), ("a", 0, 12, 3.0), ("b", 0, 6, 1.0), ("b", 6, 12, 0.0), ("c", 0, 6, 1.0), ("c", 12, 18, 1.0)], "k string, start_step int, end_step int, value double")
    got = {(r["k"], r["end_step"]): (r["amount"], r["step_range"], r["refusal"]) for r in normalize.interval_amount(rows, ["k"]).collect()}
    assert got["a", 12] == (2.0, "6-12", None) and got["b", 12] == (0.0, "6-12", None) and got["c", 18] == (None, None, "step_range")


def test_units(spark):
    rows = spark.createDataFrame([("2t", 288.15), ("msl", 101325.0)], "asked string, v double").join(canon.catalog(spark), "asked")
    got = {r["asked"]: r["x"] for r in rows.select("asked", F.round(fields.convert(F.col("v"), F.lit("human"), F.col("scale"), F.col("offset")), 6).alias("x")).collect()}
    assert got == {"2t": 15.0, "msl": 1013.25}
    assert one(spark.range(1).select(fields.wind_speed(F.lit(3.0), F.lit(4.0)).alias("w")))["w"] == 5.0
    assert one(spark.range(1).select(fields.round_to(F.lit(21.25), F.lit(1)).alias("x")))["x"] == 21.2


def test_nearest_ties_go_up(spark):
    lats, lons = axes(spark)
    asked = spark.createDataFrame([(1, 72.0, -157.5), (2, -90.0, 180.0)], "id int, lat double, lon double")
    got = {r["id"]: (r["node_lat"], r["node_lon"]) for r in reading.nearest_node(asked, lats, lons).collect()}
    assert got == {1: (90.0, -135.0), 2: (-90.0, 135.0)}
    times = spark.createDataFrame([(0,), (21600,), (43200,)], "at long")
    asked = spark.createDataFrame([(1, 10800), (2, 54000), (3, 54060)], "id int, at long")
    got = {r["id"]: (r["step"], r["code"]) for r in reading.nearest_step(asked, times).collect()}
    assert got == {1: (21600, None), 2: (43200, None), 3: (None, "coverage")}


@pytest.mark.parametrize(("ny", "nx", "limit", "stride"), [(721, 1440, 50_000, 5), (1, 8, 3, 3), (1, 1, 1, 1)])
def test_suggested_stride(spark, ny, nx, limit, stride):
    assert one(spark.range(1).select(fields.suggested_stride(F.lit(ny), F.lit(nx), limit).alias("s")))["s"] == stride


def test_limits_need_no_fields(spark):
    box = spark.createDataFrame([(1, -90.0, -180.0, 90.0, 180.0, 1), (2, 10.0, 10.0, 10.1, 10.1, 1), (3, 10.1, 10.1, 10.2, 10.2, 1)], "id int, south double, west double, north double, east double, stride int")
    got = {r["id"]: (r["points"], r["suggested"], r["code"]) for r in requests.limited_window(box, canon.axis_lat(spark), canon.axis_lon(spark)).collect()}
    assert got[1] == (1_038_240, 5, "points") and got[2][2] is None and got[3][2] == "coverage"


def test_p95_is_the_nearest_rank(spark):
    log = spark.createDataFrame([(i, False, 100) for i in range(19)] + [(19, False, 9000)] + [(i, True, 1) for i in range(50)], "at long, hit boolean, latency_ms long")
    assert tuple(one(cache.miss_latency(log, 0))) == (20, 545.0, 9000)


def test_byte_ranges(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 10, 10), ("a", 100, 10), ("a", 300, None), ("a", 400, 5)], "file string, offset long, length long")
    got = sorted((r["start"], r["stop"] or -1, r["n"]) for r in messages.byte_ranges(rows, 50).collect())
    assert got == [(0, 19, 2), (100, 109, 1), (300, -1, 2)]
    with pytest.raises(ValueError, match="gap"):
        messages.byte_ranges(rows, -1)


def test_read_amplification(spark):
    point = spark.createDataFrame([(1460, 1, 1, 1, 1)], "times int, levels int, lats int, lons int, n long")
    got = {r["layout"]: r["touched"] / r["needed"] for r in runs.read_amplification(point).collect()}
    assert got == {"maps": 1_038_240.0, "series": 16.0}


def test_layer_sizes(spark):
    got = {r["layer"]: round(r["bytes"] / 1e9, 1) for r in runs.layer_bytes(spark).collect()}
    assert got["coarse"] == 14.9 or got["coarse"] == 15.0
    assert got["hourly"] == 2.4 and got["points"] == 1.3 and got["previous"] == 1.3


def test_phase_boundaries(spark):
    rows = spark.createDataFrame([(0,), (25200,), (30600,), (34200,)], "s long").select("s", fields.cycle_phase(F.col("s")).alias("p"))
    assert {r["s"]: r["p"] for r in rows.collect()} == {0: "wait", 25200: "poll", 30600: "fallback", 34200: "missed"}


def test_chunks_before_the_epoch(spark):
    got = one(spark.range(1).select(fields.chunk_number(F.lit(cache.EPOCH - 1), cache.EPOCH, 3600, 24).alias("c")))
    assert got["c"] == -1


def test_duplicate_message_is_rejected(spark):
    listing = spark.createDataFrame([("f", 1, 0), ("f", 1, 0), ("g", 1, 0)], "file string, param int, level int")
    assert {r["file"]: r["passed"] for r in validate.messages_parsed(listing, listing).collect()} == {"f": False, "g": True}


def test_gaps_and_infinities(spark):
    rows = spark.createDataFrame([("a", "2t", 288.0), ("a", "2t", float("nan")), ("a", "2t", float("inf"))], "artifact string, variable string, value float")
    got = one(validate.profile(rows, ["artifact"]))
    assert got["holes"] == 2 and got["low"] == 288.0 and got["high"] == float("inf")


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    assert one(messages.checksum_files(spark, str(tmp_path)))["checksum"] == "sha256:" + hashlib.sha256(b"abc").hexdigest()
    assert tuple(one(messages.folder_bytes(spark, str(tmp_path), quota=2))) == (3, True)
    (tmp_path / "i.idx").write_text("1:0:d:T:surface:anl\n2:10:d:U:surface:anl\n")
    got = [(r["offset"], r["length"], r["param"]) for r in messages.parse_colon_index(messages.read_lines(spark, str(tmp_path / "i.idx"))).orderBy("offset").collect()]
    assert got == [(0, 10, "T"), (10, None, "U")]
