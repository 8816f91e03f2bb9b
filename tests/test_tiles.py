"""Windows by tiles: against plain arithmetic, on small tiles and on the whole grid."""

import pytest
from pyspark.sql import functions as F

from meridian.functions import canon
from meridian.operators import reading as R
from meridian.operators import tiles as T

BOX = "id int, south double, west double, north double, east double, stride int"


def value(variable, step, i, j):
    return (len(variable) * 100_000 + step * 10_000 + i * 3 + j) % 5003 / 4 + 200


def world(spark, ny, nx, steps=(0,), variables=("2t",), gaps=()):
    rows = spark.range(ny * nx).select((F.col("id") / nx).cast("int").alias("lat_i"), (F.col("id") % nx).cast("int").alias("lon_i"))
    rows = rows.withColumn("variable", F.explode(F.array(*map(F.lit, variables)))).withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    number = F.length("variable") * 100_000 + F.col("step") * 10_000 + F.col("lat_i") * 3 + F.col("lon_i")
    rows = rows.withColumns({"value": (number % 5003 / 4 + 200).cast("float"), "time": F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 6 * step)")})
    for i, j in gaps:
        rows = rows.where(~((F.col("lat_i") == i) & (F.col("lon_i") == j)))
    return rows.drop("step")


def indices(low, high, first, step, n, stride):
    inside = [k for k in range(n) if low <= first + step * k <= high]
    return inside[::stride]


def axes(spark, ny, nx):
    lats = spark.range(ny).selectExpr("cast(id as int) lat_i", "90D - id * 180D / greatest({0} - 1, 1) lat".format(ny))
    lons = spark.range(nx).selectExpr("cast(id as int) lon_i", "-180D + id * 360D / {0} lon".format(nx))
    return lats, lons


def wanted(spark, rows):
    return spark.createDataFrame(rows, "id int, variable string, step int, units string").selectExpr("id", "variable", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 6 * step) as time", "units")


@pytest.mark.parametrize("side", [1, 3, 4, 64])
def test_every_node_of_every_window(spark, side):
    ny, nx, gaps = 10, 16, [(0, 0), (4, 7), (9, 15)]
    boxes = [(1, -90.0, -180.0, 90.0, 180.0, 1), (2, -90.0, -180.0, 90.0, 180.0, 3), (3, -50.0, -90.0, 50.0, 90.0, 2), (4, 10.0, 0.0, 20.0, 10.0, 1), (5, -90.0, -180.0, 90.0, 180.0, 7), (6, 1.0, 1.0, 2.0, 2.0, 1), (7, -90.0, 0.0, 90.0, 0.0, 5), (8, -30.0, 20.0, 30.0, 40.0, 1)]
    asked = [(i, "2t" if i % 2 else "msl", i % 3, "human" if i % 4 == 1 else "si") for i in range(1, 9)]
    tiles = T.tiled(world(spark, ny, nx, (0, 1), ("2t", "msl"), gaps), side=side)
    windows = T.window_tiles(spark.createDataFrame(boxes, BOX), *axes(spark, ny, nx), side=side)
    got = {(r["id"], r["lat_i"], r["lon_i"]): r["value"] for r in T.grid_window(tiles, windows, wanted(spark, asked), side).collect()}
    want, shapes = {}, {}
    for (k, s, w, n, e, stride), (_, variable, step, _) in zip(boxes, asked, strict=True):
        lats, lons = indices(s, n, 90, -20, ny, stride), indices(w, e, -180, 22.5, nx, stride)
        shapes[k] = (len(lats), len(lons))
        want |= {(k, i, j): None if (i, j) in gaps or step > 1 else value(variable, step, i, j) for i in lats for j in lons}
    assert got == want
    compact = {r["id"]: r for r in T.compact_grid(tiles, windows, wanted(spark, asked), canon.catalog(spark), side).collect()}
    assert {k: (r["ny"], r["nx"]) for k, r in compact.items()} == {k: x for k, x in shapes.items() if x[0] * x[1]}
    for k, r in compact.items():
        values = [want[x] for x in sorted(want) if x[0] == k]
        offset, scale, digits = {("2t", "human"): (-273.15, 1, 1), ("2t", "si"): (0, 1, 1), ("msl", "si"): (0, 1, 0)}[asked[k - 1][1], asked[k - 1][3]]
        assert len(r["values"]) == len(values) and all((a is None) == (b is None) and (a is None or abs(a - (b * scale + offset)) <= 0.5001 * 10**-digits) for a, b in zip(r["values"], values, strict=True))


def test_the_whole_grid_moves_a_row_for_each_tile(spark):
    """721 x 1440: what is shuffled for a request is one row a tile; limits hold before any map is read."""
    boxes = [(1, -90.0, -180.0, 90.0, 180.0, 5), (2, 35.0, -10.0, 60.0, 30.0, 1), (3, -90.0, -180.0, 90.0, 180.0, 1), (4, 0.0, 0.0, 0.0, 0.0, 1), (5, -90.0, -180.0, 90.0, 180.0, 100)]
    lats, lons = canon.axis_lat(spark), canon.axis_lon(spark)
    windows = T.window_tiles(spark.createDataFrame(boxes, BOX), lats, lons)
    # Of the whole grid there are 12 x 23 tiles; a stride of 100 meets eight rows and fifteen columns of them; a million points are refused.
    rows = {r["id"]: r["count"] for r in windows.groupBy("id").count().collect()}
    assert rows == {1: 12 * 23, 2: 3 * 4, 4: 1, 5: 8 * 15}
    asked = wanted(spark, [(k, "2t", 0, "si") for k in range(1, 6)])
    tiles = T.tiled(world(spark, 721, 1440))
    got = T.grid_window(tiles, windows, asked)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "Python" not in text
    found = {r["id"]: r for r in got.groupBy("id").agg(F.count("*").alias("n"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.count_if(F.abs(F.col("value") - ((F.lit(200_000) + F.col("lat_i") * 3 + F.col("lon_i")) % 5003 / 4 + 200)) > 1e-3).alias("wrong")).collect()}
    assert {k: (r["n"], r["a"], r["b"], r["c"], r["d"], r["wrong"]) for k, r in found.items()} == {
        1: (145 * 288, -90.0, 90.0, -180.0, 178.75, 0), 2: (101 * 161, 35.0, 60.0, -10.0, 30.0, 0), 4: (1, 0.0, 0.0, 0.0, 0.0, 0), 5: (8 * 15, -85.0, 90.0, -180.0, 170.0, 0)
    }


def test_values_that_round_to_zero_have_no_sign(spark):
    field = spark.createDataFrame([(0, 0, -0.04), (0, 1, 0.04), (0, 2, -0.06), (0, 3, float("nan"))], "lat_i int, lon_i int, value float").selectExpr("'10u' as variable", "timestamp_ntz '2024-01-01' as time", "*")
    lats, lons = spark.createDataFrame([(0, 0.0)], "lat_i int, lat double"), spark.createDataFrame([(k, float(k)) for k in range(4)], "lon_i int, lon double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0, 1)], BOX)
    row = T.compact_grid(T.tiled(field), T.window_tiles(boxes, lats, lons), wanted(spark, [(1, "10u", 0, "si")]), canon.catalog(spark)).first()
    assert [str(x) for x in row["values"]] == ["0.0", "0.0", "-0.1", "None"]


def test_ends_of_a_layer(spark):
    ends = lambda *at: tuple(R._ends(spark.createDataFrame([(x,) for x in at], "at long")).first())
    assert ends(50, 10, 31, 90) == (10, 90, 10) and ends(7) == (7, 7, 10800) and ends() == (None, None, 10800)
