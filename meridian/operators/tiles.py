"""Map windows by tiles: blocks of a map's nodes as rows, and requests cut out of the blocks that they touch.

A request for a window becomes a row for each tile of it, never a row for each node, and a map a
row for each tile (an array, row by row from the north-west). They meet on (variable, time, tile); the
window is cut out inside the array by index arithmetic. What is shuffled for a request grows with
its tiles, and a map that many requests ask for is still one array a tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import coordinate, nan_to_null, round_to
from .reading import window_size

#: Nodes of a tile's side.
SIDE = 64
TILES = "variable string, time timestamp_ntz, tile_lat int, tile_lon int, values array<float>"


def tiled(field: DataFrame, keys: Sequence[str] = ("variable", "time"), side: int = SIDE) -> DataFrame:
    """keys, tile_lat, tile_lon, values: a map's nodes in tiles of side x side.

    Node (i, j) of a tile has place i * side + j in values. Missing nodes are null there; after the last node
    the array ends. Of several values of a node the smallest counts.
    """
    place = (F.col("lat_i") % side * side + F.col("lon_i") % side).cast("int")
    cell = F.struct(place.alias("place"), F.col("value").cast("float").alias("value"))
    tile = lambda x: F.floor(F.col(f"{x}_i") / side).cast("int").alias(f"tile_{x}")
    rows = field.groupBy(*keys, tile("lat"), tile("lon")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    places = F.transform("cells", lambda c: c["place"])
    before = F.concat(F.array(F.lit(-1)), F.slice(places, 1, F.greatest(F.size("cells") - 1, F.lit(0))))
    blank = F.lit(None).cast("float")
    filled = F.zip_with("cells", before, lambda c, p: F.when(c["place"] == p, F.array().cast("array<float>")).otherwise(F.concat(F.array_repeat(blank, c["place"] - p - 1), F.array(c["value"]))))
    return rows.select(*keys, "tile_lat", "tile_lon", F.flatten(filled).alias("values"))


def window_tiles(boxes: DataFrame, lats: DataFrame, lons: DataFrame, limit: int | None = canon.MAX_POINTS, side: int = SIDE) -> DataFrame:
    """id, stride, tile_lat, tile_lon, the first and last index of the window's nodes in the tile (lat_a, lat_b, lon_a, lon_b) and the axes.

    boxes: id, south, west, north, east, stride. Every row has a node at least. Boxes of more than limit nodes have
    none (limited_window() says so), so no map is read for them.
    """
    rows = window_size(boxes, lats, lons).where("points > 0" if limit is None else f"points between 1 and {limit}")
    stride = F.col("stride")
    for name in ("lat", "lon"):
        first = F.col(f"{name}_a")
        rows = rows.withColumn(f"{name}_z", first + F.floor((F.col(f"{name}_b") - first) / stride).cast("int") * stride)
        last = F.col(f"{name}_z")
        # A stride beyond a tile's side may leap over tiles.
        leaps = F.transform(F.sequence(first, last, F.greatest(stride, F.lit(1))), lambda i: F.floor(i / side).cast("int"))
        tiles = F.when(stride > side, leaps).otherwise(F.sequence(F.floor(first / side).cast("int"), F.floor(last / side).cast("int")))
        rows = rows.withColumn(f"tile_{name}", F.explode(tiles))
    for name in ("lat", "lon"):
        first, begins = F.col(f"{name}_a"), F.col(f"tile_{name}") * side
        inside = first + F.ceil(F.greatest(begins - first, F.lit(0)) / stride).cast("int") * stride
        rows = rows.withColumns({f"{name}_a": inside.cast("int"), f"{name}_b": F.least(F.col(f"{name}_z"), begins + side - 1).cast("int")})
    axes = [f"{x}_{y}" for x in ("lat", "lon") for y in ("0", "d")]
    return rows.select("id", "stride", "tile_lat", "tile_lon", "lat_a", "lat_b", "lon_a", "lon_b", *axes)


def window_pieces(tiles: DataFrame, windows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of window_tiles() with variable, time and the tile's values (null where there is none). wanted: id, variable, time."""
    pieces = windows.join(wanted.select("id", "variable", "time"), "id")
    return pieces.join(tiles, ["variable", "time", "tile_lat", "tile_lon"], "left")


def _lines(side: int) -> Column:
    """(lat_i, lon_i of the first, values) of each line that a piece cuts out of its tile."""
    stride = F.col("stride")

    def line(i: Column) -> Column:
        begins = (i - F.col("tile_lat") * side) * side - F.col("tile_lon") * side
        cut = F.transform(F.sequence(F.col("lon_a"), F.col("lon_b"), stride), lambda j: F.get(F.col("values"), begins + j))
        return F.struct(i.alias("lat_i"), F.col("lon_a").alias("lon_i"), cut.alias("cut"))

    return F.transform(F.sequence(F.col("lat_a"), F.col("lat_b"), stride), line)


def grid_window(tiles: DataFrame, windows: DataFrame, wanted: DataFrame, side: int = SIDE) -> DataFrame:
    """id, lat_i, lon_i, lat, lon, value: thinned windows of one variable at one moment, a row for each node."""
    rows = window_pieces(tiles, windows, wanted).select("id", "stride", "lat_0", "lat_d", "lon_0", "lon_d", F.explode(_lines(side)).alias("line"))
    rows = rows.select("*", F.posexplode("line.cut").alias("k", "value")).withColumns({"lat_i": F.col("line.lat_i"), "lon_i": (F.col("line.lon_i") + F.col("k") * F.col("stride")).cast("int")})
    at = lambda x: (F.col(f"{x}_0") + F.col(f"{x}_i") * F.col(f"{x}_d")).alias(x)
    return rows.select("id", "lat_i", "lon_i", at("lat"), at("lon"), F.col("value").cast("double").alias("value"))


def compact_grid(tiles: DataFrame, windows: DataFrame, wanted: DataFrame, catalog: DataFrame, side: int = SIDE) -> DataFrame:
    """One row a request: lat0, lon0, dlat, dlon, ny, nx and values north to south, west to east, rounded by unit.

    wanted: id, variable, time, units. Lines stay arrays from the tile to the answer, whose size is bounded by the
    limit on points. Rounding is half to even, and a value that rounds to zero has no sign. Axes fall in latitude and rise in longitude.
    """
    info = catalog.select(F.col("asked").alias("variable"), "unit_si", "unit_human", "scale", "offset", "digits_si", "digits_human")
    pieces = window_pieces(tiles, windows, wanted).withColumn("lines", _lines(side))
    out = pieces.groupBy("id", "variable").agg(
        F.min("lat_a").alias("lat_i"), F.min("lon_a").alias("lon_i"), F.first("stride").alias("stride"), *[F.first(x).alias(x) for x in ("lat_0", "lat_d", "lon_0", "lon_d")],
        F.flatten(F.collect_list("lines")).alias("lines"),
    )
    lines = F.array_sort("lines")
    out = out.withColumns({"ny": F.size(F.array_distinct(F.transform("lines", lambda x: x["lat_i"]))), "all": F.flatten(F.transform(lines, lambda x: x["cut"]))})
    out = out.join(wanted.select("id", "units"), "id").join(F.broadcast(info), "variable")
    human = F.col("units") == "human"
    digits = F.when(human, F.col("digits_human")).otherwise(F.col("digits_si"))

    def shown(v: Column) -> Column:
        v = v.cast("double")
        return nan_to_null(round_to(F.when(human, v * F.col("scale") + F.col("offset")).otherwise(v), digits) + F.lit(0.0))

    corner = lambda x: coordinate(F.col(f"{x}_0") + F.col(f"{x}_i") * F.col(f"{x}_d")).alias(f"{x}0")
    gap = lambda x: (F.col(f"{x}_d") * F.col("stride")).alias(f"d{x}")
    nx = (F.size("all") / F.col("ny")).cast("long").alias("nx")
    return out.select("id", corner("lat"), corner("lon"), gap("lat"), gap("lon"), F.col("ny").cast("long").alias("ny"), nx, F.transform("all", shown).alias("values"))
