"""Decoded provider rows to the canonical form, and accumulated fields to amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon

COORDINATES = {"latitude": "lat", "longitude": "lon", "isobaricInhPa": "level"}


def rename_coords(rows: DataFrame) -> DataFrame:
    """Provider axis names to lat, lon and level; absent ones are ignored."""
    return rows.withColumnsRenamed({k: v for k, v in COORDINATES.items() if k in rows.columns})


def rename_variables(rows: DataFrame) -> DataFrame:
    """Adds variable by (source, provider_name); null for a name that is not listed."""
    return rows.join(F.broadcast(canon.names(rows.sparkSession)), ["source", "provider_name"], "left")


def unlisted_names(rows: DataFrame) -> DataFrame:
    """source, names: the offenders of each source."""
    bad = rows.where("variable is null").groupBy("source").agg(F.array_sort(F.collect_set("provider_name")).alias("names"))
    return bad


def order() -> list[Column]:
    """The order of stored rows: levels as the contract lists them, surface first, from the north-west on."""
    return [F.col("variable"), F.col("time"), F.asc_nulls_first("level"), F.desc("lat"), F.col("lon")]


def with_level(rows: DataFrame) -> DataFrame:
    """Adds an empty level to surface rows that have no such column."""
    return rows if "level" in rows.columns else rows.withColumn("level", F.lit(None).cast("int"))


def in_canonical_order(rows: DataFrame) -> DataFrame:
    """All rows in order(): maps in ranges of (variable, time, level), each sorted where it lies."""
    rows = with_level(rows)
    return rows.repartitionByRange(*order()[:3]).sortWithinPartitions(*order())


def canonical_place(rows: DataFrame, n_lat: int = canon.N_LAT, n_lon: int = canon.N_LON) -> DataFrame:
    """Adds place: where a value stands in its variable's array of one moment (levels, then latitudes, then longitudes), from 0.

    It is arithmetic on indices, so no map is sorted for it. Levels that the contract doesn't list have no place.
    """
    rows = with_level(rows)
    known = F.array(*map(F.lit, canon.LEVELS))
    number = F.when(F.col("level").isNull(), 0).otherwise(F.nullif(F.array_position(known, F.col("level")), F.lit(0)) - 1)
    return rows.withColumn("place", ((number * n_lat + F.col("lat_i")) * n_lon + F.col("lon_i")).cast("long"))


def lon_wrap(rows: DataFrame) -> DataFrame:
    lon = F.bround("lon", 2)
    return rows.withColumn("lon", F.when(lon >= 180, lon - 360).otherwise(lon))


def lat_round(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lat", F.bround("lat", 2))


def axis_index(rows: DataFrame, lats: DataFrame, lons: DataFrame) -> DataFrame:
    """Adds lat_i (from the north) and lon_i by joins to the axes; rows off the axes get null."""
    return rows.join(F.broadcast(lats), "lat", "left").join(F.broadcast(lons), "lon", "left")


def grid_check(rows: DataFrame, lats: DataFrame, lons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, got_lat, got_lon, off_axis, ok: node-by-node equality of each field with the axes."""
    found = rows.groupBy(*keys).agg(
        F.count_distinct("lat").alias("got_lat"),
        F.count_distinct("lon").alias("got_lon"),
        F.count_if(F.col("lat_i").isNull() | F.col("lon_i").isNull()).alias("off_axis"),
    )
    want = lats.agg(F.count("*").alias("n_lat")).crossJoin(lons.agg(F.count("*").alias("n_lon")))
    found = found.crossJoin(F.broadcast(want))
    ok = (F.col("off_axis") == 0) & (F.col("got_lat") == F.col("n_lat")) & (F.col("got_lon") == F.col("n_lon"))
    return found.select(*keys, "got_lat", "got_lon", "off_axis", ok.alias("ok"))


def valid_time(rows: DataFrame) -> DataFrame:
    """time is the message's valid time; init_time keeps the run's start."""
    return rows.withColumn("init_time", F.col("time")).withColumn("time", F.col("valid_time")).drop("valid_time")


def scale_to_si(rows: DataFrame) -> DataFrame:
    """value as float times the factor of (source, variable), 1 if there is none."""
    rows = rows.join(F.broadcast(canon.scales(rows.sparkSession)), ["source", "variable"], "left")
    value = F.col("value").cast("float") * F.coalesce("factor", F.lit(1.0)).cast("float")
    return rows.withColumn("value", value.cast("float")).drop("factor")


def with_units(rows: DataFrame) -> DataFrame:
    table = F.broadcast(canon.variables(rows.sparkSession).select("variable", "units"))
    return rows.join(table, "variable", "left")


def with_provenance(rows: DataFrame, url: str, retrieved_at: str, kind: str = "analysis", version: str = "1.0.0") -> DataFrame:
    """Adds the provenance columns; rows of an unknown source are refused by source_known."""
    given = {"source_url": url, "retrieved_at": retrieved_at, "kind": kind, "grid": "0.25deg-global", "adapter_version": version}
    return rows.withColumns({k: F.lit(v) for k, v in given.items()}).withColumn("source_known", F.col("source").isin(*canon.SOURCES, "era5"))


def to_canonical(rows: DataFrame, lats: DataFrame, lons: DataFrame) -> DataFrame:
    """The whole chain on (source, provider_name, time, valid_time, level, lat, lon, value) rows.

    All tables that it joins are constants of a bounded size, so the plan has no shuffle.
    """
    rows = rename_variables(rename_coords(rows)).where("variable is not null")
    rows = valid_time(lat_round(lon_wrap(rows))).withColumn("level", F.col("level").cast("int"))
    return with_units(scale_to_si(axis_index(rows, lats, lons)))


def select_layer(rows: DataFrame, layer: str) -> DataFrame:
    """Exactly the fields of a layer."""
    wanted = canon.layers(rows.sparkSession).where(F.col("layer") == layer).select("variable")
    return rows.join(F.broadcast(wanted), "variable", "left_semi")


def missing_fields(rows: DataFrame, layer: str) -> DataFrame:
    wanted = canon.layers(rows.sparkSession).where(F.col("layer") == layer).select("variable")
    return wanted.join(rows.select("variable").distinct(), "variable", "left_anti")


def interval_amount(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accumulated values to amounts of each interval: value, start_step, step_range or a refusal.

    rows: keys, start_step, end_step, value. Same start as the previous row: the difference, from
    the previous end. A start at the previous end: as it is. The first row of a key from step 0
    or on its own: as it is. All else, and an end that does not grow, is refused.
    """
    order = Window.partitionBy(*keys).orderBy("end_step", "start_step")
    before = {x: F.lag(x).over(order) for x in ("value", "start_step", "end_step")}
    rows = rows.withColumns({f"_{k}": v for k, v in before.items()})
    first = F.col("_end_step").isNull()
    grows = F.col("end_step") > F.col("_end_step")
    same, next_ = grows & (F.col("start_step") == F.col("_start_step")), grows & (F.col("start_step") == F.col("_end_step"))
    amount = F.when(first | next_, F.col("value")).when(same, F.col("value") - F.col("_value"))
    start = F.when(same, F.col("_end_step")).otherwise(F.col("start_step"))
    refusal = F.when(~(first | same | next_), "step_range")
    step_range = F.when(refusal.isNull(), F.concat_ws("-", start.cast("string"), F.col("end_step").cast("string")))
    return rows.select(*keys, "end_step", amount.alias("amount"), step_range.alias("step_range"), refusal.alias("refusal"))


def same_grid(rows: DataFrame, message: list[str], order_by: str) -> DataFrame:
    """message, order_by, same: whether a message has the nodes of the previous one (null for the first)."""
    nodes = rows.groupBy(*message, order_by).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lat_i", "lon_i")).alias("mark"))
    order = Window.partitionBy(*message).orderBy(order_by)
    same = (F.col("n") == F.lag("n").over(order)) & (F.col("mark") == F.lag("mark").over(order))
    return nodes.withColumn("same", same).select(*message, order_by, "n", "same")


def assemble(parts: DataFrame, target: str = "target") -> DataFrame:
    """Glue the parts of a slice: carried rows get the target time, foreign ones a refusal.

    parts: target, variable, source, stream, valid_time, ...; only persisted variables may come
    from another time.
    """
    foreign = F.col("valid_time") != F.col(target)
    carried = foreign & F.col("variable").isin(list(canon.PERSISTED))
    return parts.withColumn("time", F.when(~foreign | carried, F.col(target))).withColumn("refusal", F.when(foreign & ~carried, "time"))


def source_versions(rows: DataFrame, now: int, at: str = "at") -> DataFrame:
    from ..functions.fields import source_version

    return rows.withColumn("version", source_version((F.lit(now) - F.col(at)) / 86400.0))


def layer_from_path(rows: DataFrame, path: str = "path") -> DataFrame:
    """Adds layer: the right-most part of a path that names a layer, else coarse."""
    names = F.array(*map(F.lit, canon.LAYERS))
    found = F.filter(F.reverse(F.split(path, "/")), lambda x: F.array_contains(names, x))
    return rows.withColumn("layer", F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("coarse")))


def cache_key(rows: DataFrame, parts: list[str], name: str = "key") -> DataFrame:
    """Adds the parts joined by '/'; null if a part is empty or holds a '/'."""
    bad = F.lit(False)
    for x in parts:
        bad = bad | F.coalesce((F.col(x) == "") | F.col(x).contains("/"), F.lit(True))
    return rows.withColumn(name, F.when(~bad, F.concat_ws("/", *parts)))
