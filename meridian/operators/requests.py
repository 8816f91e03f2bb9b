"""Checks and decompositions of requests, a row each; a refusal is a code, not an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import suggested_stride
from .reading import window_size


def resolve_fields(requests: DataFrame, key: str = "id", asked: str = "vars") -> DataFrame:
    """key, pos, asked, name, inputs, ...: the fields of a comma list, in order, without repeats; known says if listed."""
    catalog = F.broadcast(canon.catalog(requests.sparkSession))
    parts = requests.select(key, F.posexplode(F.split(asked, ",")).alias("pos", "raw")).select(key, "pos", F.trim("raw").alias("asked")).where("asked <> ''")
    rows = parts.join(catalog, "asked", "left").withColumn("name", F.coalesce("name", "asked"))
    first = rows.groupBy(key, "name").agg(F.min_by(F.struct("pos", "asked", "inputs", "unit_si", "unit_human", "scale", "offset", "digits_si", "digits_human"), "pos").alias("x"))
    return first.select(key, "name", "x.*", F.col("x.inputs").isNotNull().alias("known"))


def canonical_inputs(fields: DataFrame, key: str = "id") -> DataFrame:
    """key, inputs: distinct stored inputs of resolved fields in the order of first use."""
    each = fields.where("known").select(key, "pos", F.posexplode("inputs").alias("k", "variable"))
    first = each.groupBy(key, "variable").agg(F.min(F.struct("pos", "k")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "variable"))), lambda x: x["variable"]).alias("inputs"))


def offered_fields(stored: DataFrame, key: str) -> DataFrame:
    """key, name: public names that may be asked given stored variables; wind only with both components."""
    known = stored.join(F.broadcast(canon.variables(stored.sparkSession).select("variable")), "variable", "left_semi")
    public = F.col("variable")
    for alias, variable in canon.ALIASES.items():
        public = F.when(F.col("variable") == variable, alias).otherwise(public)
    both = known.where("variable in ('10u', '10v')").groupBy(key).agg(F.count_distinct("variable").alias("n")).where("n = 2")
    return known.select(key, public.alias("name")).union(both.select(key, F.lit("wind"))).distinct()


def choose_layer(requests: DataFrame, key: str = "id", step: str = "step_hours", variable: str = "variable") -> DataFrame:
    """key, layer, reason: the layer of a step; reason is step, or vars with those outside of the layer. A row a variable in."""
    layers = F.broadcast(canon.layers(requests.sparkSession).where(F.col("layer").isin(list(canon.LAYER_BY_STEP.values()))).select("layer", "variable", F.lit(True).alias("has")))
    name = F.lit(None).cast("string")
    for hours, layer in canon.LAYER_BY_STEP.items():
        name = F.when(F.col(step) == hours, layer).otherwise(name)
    rows = requests.select(key, F.col(variable).alias("variable"), name.alias("layer")).join(layers, ["layer", "variable"], "left")
    missing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("layer").isNotNull() & F.col("has").isNull(), F.col("variable")))), ",")
    out = rows.groupBy(key).agg(F.max("layer").alias("layer"), missing.alias("missing"))
    return out.select(key, "layer", F.when(F.col("layer").isNull(), "step").when(F.col("missing") != "", F.concat(F.lit("vars:"), "missing")).alias("reason"))


def point_layer(requests: DataFrame, present: DataFrame, key: str = "id", variable: str = "variable") -> DataFrame:
    """key, layer: the series copy if it holds all variables of a request and is there, else maps. present: layer."""
    series = list(canon.SERIES)
    there = present.where("layer = 'points'").agg(F.count("*").alias("n"))
    out = requests.groupBy(key).agg(F.bool_and(F.col(variable).isin(series)).alias("covered")).crossJoin(F.broadcast(there))
    return out.select(key, F.when(F.col("covered") & (F.col("n") > 0), "points").otherwise("coarse").alias("layer"))


def validate_point(requests: DataFrame) -> DataFrame:
    """Adds code: lat, lon, units or range for a request that is refused, else null."""
    code = F.when(~F.col("lat").between(-90, 90), "lat").when(~F.col("lon").between(-180, 180), "lon").when(~F.col("units").isin("si", "human"), "units")
    return requests.withColumn("code", code.when(F.col("start") > F.col("stop"), "range"))


def parse_bbox(requests: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Adds south, west, north, east and box_code (shape, number, range, order or null)."""
    numbers = F.transform(F.split(bbox, ","), lambda x: F.trim(x).try_cast("double"))
    # Behind a generator: else the planner puts the parsing into each place where a side is used.
    rows = requests.select("*", F.explode(F.array(numbers)).alias("_sides"))
    side = lambda k: F.try_element_at("_sides", F.lit(k))
    rows = rows.withColumns({"south": side(1), "west": side(2), "north": side(3), "east": side(4)})
    known = F.col("south").isNotNull() & F.col("west").isNotNull() & F.col("north").isNotNull() & F.col("east").isNotNull()
    inside = F.col("south").between(-90, 90) & F.col("north").between(-90, 90) & F.col("west").between(-180, 180) & F.col("east").between(-180, 180)
    ordered = (F.col("south") < F.col("north")) & (F.col("west") < F.col("east"))
    return rows.withColumn("box_code", F.when(F.size("_sides") != 4, "shape").when(~known, "number").when(~inside, "range").when(~ordered, "order")).drop("_sides")


def parse_moment(rows: DataFrame, text: str, name: str = "moment") -> DataFrame:
    """Adds a timestamp: ISO 8601 with Z or an offset; without one it is UTC; null if it can't be read."""
    zoned = F.when(F.col(text).rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col(text)).otherwise(F.concat(F.col(text), F.lit("Z")))
    return rows.withColumn(name, F.try_to_timestamp(zoned))


def hourly_horizon(requests: DataFrame, last_hour: DataFrame) -> DataFrame:
    """Adds beyond: an hourly request that ends after the hourly layer does. last_hour: one row, last."""
    rows = requests.crossJoin(F.broadcast(last_hour.select(F.col("last").alias("_last"))))
    return rows.withColumn("beyond", (F.col("step_hours") == 1) & (F.col("stop") > F.col("_last"))).drop("_last")


def limited_window(boxes: DataFrame, lats: DataFrame, lons: DataFrame, limit: int = canon.MAX_POINTS) -> DataFrame:
    """id, ny, nx (unthinned), points (thinned), suggested stride and code, from the axes alone.

    boxes: id, south, west, north, east, stride. A refused request never touches the fields.
    """
    rows = window_size(boxes, lats, lons).select("id", "stride", "ny", "nx", "points")
    rows = rows.withColumn("suggested", suggested_stride(F.col("ny").cast("int"), F.col("nx").cast("int"), limit).cast("long"))
    return rows.withColumn("code", F.when(F.col("points") == 0, "coverage").when(F.col("points") > limit, "points"))


def limit_steps(rows: DataFrame, key: str = "id", limit: int = canon.MAX_STEPS) -> DataFrame:
    """key, requested, refused: distinct moments of each answer against the limit."""
    return rows.groupBy(key).agg(F.count_distinct("time").alias("requested")).withColumn("refused", F.col("requested") > limit)


def surface_only(rows: DataFrame, variable: str = "variable") -> DataFrame:
    return rows.where(~F.col(variable).isin(list(canon.ATMOS)))


def availability(requests: DataFrame, published: DataFrame, present: DataFrame) -> DataFrame:
    """Adds code: no_forecast without a published run, no_layer without the layer, else null. published: run_id; present: run_id, layer."""
    run = published.agg(F.max("run_id").alias("run_id"))
    rows = requests.crossJoin(F.broadcast(run)).join(present.select("run_id", "layer", F.lit(True).alias("there")), ["run_id", "layer"], "left")
    return rows.withColumn("code", F.when(F.col("run_id").isNull(), "no_forecast").when(F.col("there").isNull(), "no_layer")).drop("there")
