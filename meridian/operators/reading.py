"""Point series, map windows and coverage for tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import iso, nan_to_null, wind_speed

DAY = 86400


def with_axes(rows: DataFrame, lats: DataFrame, lons: DataFrame) -> DataFrame:
    """Adds lat_0, lat_d, lat_n (first value, step and number of the latitudes) and the same of the longitudes.

    Axes are regular, so that an index is arithmetic and no request meets an axis row by row.
    """
    for name, axis in (("lat", lats), ("lon", lons)):
        first, last, n = F.min_by(name, f"{name}_i"), F.max_by(name, f"{name}_i"), F.count("*")
        line = axis.agg(first.alias(f"{name}_0"), F.coalesce((last - first) / F.nullif(n - 1, F.lit(0)), F.lit(1.0)).alias(f"{name}_d"), n.alias(f"{name}_n"))
        rows = rows.crossJoin(F.broadcast(line))  # one row
    return rows


#: Part of a step by which a bound may miss a node that lies on it.
EDGE = 1e-9


def window_size(boxes: DataFrame, lats: DataFrame, lons: DataFrame) -> DataFrame:
    """with_axes() and, for inclusive boxes, lat_a, lat_b, lon_a, lon_b (first and last index), ny, nx and points (after thinning).

    boxes: south, west, north, east, stride.
    """
    rows = with_axes(boxes, lats, lons)
    for name, low, high, n in (("lat", "south", "north", "ny"), ("lon", "west", "east", "nx")):
        zero, step = F.col(f"{name}_0"), F.col(f"{name}_d")
        ends = (F.col(low) - zero) / step, (F.col(high) - zero) / step
        first = F.greatest(F.ceil(F.least(*ends) - EDGE), F.lit(0)).cast("int")
        last = F.least(F.floor(F.greatest(*ends) + EDGE), F.col(f"{name}_n") - 1).cast("int")
        rows = rows.withColumns({f"{name}_a": first, f"{name}_b": last})
        rows = rows.withColumn(n, F.greatest(F.col(f"{name}_b") - F.col(f"{name}_a") + 1, F.lit(0)).cast("long"))
    thinned = F.ceil(F.col("ny") / F.col("stride")) * F.ceil(F.col("nx") / F.col("stride"))
    return rows.withColumn("points", thinned.cast("long"))


def nearest_node(requests: DataFrame, lats: DataFrame, lons: DataFrame) -> DataFrame:
    """id, lat_i, lon_i, node_lat, node_lon: the grid node of each request (the larger coordinate of two equally near); no wrap-around."""
    rows = with_axes(requests.where("lat is not null and lon is not null").select("id", "lat", "lon"), lats, lons)
    out = ["id"]
    for name in ("lat", "lon"):
        zero, step, at = F.col(f"{name}_0"), F.col(f"{name}_d"), (F.col(name) - F.col(f"{name}_0")) / F.col(f"{name}_d")
        i = F.when(step > 0, F.floor(at + 0.5)).otherwise(F.ceil(at - 0.5))
        i = F.least(F.greatest(i, F.lit(0)), F.col(f"{name}_n") - 1).cast("int")
        rows = rows.withColumn(f"{name}_i", i).withColumn(f"node_{name}", zero + F.col(f"{name}_i") * step)
    return rows.select("id", "lat_i", "lon_i", "node_lat", "node_lon")


def _ends(times: DataFrame) -> DataFrame:
    """One row: first and last step, and half of the first spacing (three hours for a single step)."""
    ends = times.agg(F.min("at").alias("first_step"), F.max("at").alias("last_step"))
    second = times.join(F.broadcast(ends), F.col("at") > F.col("first_step")).agg(F.min("at").alias("second"))  # ends is one row
    half = F.coalesce(F.floor((F.col("second") - F.col("first_step")) / 2), F.lit(10800))
    return ends.crossJoin(F.broadcast(second)).select("first_step", "last_step", half.alias("half"))


def calendar(times: DataFrame) -> DataFrame:
    """day, steps, before, earlier, later: the steps of each day in a layer's span, how many come before the day, and the nearest ones outside it.

    times: at (seconds), distinct. One row a day, also for days without steps.
    """
    days = times.groupBy(F.floor(F.col("at") / DAY).alias("day")).agg(F.array_sort(F.collect_list("at")).alias("steps"))
    span = times.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    span = span.select(F.explode(F.sequence(F.floor(F.col("a") / DAY) - 1, F.floor(F.col("b") / DAY) + 1)).alias("day"))
    order = Window.orderBy("day")  # days of one layer
    past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = span.join(days, "day", "left")
    return rows.select(
        "day", F.coalesce("steps", F.array().cast("array<bigint>")).alias("steps"), F.coalesce(F.sum(F.size("steps")).over(past), F.lit(0)).alias("before"),
        F.last(F.element_at("steps", -1), ignorenulls=True).over(past).alias("earlier"), F.first(F.element_at("steps", 1), ignorenulls=True).over(future).alias("later"),
    )


def nearest_step(requests: DataFrame, times: DataFrame) -> DataFrame:
    """id, step, code: seconds of the nearest step (the later of two), only within half a step of the ends.

    times: at (seconds), distinct. A request is joined to the day that it falls into.
    """
    rows = requests.select("id", F.col("at").alias("_w")).crossJoin(F.broadcast(_ends(times)))
    outside = F.col("first_step").isNull() | (F.col("_w") < F.col("first_step") - F.col("half")) | (F.col("_w") > F.col("last_step") + F.col("half"))
    inside = F.least(F.greatest("_w", "first_step"), F.col("last_step"))
    rows = rows.withColumn("outside", outside).withColumn("day", F.floor(inside / DAY)).join(calendar(times), "day", "left")
    near = F.array_compact(F.concat("steps", F.array("earlier", "later")))
    best = F.array_min(F.transform(near, lambda s: F.struct(F.abs(s - F.col("_w")).alias("d"), (-s).alias("s"))))
    return rows.select("id", F.when(~F.col("outside"), -best["s"]).alias("step"), F.when(F.col("outside"), "coverage").alias("code"))


def limited_series(requests: DataFrame, times: DataFrame, limit: int = canon.MAX_STEPS) -> DataFrame:
    """id, steps, code: the steps of a layer in each request's inclusive period, and coverage (none) or steps (too many) for a refusal.

    requests: id, start, stop (seconds; null is open). Only times are read, so a refused request never touches the fields.
    """
    rows = requests.select("id", "start", "stop").crossJoin(F.broadcast(_ends(times).drop("half")))
    days = calendar(times).select("day", "steps", "before")
    # The number of steps up to a moment, for the last moment before the period and for its end.
    moments = {"below": F.coalesce(F.col("start"), F.col("first_step")) - 1, "upto": F.coalesce("stop", "last_step")}
    for name, moment in moments.items():
        rows = rows.withColumn("_t", F.least(F.greatest(moment, F.col("first_step") - 1), F.col("last_step"))).withColumn("day", F.floor(F.col("_t") / DAY))
        rows = rows.join(days, "day", "left").withColumn(name, F.col("before") + F.size(F.filter("steps", lambda s: s <= F.col("_t")))).drop("day", "_t", "steps", "before")
    rows = rows.select("id", F.greatest(F.coalesce(F.col("upto") - F.col("below"), F.lit(0)), F.lit(0)).cast("long").alias("steps"))
    return rows.withColumn("code", F.when(F.col("steps") == 0, "coverage").when(F.col("steps") > limit, "steps"))


def time_window(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Rows of an inclusive period; null bounds are open."""
    return rows.where((start.isNull() | (F.col("time") >= start)) & (stop.isNull() | (F.col("time") <= stop)))


def point_series(field: DataFrame, nodes: DataFrame, fields: DataFrame, units: DataFrame) -> DataFrame:
    """id, name, pos, time, value: the asked fields at each request's node, in its units, gaps as null.

    nodes: nearest_node(); fields: resolve_fields(); units: id, units. Fields are read at the asked nodes only, once for
    all requests of a node, and gathered by node and moment; requests meet them by node. Every step
    on the side of the fields is dealt by (lat_i, lon_i): a plain field moves once, and one that is stored in
    buckets of nodes (sources.layers.write_series_table) doesn't move at all.
    """
    spots = nodes.select("lat_i", "lon_i").distinct()
    inputs = fields.where("known").select(F.explode("inputs").alias("variable")).distinct()  # names of the catalogue
    cells = field.join(F.broadcast(inputs), "variable", "left_semi").join(spots, ["lat_i", "lon_i"], "left_semi")
    cell = F.struct("variable", F.col("value").cast("double").alias("value"))
    series = cells.groupBy("lat_i", "lon_i", "time").agg(F.collect_list(cell).alias("cells"))  # the variables of one node and moment
    # Wind is made of its components once for a node and moment, and is then one variable more.
    of = lambda x: F.get(F.filter("cells", lambda c: c["variable"] == x), F.lit(0))["value"]
    speed = wind_speed(of("10u"), of("10v"))
    wind = F.when(speed.isNotNull(), F.array(F.struct(F.lit("10u,10v").alias("variable"), speed.alias("value")))).otherwise(F.array().cast("array<struct<variable:string,value:double>>"))
    series = series.select("lat_i", "lon_i", "time", F.inline(F.concat("cells", wind)))
    asked = fields.where("known").join(nodes, "id").join(units, "id").withColumn("keys", F.array(F.array_join("inputs", ",")))
    # Nodes alone deal the rows, so the variable is compared in the join and is no key of it.
    rows = series.join(asked.drop("inputs"), ["lat_i", "lon_i"]).where(F.array_contains("keys", F.col("variable")))
    value = F.when(F.col("units") == "human", F.col("value") * F.col("scale") + F.col("offset")).otherwise(F.col("value"))
    return rows.select("id", "name", "pos", "time", nan_to_null(value).alias("value"))


def limited_point_series(field: DataFrame, requests: DataFrame, nodes: DataFrame, fields: DataFrame, limit: int = canon.MAX_STEPS) -> tuple[DataFrame, DataFrame]:
    """Answers (point_series of each request's period) and refusals (limited_series with a code). requests: id, units, start, stop."""
    verdict = limited_series(requests, field.select(F.unix_seconds(F.col("time").cast("timestamp")).alias("at")).distinct(), limit)
    allowed = requests.join(verdict.where("code is null").select("id"), "id", "left_semi")
    series = point_series(field, nodes.join(allowed.select("id"), "id", "left_semi"), fields, allowed.select("id", "units"))
    period = allowed.select("id", *[F.timestamp_seconds(x).cast("timestamp_ntz").alias(x) for x in ("start", "stop")])
    rows = time_window(series.join(period, "id"), F.col("start"), F.col("stop"))
    return rows.drop("start", "stop"), verdict.where("code is not null")


def as_answers(series: DataFrame) -> DataFrame:
    """id, name, times, values: one row a field, arrays in time order."""
    pairs = F.array_sort(F.collect_list(F.struct("time", "value")))
    rows = series.groupBy("id", "name").agg(pairs.alias("x"))
    return rows.select("id", "name", F.transform("x", lambda p: iso(p["time"])).alias("times"), F.transform("x", lambda p: p["value"]).alias("values"))


def window_nodes(boxes: DataFrame, lats: DataFrame, lons: DataFrame, limit: int | None = canon.MAX_POINTS) -> DataFrame:
    """id, lat_i, lon_i, lat, lon: nodes of inclusive boxes, thinned by stride from the first selected row and column.

    boxes: id, south, west, north, east, stride. Boxes of more than limit nodes have none here
    (limited_window() says so), so no field is read for them.
    """
    rows = window_size(boxes, lats, lons).where("points > 0" if limit is None else f"points between 1 and {limit}")
    for name in ("lat", "lon"):
        rows = rows.withColumn(f"{name}_i", F.explode(F.sequence(f"{name}_a", f"{name}_b", "stride")))
    at = lambda x: (F.col(f"{x}_0") + F.col(f"{x}_i") * F.col(f"{x}_d")).alias(x)
    return rows.select("id", "lat_i", "lon_i", at("lat"), at("lon"))


def coverage(field: DataFrame, keys: list[str]) -> DataFrame:
    """First and last moment, number of steps and surface variables that are stored, by keys."""
    surface = field.where(~F.col("variable").isin(list(canon.ATMOS)))
    return surface.groupBy(*keys).agg(
        F.min("time").alias("first"), F.max("time").alias("last"), F.count_distinct("time").alias("steps"), F.array_sort(F.collect_set("variable")).alias("names")
    )


def layer_span(field: DataFrame) -> DataFrame:
    return field.agg(F.min("time").alias("first"), F.max("time").alias("last"))


def published_run(pointer: DataFrame, runs: DataFrame) -> DataFrame:
    """The run that the newest pointer row names, if it says it is published. pointer: seq, run_id."""
    newest = pointer.agg(F.max_by("run_id", "seq").alias("run_id"))
    return runs.where("published").join(newest, "run_id", "left_semi")


def freshness(runs: DataFrame, now: int) -> DataFrame:
    """Adds age_hours (one digit) and next_expected (seconds) to runs with init (seconds)."""
    age = F.bround((F.lit(now) - F.col("init")) / 3600, 1)
    return runs.withColumns({"age_hours": age, "next_expected": F.col("init") + 21600})


def fingerprint(rows: DataFrame, columns: list[str], name: str = "etag") -> DataFrame:
    """Adds the first 32 hex digits of a digest of the columns as JSON: same answer, same tag."""
    return rows.withColumn(name, F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32))
