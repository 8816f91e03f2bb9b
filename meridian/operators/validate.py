"""Checks of data quality: rows (keys, level, name, field, passed, got, expected).

check_families makes all checks of an artifact in one pass: a window over each node's series, an
aggregate by variable behind it and one by artifact, whose rows are then spread into checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import iso, nan_to_null, non_finite
from .normalize import with_level

NAN_LIMIT = 0.001
MEAN_RANGE = (283.0, 292.0)
JUMP_LIMIT = 15.0


def _check(level: str, name: str, field, passed, got, expected) -> list:
    as_text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    return [F.lit(level).alias("level"), F.lit(name).alias("name"), as_text(field).alias("field"), F.coalesce(passed, F.lit(False)).alias("passed"), as_text(got).alias("got"), as_text(expected).alias("expected")]


def _spread(rows: DataFrame, keys: list[str], checks: list) -> DataFrame:
    """A row for each check of each row; checks: columns of _check, or (condition, columns)."""
    made = [F.when(x[0], F.struct(*x[1])) if isinstance(x, tuple) else F.struct(*x) for x in checks]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("check")).select(*keys, "check.*")


def profile(field: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variable, n, holes, low, high (NaN skipped): one aggregate for the physics checks."""
    value = nan_to_null(F.col("value").cast("double"))
    hole = F.when(non_finite(F.col("value")), 1).otherwise(0)
    return field.groupBy(*keys, "variable").agg(F.count("value").alias("n"), F.sum(hole).alias("holes"), F.min(value).alias("low"), F.max(value).alias("high"))


def _physics(stats: DataFrame) -> tuple[DataFrame, list]:
    """A profile() with the declared ranges, and its checks. Fields without a range have no physical_range."""
    rows = stats.join(F.broadcast(canon.variables(stats.sparkSession)), "variable", "left")
    share = F.col("holes") / F.col("n")
    span = lambda a, b: F.concat_ws("..", F.format_number(a, 4), F.format_number(b, 4))
    # A field of gaps only has no range: it fails here, and is left alone by not_constant.
    inside = F.col("low").isNotNull() & (F.col("low") >= F.col("lo")) & (F.col("high") <= F.col("hi"))
    differs = F.col("low").isNull() | (F.col("low") != F.col("high"))
    return rows, [
        _check("physics", "nan_fraction", F.col("variable"), share <= NAN_LIMIT, F.format_number(share, 6), f"<= {NAN_LIMIT}"),
        (F.col("lo").isNotNull(), _check("physics", "physical_range", F.col("variable"), inside, F.when(F.col("low").isNull(), "all values are NaN").otherwise(span(F.col("low"), F.col("high"))), span(F.col("lo"), F.col("hi")))),
        _check("sanity", "not_constant", F.col("variable"), differs, span(F.col("low"), F.col("high")), "different values"),
    ]


def physics_checks(stats: DataFrame, keys: list[str]) -> DataFrame:
    """nan_fraction, physical_range and not_constant of a profile()."""
    rows, checks = _physics(stats)
    return _spread(rows, keys, checks)


def global_mean(field: DataFrame, keys: list[str], variable: str = "2t") -> DataFrame:
    """Mean weighted by the cosine of latitude, gaps skipped in both sums."""
    weight = F.when(~F.isnan("value"), F.cos(F.radians("lat")))
    rows = field.where(F.col("variable") == variable).groupBy(*keys).agg((F.sum(F.when(~F.isnan("value"), F.col("value").cast("double")) * weight) / F.sum(weight)).alias("mean"))
    return rows.select(*keys, "mean", *_check("sanity", f"global_mean_{variable}", variable, F.col("mean").between(*MEAN_RANGE), F.format_number("mean", 4), f"{MEAN_RANGE[0]}..{MEAN_RANGE[1]}"))


def step_jump(field: DataFrame, keys: list[str], variable: str = "2t") -> DataFrame:
    """Largest change between neighbouring steps of a node."""
    order = Window.partitionBy(*keys, "lat_i", "lon_i").orderBy("time")
    rows = field.where(F.col("variable") == variable).withColumn("jump", nan_to_null(F.abs(F.col("value") - F.lag("value").over(order)).cast("double")))
    rows = rows.groupBy(*keys).agg(F.max("jump").alias("jump"))
    return rows.select(*keys, "jump", *_check("sanity", f"step_jump_{variable}", variable, F.coalesce(F.col("jump") <= JUMP_LIMIT, F.lit(True)), F.format_number("jump", 4), f"<= {JUMP_LIMIT}"))


def grid_shape(field: DataFrame, keys: list[str], shape: tuple[int, int] = (canon.N_LAT, canon.N_LON)) -> DataFrame:
    rows = field.groupBy(*keys).agg(F.count_distinct("lat").alias("ny"), F.count_distinct("lon").alias("nx"))
    return rows.select(*keys, *_check("structure", "grid_shape", "lat,lon", (F.col("ny") == shape[0]) & (F.col("nx") == shape[1]), F.concat_ws("x", "ny", "nx"), f"{shape[0]}x{shape[1]}"))


def lon_range(field: DataFrame, keys: list[str], first: float = -180.0, last: float = 179.75) -> DataFrame:
    rows = field.groupBy(*keys).agg(F.min_by("lon", "lon_i").alias("a"), F.max_by("lon", "lon_i").alias("b"))
    return rows.select(*keys, *_check("structure", "lon_range", "lon", (F.col("a") == first) & (F.col("b") == last), F.concat_ws("..", F.col("a").cast("string"), F.col("b").cast("string")), f"{first}..{last}"))


def axis_monotonic(field: DataFrame, keys: list[str]) -> DataFrame:
    """Latitude strictly falling and longitude strictly rising in storage order."""
    out = []
    for axis, sign, name in (("lat", -1, "lat_descending"), ("lon", 1, "lon_ascending")):
        nodes = field.select(*keys, f"{axis}_i", axis).distinct()
        order = Window.partitionBy(*keys).orderBy(f"{axis}_i")
        step = nodes.withColumn("d", (F.col(axis) - F.lag(axis).over(order)) * sign).groupBy(*keys).agg(F.min("d").alias("d"))
        out.append(step.select(*keys, *_check("structure", name, axis, F.coalesce(F.col("d") > 0, F.lit(True)), F.col("d"), "> 0")))
    return out[0].unionByName(out[1])


def time_unique(field: DataFrame, keys: list[str]) -> DataFrame:
    rows = field.groupBy(*keys, "variable", "lat_i", "lon_i", "time").count().groupBy(*keys).agg(F.max("count").alias("n"))
    return rows.select(*keys, *_check("structure", "time_unique", "time", F.col("n") == 1, F.col("n"), "1"))


def time_regular(field: DataFrame, keys: list[str], step_hours: int) -> DataFrame:
    """One step only, equal to the layer's, in microseconds."""
    times = field.select(*keys, "time").distinct()
    order = Window.partitionBy(*keys).orderBy("time")
    step = F.timestamp_diff("MICROSECOND", F.lag("time").over(order), F.col("time"))
    rows = times.withColumn("d", step).groupBy(*keys).agg(F.array_sort(F.collect_set("d")).alias("d"))
    want = F.array(F.lit(step_hours * 3_600_000_000).cast("long"))
    ok = (F.size("d") == 0) | (F.col("d") == want)
    return rows.select(*keys, *_check("structure", "time_regular", "time", ok, F.array_join("d", ","), F.array_join(want, ",")))


def fields_present(field: DataFrame, keys: list[str], layer: str) -> DataFrame:
    surface, atmos, _, _ = canon.LAYERS[layer]
    want = F.array_sort(F.array(*map(F.lit, surface + atmos)))
    rows = field.groupBy(*keys).agg(F.collect_set("variable").alias("got"))
    lost = F.array_except(want, F.col("got"))
    return rows.select(*keys, *_check("structure", "fields_present", layer, F.size(lost) == 0, F.array_join(lost, ","), "none missing"))


def levels_match(field: DataFrame, keys: list[str]) -> DataFrame:
    """The levels of level fields, in order, are the contract's; surface only is fine. field has level."""
    atmos = F.col("variable").isin(list(canon.ATMOS))
    rows = field.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(atmos, F.col("level")))).alias("got"), F.count_if(atmos).alias("n"), F.count_if(atmos & F.col("level").isNull()).alias("without"))
    want = F.array(*[F.lit(x) for x in canon.LEVELS])
    ok = (F.col("n") == 0) | ((F.col("without") == 0) & (F.col("got") == want))
    return rows.select(*keys, *_check("structure", "levels_match", "level", ok, F.array_join("got", ","), F.array_join(want, ",")))


def units_match(fields: DataFrame, keys: list[str]) -> DataFrame:
    """A row a field in: variable, units; passes if the variable is known and the unit is the contract's."""
    table = canon.variables(fields.sparkSession).select("variable", F.col("units").alias("want"))
    rows = fields.join(F.broadcast(table), "variable", "left")
    return rows.select(*keys, *_check("semantics", "units_match", F.col("variable"), F.col("units") == F.col("want"), F.col("units"), F.coalesce("want", F.lit("a known variable"))))


def time_naive(field: DataFrame) -> bool:
    """Whether time is a timestamp without zone (a property of the schema)."""
    return field.schema["time"].dataType.typeName() == "timestamp_ntz"


def _inconsistent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bad_time, due_time: the first moment that is not init_time + lead_hours, or null. Rows without a lead time fit."""
    due = F.col("init_time") + F.make_dt_interval(F.lit(0), F.col("lead_hours").cast("int"))
    bad = F.when(F.col("lead_hours").isNotNull() & (F.col("time") != due), F.struct("time", due.alias("due")))
    return rows.groupBy(*keys).agg(F.min(bad).alias("x")).select(*keys, F.col("x.time").alias("bad_time"), F.col("x.due").alias("due_time"))


def valid_time_consistent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """time = init_time + lead_hours; the first offender is named; rows without a lead time pass."""
    text = lambda x: F.coalesce(iso(F.col(x)), F.lit(""))
    return _inconsistent(rows, keys).select(*keys, *_check("semantics", "valid_time_consistent", "time", F.col("bad_time").isNull(), text("bad_time"), text("due_time")))


def messages_parsed(listing: DataFrame, slices: DataFrame, keys: list[str] = ["file"]) -> DataFrame:  # noqa: B006
    """Messages in a file against distinct slices in the data. listing: keys, a row a message; slices: keys and what tells slices apart."""
    got = listing.groupBy(*keys).agg(F.count("*").alias("messages"))
    kept = slices.distinct().groupBy(*keys).agg(F.count("*").alias("slices"))
    rows = got.join(kept, keys, "full_outer").fillna(0, ["messages", "slices"])
    return rows.select(*keys, *_check("grib", "messages_parsed", "messages", (F.col("messages") > 0) & (F.col("messages") == F.col("slices")), F.col("slices"), F.col("messages")))


#: Levels of checks; all but the first need the fields only.
CHECK_LEVELS = ("grib", "structure", "semantics", "physics", "sanity")


def validate(
    field: DataFrame, keys: list[str], layer: str = "coarse", levels: list[str] | None = None, units: DataFrame | None = None, leads: DataFrame | None = None, listing: DataFrame | None = None,
    slices: DataFrame | None = None, shape: tuple[int, int] = (canon.N_LAT, canon.N_LON), last_lon: float = 179.75, static: bool = False,
) -> DataFrame:
    """All checks of the chosen levels of every artifact (keys), in one result.

    units (keys, variable, units) and leads (keys, time, init_time, lead_hours) travel with an artifact; without units
    every variable fails, without lead times there is nothing to compare. listing and slices (see messages_parsed) are
    needed by the level grib, which is left out by default if they are not given. An unknown level is refused.
    """
    if layer not in canon.LAYERS:
        raise ValueError(f"layer: got {layer!r}, expected one of {sorted(canon.LAYERS)}")
    default = CHECK_LEVELS if listing is not None else CHECK_LEVELS[1:]
    wanted = default if levels is None else levels
    if unknown := sorted(set(wanted) - set(CHECK_LEVELS)):
        raise ValueError(f"levels: got {unknown}, expected some of {CHECK_LEVELS}")
    if "grib" in wanted and (listing is None or slices is None):
        raise ValueError("levels: 'grib' needs the listing of messages and the slices made of them")
    parts = []
    if set(wanted) - {"grib"}:
        checks = check_families(field, keys, layer, shape, last_lon, units=units, leads=leads, static=static)
        parts.append(checks.where(F.col("level").isin([x for x in wanted if x != "grib"])))
    if "grib" in wanted:
        parts.append(messages_parsed(listing, slices, keys))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def check_families(
    field: DataFrame, keys: list[str], layer: str, shape: tuple[int, int], last_lon: float, variable: str = "2t", units: DataFrame | None = None, leads: DataFrame | None = None, static: bool = False,
) -> DataFrame:
    """Structure, semantics, physics and sanity checks of every artifact, in one pass over the fields.

    Axes, times, levels and names of an artifact are sets of some hundred entries. static: the layer's fields and the static ones are due.
    """
    field = with_level(field)
    unzoned = F.lit(time_naive(field))
    value = nan_to_null(F.col("value").cast("double"))
    hole, weight = F.when(non_finite(F.col("value")), 1).otherwise(0), F.when(~F.isnan("value"), F.cos(F.radians("lat")))
    order = Window.partitionBy(*keys, "variable", "level", "lat_i", "lon_i").orderBy("time")
    rows = field.withColumn("before", F.lag(F.struct("time", "value")).over(order))
    axis = lambda x: F.collect_set(F.struct(F.col(f"{x}_i").alias("i"), F.col(x).alias("at"))).alias(f"{x}s")
    stats = rows.groupBy(*keys, "variable").agg(
        F.count("value").alias("n"), F.sum(hole).alias("holes"), F.min(value).alias("low"), F.max(value).alias("high"),
        (F.sum(value * weight) / F.sum(weight)).alias("mean"), F.max(nan_to_null(F.abs(F.col("value") - F.col("before.value")).cast("double"))).alias("jump"),
        F.count_if(F.col("before.time") == F.col("time")).alias("twice"), axis("lat"), axis("lon"), F.collect_set("time").alias("times"),
        F.collect_set("level").alias("levels"), F.count_if(F.col("level").isNull()).alias("without"),
    )
    ranged, physics = _physics(stats)
    given = units.select(*keys, "variable", F.col("units").alias("given")) if units is not None else None
    ranged = ranged.join(given, [*keys, "variable"], "left") if given is not None else ranged.withColumn("given", F.lit(None).cast("string"))
    of_variable = F.col("variable") == variable
    by_variable = _spread(ranged, keys, [
        *physics,
        _check("semantics", "units_match", F.col("variable"), F.col("given") == F.col("units"), F.when(F.col("units").isNull(), "unknown variable").otherwise(F.coalesce("given", F.lit("none"))), F.coalesce("units", F.lit("a known variable"))),
        (of_variable, _check("sanity", f"global_mean_{variable}", variable, F.col("mean").between(*MEAN_RANGE), F.format_number("mean", 4), f"{MEAN_RANGE[0]}..{MEAN_RANGE[1]}")),
        (of_variable, _check("sanity", f"step_jump_{variable}", variable, F.coalesce(F.col("jump") <= JUMP_LIMIT, F.lit(True)), F.format_number("jump", 4), f"<= {JUMP_LIMIT}")),
    ])
    merged = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x)
    whole = stats.groupBy(*keys).agg(merged("lats"), merged("lons"), merged("times"), F.sum("twice").alias("twice"), F.collect_set("variable").alias("got"), merged("levels"), F.sum(F.when(F.col("variable").isin(list(canon.ATMOS)), F.col("without")).otherwise(0)).alias("without"))
    surface, atmos, step, _ = canon.LAYERS[layer]
    count = lambda x: F.size(F.array_distinct(F.transform(x, lambda y: y["at"])))
    later = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    earlier = lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    least = lambda x, sign: F.array_min(F.zip_with(earlier(x), later(x), lambda a, b: (b["at"] - a["at"]) * sign))
    steps = F.array_sort(F.array_distinct(F.zip_with(earlier("times"), later("times"), lambda a, b: F.timestamp_diff("MICROSECOND", a, b))))
    want = F.array(F.lit(step * 3_600_000_000).cast("long"))
    first, last = F.element_at("lons", 1)["at"], F.element_at("lons", -1)["at"]
    lost = F.array_except(F.array_sort(F.array(*map(F.lit, surface + atmos + (canon.STATIC if static else ())))), F.col("got"))
    on_levels = F.size(F.array_intersect(F.col("got"), F.array(*map(F.lit, canon.ATMOS)))) > 0
    known_levels = F.array(*map(F.lit, canon.LEVELS))
    levels_fit = ~on_levels | ((F.col("without") == 0) & (F.col("levels") == known_levels))
    whole = whole.select(*keys, "twice", count("lats").alias("ny"), count("lons").alias("nx"), first.alias("first"), last.alias("last"), least("lats", -1).alias("down"), least("lons", 1).alias("up"), steps.alias("steps"), lost.alias("lost"), "levels", levels_fit.alias("levels_fit"))
    if leads is None:
        whole = whole.withColumns({"bad_time": F.lit(None).cast("timestamp_ntz"), "due_time": F.lit(None).cast("timestamp_ntz")})
    else:
        whole = whole.join(_inconsistent(leads, keys), keys, "left")
    by_artifact = _spread(whole, keys, [
        _check("structure", "grid_shape", "lat,lon", (F.col("ny") == shape[0]) & (F.col("nx") == shape[1]), F.concat_ws("x", "ny", "nx"), f"{shape[0]}x{shape[1]}"),
        _check("structure", "lon_range", "lon", (F.col("first") == -180.0) & (F.col("last") == last_lon), F.concat_ws("..", F.col("first").cast("string"), F.col("last").cast("string")), f"-180.0..{last_lon}"),
        _check("structure", "lat_descending", "lat", F.coalesce(F.col("down") > 0, F.lit(True)), F.col("down"), "> 0"),
        _check("structure", "lon_ascending", "lon", F.coalesce(F.col("up") > 0, F.lit(True)), F.col("up"), "> 0"),
        _check("structure", "time_unique", "time", F.col("twice") == 0, F.col("twice"), "0"),
        _check("structure", "time_regular", "time", (F.size("steps") == 0) | (F.col("steps") == want), F.array_join("steps", ","), F.array_join(want, ",")),
        _check("structure", "fields_present", layer, F.size("lost") == 0, F.array_join("lost", ","), "none missing"),
        _check("structure", "levels_match", "level", F.col("levels_fit"), F.array_join("levels", ","), F.array_join(known_levels, ",")),
        _check("semantics", "time_naive_utc", "time", unzoned, field.schema["time"].dataType.simpleString(), "timestamp_ntz"),
        _check("semantics", "valid_time_consistent", "time", F.col("bad_time").isNull(), F.coalesce(iso(F.col("bad_time")), F.lit("")), F.coalesce(iso(F.col("due_time")), F.lit(""))),
    ])
    return by_artifact.unionByName(by_variable)


def summary(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ok, failed: verdict and the names of what failed."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.concat_ws(":", "name", "field"))))
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("ok"), F.array_join(failed, ",").alias("failed"))


def report_documents(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report: {ok, checks[]} as JSON, a document an artifact (its checks are some dozen)."""
    parts = F.array_sort(F.collect_list(F.struct("level", "name", "field", "passed", "got", "expected")))
    return checks.groupBy(*keys).agg(F.to_json(F.struct(F.bool_and("passed").alias("ok"), parts.alias("checks"))).alias("report"))
