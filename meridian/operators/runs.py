"""Runs: cycles, manifests, skips, publication, rotation and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import cycle_phase

#: Deadlines in seconds since a cycle's start, reasons, timing keys.
POLL, FALLBACK, PUBLISH = 25200, 30600, 34200
SKIP_REASONS = ("no_input", "late_input", "failed")
TIMINGS = ("ingest", "inference", "validate", "publish")
KEPT_FILES = ("manifest.json", "validation.json", "skip.json")
REQUIRED_LAYERS = ("coarse", "hourly")
GRACE_S = 21600
NODES, BYTES = canon.N_LAT * canon.N_LON, 4


def cycle_deadlines(inits: DataFrame) -> DataFrame:
    """init (seconds) with poll, fallback and publish moments, or a refusal off the six-hour grid."""
    ok = F.col("init") % 21600 == 0
    return inits.select("init", *[F.when(ok, F.col("init") + s).alias(k) for k, s in (("poll", POLL), ("fallback", FALLBACK), ("publish", PUBLISH))], F.when(~ok, "grid").alias("refusal"))


def phases(cycles: DataFrame, now: int) -> DataFrame:
    return cycles.withColumn("phase", cycle_phase(F.lit(now) - F.col("init")))


def latest_run(now: DataFrame) -> DataFrame:
    """at, init: the last cycle whose polling window is open."""
    return now.select("at", (F.floor((F.col("at") - POLL) / 21600) * 21600).cast("long").alias("init"))


def skip_if_missed(cycles: DataFrame, manifests: DataFrame, skips: DataFrame, now: int) -> DataFrame:
    """New skip rows: cycles past their deadline with neither manifest nor skip. All have init."""
    missed = phases(cycles, now).where("phase = 'missed'").select("init")
    return missed.join(manifests, "init", "left_anti").join(skips, "init", "left_anti")


def run_log(manifests: DataFrame, skips: DataFrame) -> DataFrame:
    """run_id, state, init, reason; a skip wins; runs with neither are left out.

    manifests: run_id, published, inputs (array of valid times in seconds); skips: run_id, init, reason.
    """
    a = manifests.select("run_id", "published", F.array_max("inputs").alias("at"))
    b = skips.select("run_id", F.col("init").alias("skip_init"), F.col("reason").alias("skip_reason"), F.lit(True).alias("skipped"))
    rows = a.join(b, "run_id", "full_outer")
    state = F.when(F.col("skipped"), "skipped").when(F.col("published"), "published").otherwise("unfinished")
    return rows.select("run_id", state.alias("state"), F.when(F.col("skipped"), F.col("skip_init")).otherwise(F.col("at")).alias("init"), F.when(F.col("skipped"), F.col("skip_reason")).alias("reason"))


def manifest_rules(inputs: DataFrame, heads: DataFrame) -> DataFrame:
    """run_id, refusals (sorted, comma-joined): the shape rules of a manifest.

    inputs: run_id, source, stream, checksum, fields (array); heads: run_id, steps, timings (map),
    degraded_reason, waited_for (array).
    """
    known = F.array(*map(F.lit, canon.VARIABLES))
    rules = {
        "source": ~F.col("source").isin(list(canon.SOURCES)),
        "checksum": ~F.col("checksum").startswith("sha256:"),
        "stream": F.col("stream") == "",
        "fields": (F.size("fields") == 0) | (F.size(F.array_except("fields", known)) > 0),
    }
    each = inputs.groupBy("run_id").agg(*[F.bool_or(F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()])
    rows = heads.join(each, "run_id", "left")
    more = {
        "inputs": F.col("source").isNull(),
        "steps": F.col("steps") <= 0,
        "timings_sec": F.array_sort(F.map_keys("timings")) != F.array_sort(F.array(*map(F.lit, TIMINGS))),
        "degraded.reason": F.col("degraded_reason").isNotNull() & (F.col("degraded_reason") != "late_input"),
        "degraded.waited_for": F.col("degraded_reason").isNotNull() & (F.coalesce(F.size("waited_for"), F.lit(0)) == 0),
    }
    every = {k: F.col(k) for k in rules} | more
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in every.items()]))
    return rows.select("run_id", F.array_join(F.array_sort(names), ",").alias("refusals"))


def skip_rules(skips: DataFrame) -> DataFrame:
    """run_id, refusal: closed reasons, a named source for no_input, attempts of zero or more."""
    bad = F.when(~F.col("reason").isin(list(SKIP_REASONS)), "reason").when((F.col("reason") == "no_input") & (F.coalesce(F.size("waited_for"), F.lit(0)) == 0), "waited_for").when(F.col("attempts") < 0, "attempts")
    return skips.select("run_id", bad.alias("refusal"))


def derive_layer(field: DataFrame) -> DataFrame:
    """The series copy and the reduced copy: coarse cut to eight variables."""
    return field.where(F.col("variable").isin(list(canon.SERIES)))


def rotate_select(entries: DataFrame, pointers: DataFrame, keep: DataFrame, now: int) -> DataFrame:
    """run_id, entry (null: the whole run): what no pointer needs.

    entries: run_id, entry, published (null without a manifest), manifest_at (seconds); pointers:
    one row, current, previous; keep: run_id. The current run, kept runs and runs that are
    publishing for less than six hours stay whole; the previous run keeps its reduced layer;
    documents stay in all; a run of which nothing would stay goes whole.
    """
    rows = entries.join(keep, "run_id", "left_anti").crossJoin(F.broadcast(pointers))
    rows = rows.where(~F.coalesce(F.col("run_id") == F.col("current"), F.lit(False)))
    publishing = F.coalesce(~F.col("published") & (F.lit(now) - F.col("manifest_at") < GRACE_S), F.lit(False))
    rows = rows.where(~publishing)
    stays = F.col("entry").isin(list(KEPT_FILES)) | F.coalesce((F.col("run_id") == F.col("previous")) & (F.col("entry") == "previous"), F.lit(False))
    rows = rows.withColumn("stays", stays).withColumn("any", F.bool_or("stays").over(Window.partitionBy("run_id")))
    return rows.where("not stays").select("run_id", F.when(F.col("any"), F.col("entry")).alias("entry")).distinct()


def publish_gate(staged: DataFrame, final: DataFrame) -> DataFrame:
    """run_id, reasons: why a staged run may not be published. staged, final: run_id, entry."""
    need = F.array(*map(F.lit, (*REQUIRED_LAYERS, "validation.json")))
    have = staged.groupBy("run_id").agg(F.collect_set("entry").alias("have"))
    there = final.groupBy("run_id").agg(F.bool_or(F.col("entry") != "skip.json").alias("taken"))
    rows = have.join(there, "run_id", "left")
    lost = F.array_except(need, F.col("have"))
    reasons = F.concat(lost, F.when(F.coalesce("taken", F.lit(False)), F.array(F.lit("taken"))).otherwise(F.array().cast("array<string>")))
    return rows.select("run_id", F.array_join(F.array_sort(reasons), ",").alias("reasons"))


def publish_advance(pointer: DataFrame, run_id: str) -> DataFrame:
    """The pointer table after a publication: a new row, current is the run, previous the old one. pointer: seq, current, previous."""
    last = pointer.agg(F.max("seq").alias("seq"), F.max_by("current", "seq").alias("current"))
    return pointer.unionByName(last.select((F.coalesce("seq", F.lit(0)) + 1).alias("seq"), F.lit(run_id).alias("current"), F.col("current").alias("previous")))


def layer_bytes(spark) -> DataFrame:
    """layer, fields_per_step, steps, bytes: what each layer should weigh."""
    rows = canon.layers(spark).groupBy("layer", "steps").agg(F.sum(F.when(F.col("on_levels"), len(canon.LEVELS)).otherwise(1)).alias("fields_per_step"))
    return rows.select("layer", "fields_per_step", "steps", (F.col("fields_per_step") * F.col("steps") * F.lit(NODES * BYTES).cast("long")).alias("bytes"))


#: Layers that a run's model wrote, and those that it keeps on disk.
RUN_LAYERS, PINNED_LAYERS = ("coarse", "hourly"), ("coarse", "hourly", "points", "previous")


def layer_weights(stored: DataFrame) -> DataFrame:
    """scope (layer, run or pinned), run_id, name, bytes, expected: what layers weigh and should weigh, and their sums by run, in one aggregate.

    stored: run_id, layer, values (how many are there). A run is what its model wrote; pinned is all that it keeps on disk.
    """
    want = layer_bytes(stored.sparkSession).select("layer", F.col("bytes").alias("want"))
    within = lambda layers, name: F.when(F.col("layer").isin(list(layers)), F.lit(name))
    rows = stored.groupBy("run_id", "layer").agg((F.sum("values") * BYTES).alias("size")).join(F.broadcast(want), "layer")
    rows = rows.withColumns({"run": within(RUN_LAYERS, "run"), "pinned": within(PINNED_LAYERS, "pinned")})
    sets = [["run_id", "layer"], ["run_id", "run"], ["run_id", "pinned"]]
    sums = rows.groupingSets(sets, "run_id", "layer", "run", "pinned").agg(F.sum("size").alias("bytes"), F.sum("want").alias("expected"), F.grouping("layer").alias("_l"), F.grouping("run").alias("_r"), F.grouping("pinned").alias("_p"))
    scope = F.when(F.col("_l") == 0, "layer").when(F.col("_r") == 0, "run").otherwise("pinned")
    name = F.coalesce("layer", "run", "pinned")
    return sums.select(scope.alias("scope"), "run_id", name.alias("name"), "bytes", "expected").where("name is not null")


def stored_bytes(field: DataFrame, keys: list[str]) -> DataFrame:
    return field.groupBy(*keys).agg((F.count("*") * BYTES).alias("bytes"))


def read_amplification(shapes: DataFrame) -> DataFrame:
    """Layout, needed, touched: values needed and read for request shapes (times, levels, lats, lons, n) under both layouts."""
    layouts = shapes.sparkSession.createDataFrame([("maps", 1, 1, canon.N_LAT, canon.N_LON), ("series", 1460, 1, 4, 4)], "layout string, c_times int, c_levels int, c_lats int, c_lons int")
    rows = shapes.crossJoin(F.broadcast(layouts))
    product = lambda f: F.col("n") * f("times") * f("levels") * f("lats") * f("lons")
    whole = lambda x: (F.ceil(F.col(x) / F.col("c_" + x)) * F.col("c_" + x)).cast("long")
    return rows.groupBy("layout").agg(F.sum(product(lambda x: F.col(x).cast("long"))).alias("needed"), F.sum(product(whole)).alias("touched"))


def stage_timings(timings: DataFrame, budget_s: int = 80 * 60) -> DataFrame:
    """run_id, total_s, slowest, over: stage times (run_id, stage, seconds) against the cycle's budget."""
    rows = timings.groupBy("run_id").agg(F.sum("seconds").alias("total_s"), F.max_by("stage", F.struct("seconds", "stage")).alias("slowest"))
    return rows.withColumn("over", F.col("total_s") > budget_s)
