"""Queries of the cache and run operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import chunk_begins, chunk_number, eviction_score, iso, run_id
from ..operators import cache as C
from ..operators import normalize as N
from ..operators import runs as U
from ..sources import fixtures as fx
from ..sources import layers as L
from ..sources import snapshots
from ..sources.fixtures import NOW, with_tables
from .book import query

SCORE = f"cost_ms / (bytes + 1)::DOUBLE * pow(0.5, greatest({NOW} - last_access, 0) / 86400.0)"
_CAPACITY = "SELECT floor(sum(bytes) / 0.9)::BIGINT AS cap FROM fx_cache"


def _capacity(index):
    """Capacity of which the fixture's entries fill 90 %: one number, as a subquery."""
    return index.agg(F.floor(F.sum("bytes") / 0.9).alias("n")).scalar()


@query("eviction_score", with_tables(f"SELECT key, round({SCORE}, 12) AS score FROM fx_cache", "fx_cache"))
def score(spark, d):
    rows = fx.cache_index(spark, d)
    age = F.greatest(F.lit(NOW) - F.col("last_access"), F.lit(0)).cast("double")
    return rows.select("key", F.round(eviction_score(F.col("cost_ms"), F.col("bytes"), age), 12).alias("score"))


_DOOMED = f"""cap AS ({_CAPACITY}), total AS (SELECT sum(bytes) AS total FROM fx_cache), run AS (SELECT key, bytes, coalesce(sum(bytes) OVER (ORDER BY {SCORE}, last_access, key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fx_cache WHERE NOT pinned), doomed AS (SELECT key, bytes FROM run, cap, total
    WHERE total > floor(cap * 0.85) AND total - before > floor(cap * 0.70))"""


@query("eviction_select", with_tables(f"{_DOOMED} SELECT key, bytes FROM doomed", "fx_cache"))
def eviction_select(spark, d):
    index = fx.cache_index(spark, d)
    return C.eviction_select(index, _capacity(index), NOW).select("key", "bytes")


@query(
    "eviction_report",
    with_tables(
        f"""{_DOOMED} SELECT (SELECT count(*) FROM doomed) AS removed, (SELECT coalesce(sum(bytes), 0) FROM doomed)::BIGINT AS freed, total::BIGINT AS before, (total - (SELECT coalesce(sum(bytes), 0) FROM doomed))::BIGINT AS after,
    floor(cap * 0.70)::BIGINT AS target, total > floor(cap * 0.85) AS triggered, total <= floor(cap * 0.85) OR total - (SELECT coalesce(sum(bytes), 0) FROM doomed) <= floor(cap * 0.70) AS enough FROM total, cap""",
        "fx_cache",
    ),
)
def eviction_report(spark, d):
    index = fx.cache_index(spark, d)
    return C.eviction_report(index, _capacity(index), NOW)


_PERIOD = "SELECT o_orderkey AS id, 1703462400 + o_orderkey * 4321 AS start, 1703462400 + o_orderkey * 4321 + (o_orderkey % 60 - 3) * 86400 AS stop FROM orders"


def _periods(spark, d):
    k = F.col("o_orderkey")
    start = F.lit(1703462400) + k * 4321
    return fx.table(spark, d, "orders").select(k.alias("id"), start.alias("start"), (start + (k % 60 - 3) * 86400).alias("stop"))


@query(
    "align_period",
    f"""WITH p AS ({_PERIOD}), c AS (SELECT *, floor((start - 1704067200) / 86400.0)::BIGINT AS a, floor((stop - 1704067200) / 86400.0)::BIGINT AS b FROM p),
    r AS (SELECT *, CASE WHEN stop < start THEN 'backwards' WHEN b - a + 1 > 48 THEN 'chunks' END AS code FROM c)
    SELECT id, unnest(range(a, b + 1)) AS chunk, code FROM r WHERE code IS NULL UNION ALL SELECT id, NULL, code FROM r WHERE code IS NOT NULL""",
)
def align_period(spark, d):
    return C.align_period(_periods(spark, d))


@query("chunk_number", f"SELECT id, floor((start - 1704067200) / 86400.0)::BIGINT AS chunk, floor((start - 1704067200) / 86400.0)::BIGINT * 86400 + 1704067200 AS begins FROM ({_PERIOD})")
def chunks(spark, d):
    number = chunk_number(F.col("start"), C.EPOCH, C.STEP_S, C.SPAN)
    return _periods(spark, d).select("id", number.alias("chunk"), chunk_begins(number, C.EPOCH, C.STEP_S, C.SPAN).alias("begins"))


_ASKED = "asked AS (SELECT l_orderkey AS id, CASE WHEN l_partkey % 4 = 0 THEN 'era5/x/' || l_suppkey ELSE 'era5/' || p_type || '/' || l_partkey END AS key, l_partkey % 5 AS k, epoch_us(l_shipdate) // 1000000 AS sec FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"


def _asked(spark, d):
    part = fx.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = fx.table(spark, d, "lineitem").join(part, "l_partkey", "left")
    key = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("era5/x/"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("era5/"), F.col("p_type"), F.lit("/"), F.col("l_partkey").cast("string")))
    from ..functions.fields import epoch_seconds

    return rows.select(F.col("l_orderkey").alias("id"), key.alias("key"), epoch_seconds(F.col("l_shipdate").cast("timestamp_ntz")).alias("at"))


@query(
    "cache_serve",
    with_tables(
        f"""{_ASKED} SELECT a.id, a.key, CASE WHEN c.key IS NOT NULL AND c.bytes % 7 <> 0 THEN 'hit' WHEN n.key IS NOT NULL THEN 'refused' WHEN c.key IS NOT NULL THEN 'orphan' ELSE 'fetch' END AS status
    FROM asked a LEFT JOIN fx_cache c ON a.key = c.key LEFT JOIN fx_absent n ON n.key = a.key AND n.until > {NOW}""",
        "fx_cache",
        "fx_absent",
    ),
)
def cache_serve(spark, d):
    index = fx.cache_index(spark, d)
    return C.cache_serve(_asked(spark, d), index, index.where("bytes % 7 <> 0").select("key"), fx.absent(spark, d), NOW)


_NEW = "fresh AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'new/' || p_partkey ELSE 'era5/' || p_type || '/' || p_partkey END AS key, 'era5-final' AS source_version, 500000 + p_partkey AS bytes, 1706702400 AS last_access, 0 AS access_count, 900 AS cost_ms, false AS pinned FROM part WHERE p_partkey % 3 = 1)"


@query(
    "cache_record",
    with_tables(
        f"{_NEW} SELECT key, coalesce(b.bytes, a.bytes) AS bytes, coalesce(b.last_access, a.last_access) AS last_access, coalesce(a.access_count, b.access_count) AS access_count, coalesce(b.cost_ms, a.cost_ms) AS cost_ms, coalesce(a.pinned, b.pinned) AS pinned FROM fx_cache a FULL OUTER JOIN fresh b USING (key)",
        "fx_cache",
    ),
)
def cache_record(spark, d):
    k = F.col("p_partkey")
    key = F.when(k % 2 == 0, F.concat(F.lit("new/"), k.cast("string"))).otherwise(F.concat_ws("/", F.lit("era5"), "p_type", k.cast("string")))
    new = fx.table(spark, d, "part").where(k % 3 == 1).select(
        key.alias("key"), F.lit("era5-final").alias("source_version"), (500000 + k).alias("bytes"), F.lit(NOW).cast("long").alias("last_access"), F.lit(0).cast("long").alias("access_count"), F.lit(900).cast("long").alias("cost_ms"), F.lit(False).alias("pinned")
    )
    path = L.scratch(spark)
    snapshots.commit(fx.cache_index(spark, d), path)
    return snapshots.update(spark, path, lambda index: C.cache_record(index, new)).drop("source_version")


@query(
    "mark_absent",
    with_tables(
        f"r AS (SELECT 'era5/x/' || s_suppkey * 2 AS key, 'late' AS reason, {NOW} AS sec FROM supplier) SELECT key, coalesce(r.reason, a.reason) AS reason, coalesce(a.since, sec) AS since, coalesce(sec + 21600, a.until) AS until FROM fx_absent a FULL OUTER JOIN r USING (key)",
        "fx_absent",
    ),
)
def mark_absent(spark, d):
    new = fx.table(spark, d, "supplier").select(F.concat(F.lit("era5/x/"), (F.col("s_suppkey") * 2).cast("string")).alias("key"), F.lit("late").alias("reason"), F.lit(NOW).cast("long").alias("at"))
    path = L.scratch(spark)
    snapshots.commit(fx.absent(spark, d), path)
    return snapshots.update(spark, path, lambda absent: C.mark_absent(absent, new))


@query("clear_absent", with_tables("SELECT key, until FROM fx_absent WHERE key NOT IN (SELECT 'era5/x/' || n_nationkey FROM nation)", "fx_absent"))
def clear_absent(spark, d):
    arrived = fx.table(spark, d, "nation").select(F.concat(F.lit("era5/x/"), F.col("n_nationkey").cast("string")).alias("key"))
    return C.clear_absent(fx.absent(spark, d), arrived).select("key", "until")


@query("cache_forget", with_tables("SELECT key, bytes FROM fx_cache WHERE bytes % 7 <> 0", "fx_cache"))
def cache_forget(spark, d):
    index = fx.cache_index(spark, d)
    return C.cache_forget(index, index.where("bytes % 7 <> 0").select("key")).select("key", "bytes")


@query("cache_pin", with_tables("SELECT key, CASE WHEN access_count = 4 THEN true WHEN access_count = 3 THEN false ELSE pinned END AS pinned FROM fx_cache", "fx_cache"))
def cache_pin(spark, d):
    index = fx.cache_index(spark, d)
    return C.cache_pin(index, index.where("access_count >= 3").select("key", (F.col("access_count") == 4).alias("pinned"))).select("key", "pinned")


@query("cache_touch", with_tables(f"{_ASKED}, seen AS (SELECT key, max(sec) AS sec, count(*) AS n FROM asked GROUP BY key) SELECT key, greatest(last_access, sec) AS last_access, access_count + coalesce(n, 0) AS access_count FROM fx_cache LEFT JOIN seen USING (key)", "fx_cache"))
def cache_touch(spark, d):
    return C.cache_touch(fx.cache_index(spark, d), _asked(spark, d).select("key", "at")).select("key", "last_access", "access_count")


@query("cache_by_source", with_tables("SELECT key, last_access FROM fx_cache WHERE source_version = 'era5t'", "fx_cache"))
def cache_by_source(spark, d):
    return fx.cache_index(spark, d).where("source_version = 'era5t'").select("key", "last_access")


@query("lru_walk", with_tables("SELECT key, row_number() OVER (PARTITION BY source_version ORDER BY last_access, key) AS place FROM fx_cache", "fx_cache"))
def lru_walk(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("source_version").orderBy("last_access", "key")
    return fx.cache_index(spark, d).select("key", F.row_number().over(order).cast("long").alias("place"))


@query("absent_live", with_tables(f"SELECT key, reason, until FROM fx_absent WHERE until > {NOW}", "fx_absent"))
def absent_live(spark, d):
    return fx.absent(spark, d).where(F.col("until") > NOW).select("key", "reason", "until")


@query("expired_absent", with_tables(f"SELECT count(*) FILTER (until <= {NOW}) AS expired, count(*) FILTER (until > {NOW}) AS kept FROM fx_absent", "fx_absent"))
def expired_absent(spark, d):
    return fx.absent(spark, d).agg(F.count_if(F.col("until") <= NOW).alias("expired"), F.count_if(F.col("until") > NOW).alias("kept"))


@query("total_bytes", with_tables("SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes FROM fx_cache", "fx_cache"))
def total_bytes(spark, d):
    return C.occupancy(fx.cache_index(spark, d)).select("bytes")


@query("cache_occupancy", with_tables("SELECT sum(bytes)::BIGINT AS bytes, (sum(bytes) FILTER (pinned))::BIGINT AS pinned_bytes, count(*) AS objects FROM fx_cache", "fx_cache"))
def occupancy(spark, d):
    return C.occupancy(fx.cache_index(spark, d))


def _log_now(d):
    return "(SELECT max(sec) FROM fx_log)"


def _last(log):
    """The last moment of the journal: one number, as a subquery."""
    return log.agg(F.max("at").alias("t")).scalar()


_RATES = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS total, count(*) FILTER (hit) AS hits FROM fx_log WHERE sec >= (SELECT max(sec) FROM fx_log) - {s} {c}"
    for n, s, c in (("hour", 3600, ""), ("day", 86400, ""), ("point", 86400, "AND endpoint LIKE '%point%'"), ("grid", 86400, "AND endpoint LIKE '%grid%'"))
)


@query("hit_rate", with_tables(f"SELECT name, total, hits, CASE WHEN total > 0 THEN hits / total::DOUBLE ELSE 0.0 END AS rate, total > 0 AND hits / total::DOUBLE < 0.5 AS poor FROM ({_RATES})", "fx_log"))
def hit_rate(spark, d):
    log = fx.query_log(spark, d)
    return C.hit_rate(log, _last(log))


_MISS = "SELECT count(*) AS misses, avg(latency_ms) AS mean, list_sort(list(latency_ms))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)] AS p95 FROM fx_log WHERE NOT hit AND sec >= (SELECT max(sec) FROM fx_log) - {}"


@query("miss_latency", with_tables(_MISS.format(864000), "fx_log"))
def miss_latency(spark, d):
    log = fx.query_log(spark, d)
    return C.miss_latency(log, _last(log) - 864000)


_TOP = "SELECT area, count(*) AS asked, count(*) FILTER (hit) AS hits FROM fx_log WHERE area IS NOT NULL AND sec >= (SELECT max(sec) FROM fx_log) - {} GROUP BY area ORDER BY asked DESC, area LIMIT {}"


@query("top_spots", with_tables(_TOP.format(864000, 10), "fx_log"))
def top_spots(spark, d):
    log = fx.query_log(spark, d)
    return C.top_spots(log, _last(log) - 864000)


@query(
    "cache_report",
    with_tables(
        f"SELECT o.*, r.*, m.*, t.* FROM (SELECT sum(bytes)::BIGINT AS bytes, (sum(bytes) FILTER (pinned))::BIGINT AS pinned_bytes, count(*) AS objects FROM fx_cache) o, (SELECT total, hits, hits / total::DOUBLE AS rate FROM ({_RATES}) WHERE name = 'day') r, ({_MISS.format(86400)}) m, (SELECT area AS top_area, asked AS top_asked FROM ({_TOP.format(86400, 1)})) t",
        "fx_cache",
        "fx_log",
    ),
)
def cache_report(spark, d):
    log = fx.query_log(spark, d)
    return C.cache_report(fx.cache_index(spark, d), log, _last(log))


@query("cache_key", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE 'era5/2t/' || c_custkey END AS key FROM customer")
def cache_key(spark, d):
    k = F.col("c_custkey")
    rows = fx.table(spark, d, "customer").select(k.alias("id"), F.lit("era5").alias("a"), F.when(k % 4 == 0, "").when(k % 7 == 0, "a/b").otherwise("2t").alias("b"), k.cast("string").alias("c"))
    return N.cache_key(rows, ["a", "b", "c"]).select("id", "key")


@query("run_id_artifact", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 % 6 = 0 THEN 'forecast/' || strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad((o_orderkey % 8)::VARCHAR, 2, '0') || 'Z' END AS artifact FROM orders")
def run_id_artifact(spark, d):
    at = F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 8).cast("int"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("forecast/"), run_id(at)).alias("artifact"))


@query("layer_from_path", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'previous' WHEN 2 THEN 'points' ELSE 'coarse' END AS layer FROM part")
def layer_from_path(spark, d):
    path = F.element_at(F.array(*map(F.lit, ("runs/coarse/hourly/zarr", "runs/x/previous", "points/a/b/c", "runs/other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return N.layer_from_path(fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))).select("id", "layer")


@query("cycle_deadlines", with_tables("SELECT init, CASE WHEN init % 21600 = 0 THEN init + 25200 END AS poll, CASE WHEN init % 21600 = 0 THEN init + 30600 END AS fallback, CASE WHEN init % 21600 = 0 THEN init + 34200 END AS publish, CASE WHEN init % 21600 <> 0 THEN 'grid' END AS refusal FROM (SELECT init + n % 2 * 3600 AS init FROM fx_run)", "fx_run"))
def cycle_deadlines(spark, d):
    return U.cycle_deadlines(fx.runs(spark, d).select((F.col("init") + F.col("n") % 2 * 3600).alias("init")))


_PHASE_AT = 900000000
_PHASE = "CASE WHEN {0} < 25200 THEN 'wait' WHEN {0} < 30600 THEN 'poll' WHEN {0} < 34200 THEN 'fallback' ELSE 'missed' END"


@query("cycle_phase", f"SELECT p_partkey AS id, {_PHASE.format('(p_partkey * 1800 % 43200)')} AS phase FROM part")
def cycle_phase(spark, d):
    from ..functions.fields import cycle_phase as phase

    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), phase(F.col("p_partkey") * 1800 % 43200).alias("phase"))


@query("latest_run", with_tables("SELECT sec, floor((sec - 25200) / 21600.0)::BIGINT * 21600 AS init FROM (SELECT DISTINCT sec FROM fx_log)", "fx_log"))
def latest_run(spark, d):
    return U.latest_run(fx.query_log(spark, d).select("at").distinct()).select(F.col("at").alias("sec"), "init")


@query("skip_if_missed", with_tables(f"SELECT init FROM fx_run WHERE {_PHASE_AT} - init >= 34200 AND last_order % 3 = 0 AND last_order % 5 <> 0", "fx_run"))
def skip_if_missed(spark, d):
    runs = fx.runs(spark, d)
    return U.skip_if_missed(runs.select("init"), runs.where("last_order % 3 <> 0").select("init"), runs.where("last_order % 5 = 0").select("init"), _PHASE_AT)


@query("run_log", with_tables("SELECT strftime(make_timestamp(init * 1000000), '%Y-%m-%dT%HZ') AS run_id, CASE WHEN n % 4 = 0 THEN 'skipped' WHEN status = 'F' THEN 'published' ELSE 'unfinished' END AS state, init, CASE WHEN n % 4 = 0 THEN 'no_input' END AS reason FROM fx_run WHERE status <> 'O' OR n % 4 = 0", "fx_run"))
def run_log(spark, d):
    from ..functions.fields import from_epoch

    runs = fx.runs(spark, d).withColumn("run_id", run_id(from_epoch(F.col("init"))))
    manifests = runs.where("status <> 'O'").select("run_id", (F.col("status") == "F").alias("published"), F.array(F.col("init") - 432000, F.col("init")).alias("inputs"))
    return U.run_log(manifests, runs.where("n % 4 = 0").select("run_id", "init", F.lit("no_input").alias("reason")))


@query(
    "build_manifest",
    """WITH i AS (SELECT l_orderkey AS run_id, bool_or(l_partkey % 11 = 0) AS source, bool_or(l_partkey % 13 = 0) AS checksum, bool_or(l_suppkey % 7 = 3) AS stream, bool_or(l_linenumber = 6) AS fields FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey AS run_id, list_sort(list_filter([CASE WHEN source THEN 'source' END, CASE WHEN checksum THEN 'checksum' END, CASE WHEN stream THEN 'stream' END, CASE WHEN fields THEN 'fields' END,
    CASE WHEN i.run_id IS NULL THEN 'inputs' END, CASE WHEN o_orderkey % 9 = 0 THEN 'steps' END, CASE WHEN o_orderkey % 10 = 0 THEN 'timings_sec' END, CASE WHEN o_orderkey % 12 = 1 THEN 'degraded.reason' END,
    CASE WHEN o_orderkey % 12 IN (1, 2) AND o_orderkey % 2 = 1 THEN 'degraded.waited_for' END], lambda x: x IS NOT NULL)) AS x FROM orders LEFT JOIN i ON i.run_id = o_orderkey)
    SELECT run_id, coalesce(array_to_string(x, ','), '') AS refusals FROM r""",
)
def build_manifest(spark, d):
    rows = fx.table(spark, d, "lineitem")
    inputs = rows.select(
        F.col("l_orderkey").alias("run_id"),
        F.when(F.col("l_partkey") % 11 == 0, "elsewhere").otherwise("ifs-analysis").alias("source"),
        F.when(F.col("l_suppkey") % 7 == 3, "").otherwise("ifs/0p25/oper").alias("stream"),
        F.when(F.col("l_partkey") % 13 == 0, "md5:0").otherwise("sha256:0").alias("checksum"),
        F.when(F.col("l_linenumber") == 6, F.array(F.lit("2t"), F.lit("no such"))).otherwise(F.array(F.lit("2t"))).alias("fields"),
    )
    k = F.col("o_orderkey")
    times = {x: F.lit(1) for x in U.TIMINGS}
    full = F.create_map(*[y for x, v in times.items() for y in (F.lit(x), v)])
    heads = fx.table(spark, d, "orders").select(
        k.alias("run_id"),
        F.when(k % 9 == 0, 0).otherwise(40).alias("steps"),
        F.when(k % 10 == 0, F.map_filter(full, lambda x, _: x != "publish")).otherwise(full).alias("timings"),
        F.when(k % 12 == 1, "tired").when(k % 12 == 2, "late_input").alias("degraded_reason"),
        F.when(k % 2 == 0, F.array(F.lit("ifs"))).otherwise(F.array().cast("array<string>")).alias("waited_for"),
    )
    return U.manifest_rules(inputs, heads)


@query("build_skip", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 4 THEN 'reason' WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'waited_for' WHEN o_orderkey % 7 = 0 THEN 'attempts' END AS refusal FROM orders")
def build_skip(spark, d):
    k = F.col("o_orderkey")
    reason = F.element_at(F.array(*map(F.lit, ("no_input", "late_input", "failed", "failed", "weather"))), (k % 5 + 1).cast("int"))
    rows = fx.table(spark, d, "orders").select(k.alias("run_id"), reason.alias("reason"), F.when(k % 2 == 1, F.array(F.lit("ifs"))).alias("waited_for"), F.when(k % 7 == 0, -1).otherwise(2).alias("attempts"))
    return U.skip_rules(rows)


_ENTRIES = "entries AS (SELECT init AS run_id, e AS entry, status = 'F' AS published, init + 30000 AS manifest_at FROM fx_run, (VALUES ('coarse'), ('hourly'), ('previous'), ('manifest.json'), ('validation.json')) t(e) WHERE status <> 'O' OR e = 'coarse')"


def _entries(spark, d):
    entry = F.explode(F.array(*map(F.lit, ("coarse", "hourly", "previous", "manifest.json", "validation.json"))))
    rows = fx.runs(spark, d).select(F.col("init").alias("run_id"), entry.alias("entry"), (F.col("status") == "F").alias("published"), (F.col("init") + 30000).alias("manifest_at"), "status")
    return rows.where("status <> 'O' or entry = 'coarse'").drop("status")


@query(
    "rotate_select",
    with_tables(
        f"""{_ENTRIES}, p AS (SELECT max(init) AS cur, (SELECT max(init) FROM fx_run WHERE status = 'F' AND init < (SELECT max(init) FROM fx_run WHERE status = 'F')) AS prev FROM fx_run WHERE status = 'F'),
    e AS (SELECT run_id, entry, entry IN ('manifest.json', 'validation.json', 'skip.json') OR (run_id = prev AND entry = 'previous') AS stays FROM entries, p WHERE run_id <> cur AND run_id % 4 <> 3 AND NOT (NOT published AND {_PHASE_AT} - manifest_at < 21600))
    SELECT DISTINCT run_id, CASE WHEN any_ THEN entry END AS entry FROM (SELECT *, bool_or(stays) OVER (PARTITION BY run_id) AS any_ FROM e) WHERE NOT stays""",
        "fx_run",
    ),
)
def rotate_select(spark, d):
    done = fx.runs(spark, d).where("status = 'F'").select("init")
    current = done.agg(F.max("init").alias("current"))
    pointers = current.crossJoin(done).where("init < current").groupBy("current").agg(F.max("init").alias("previous"))
    entries = _entries(spark, d)
    return U.rotate_select(entries, pointers, entries.where("run_id % 4 = 3").select("run_id").distinct(), _PHASE_AT)


@query(
    "publish_gate",
    with_tables(
        f"""{_ENTRIES}, s AS (SELECT run_id, list_sort(list_concat(list_filter(['coarse', 'hourly', 'validation.json'], lambda x: NOT list_contains(list(entry), x)), CASE WHEN run_id % 8 = 0 THEN ['taken'] ELSE [] END)) AS x FROM entries GROUP BY run_id)
    SELECT run_id, coalesce(array_to_string(x, ','), '') AS reasons FROM s""",
        "fx_run",
    ),
)
def publish_gate(spark, d):
    entries = _entries(spark, d)
    final = entries.where("run_id % 8 = 0 or entry = 'skip.json'")
    return U.publish_gate(entries, final)


@query("publish_advance", with_tables("f AS (SELECT row_number() OVER (ORDER BY init) AS seq, init::VARCHAR AS current, lag(init::VARCHAR) OVER (ORDER BY init) AS previous FROM fx_run WHERE status = 'F') SELECT * FROM f UNION ALL SELECT max(seq) + 1, 'new', arg_max(current, seq) FROM f", "fx_run"))
def publish_advance(spark, d):
    from pyspark.sql import Window

    order = Window.orderBy("init")  # the pointer's history: a row for each publication
    runs = fx.runs(spark, d).where("status = 'F'").select("init")
    pointer = runs.select(F.row_number().over(order).cast("long").alias("seq"), F.col("init").cast("string").alias("current"), F.lag(F.col("init").cast("string")).over(order).alias("previous"))
    path = L.scratch(spark)
    snapshots.commit(pointer, path)
    return snapshots.update(spark, path, lambda rows: U.publish_advance(rows, "new"))


@query("derive_layer", with_tables("SELECT variable, count(*) AS n FROM (SELECT * FROM fx_field UNION ALL SELECT 'sp', time, lat_i, lon_i, lat, lon, 1 FROM fx_grid) WHERE variable IN ('2t', '10u', '10v', 'msl', 'tp_1h', 'tcc', '2d', 'i10fg') GROUP BY 1", "fx_field"))
def derive_layer(spark, d):
    field = fx.field(spark, d)
    extra = fx.grid(spark, d).select(F.lit("sp").alias("variable"), "time", "lat_i", "lon_i", "lat", "lon", F.lit(1.0).cast("float").alias("value"))
    return U.derive_layer(field.unionByName(extra)).groupBy("variable").agg(F.count("*").alias("n"))


_EXPECTED = "want AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {(len(s) + 13 * len(a)) * n * 721 * 1440 * 4}::BIGINT)" for k, (s, a, _, n) in canon.LAYERS.items()) + ") t(layer, want))"


@query(
    "layer_bytes",
    with_tables(
        f"""{_EXPECTED}, s AS (SELECT strftime(date_trunc('day', time), '%Y-%m-%d') AS run_id, layer, count(*) * 4 AS size, any_value(want) AS want FROM fx_field, want WHERE layer <> 'analysis' OR variable NOT IN ('tp_1h', 'i10fg') GROUP BY ALL)
    SELECT 'layer' AS scope, run_id, layer AS name, size AS bytes, want AS expected FROM s UNION ALL SELECT 'run', run_id, 'run', sum(size)::BIGINT, sum(want)::BIGINT FROM s WHERE layer IN ('coarse', 'hourly') GROUP BY run_id
    UNION ALL SELECT 'pinned', run_id, 'pinned', sum(size)::BIGINT, sum(want)::BIGINT FROM s WHERE layer IN ('coarse', 'hourly', 'points', 'previous') GROUP BY run_id""",
        "fx_field",
    ),
)
def layer_bytes(spark, d):
    """Weights of the layers that each day's fields would make, by layer, run and what stays on disk."""
    of = F.broadcast(canon.layers(spark).select("layer", "variable"))
    days = fx.field(spark, d).groupBy(F.substring(iso(F.col("time")), 1, 10).alias("run_id"), "variable").agg(F.count("*").alias("values"))
    return U.layer_weights(days.join(of, "variable"))


@query(
    "read_amplification",
    with_tables(
        """s AS (SELECT CASE WHEN endpoint LIKE '%point' THEN 1460 ELSE 1 END AS t, CASE WHEN endpoint LIKE '%grid' THEN 721 ELSE 1 END AS y, CASE WHEN endpoint LIKE '%grid' THEN 1440 ELSE 1 END AS x, count(*) AS n FROM fx_log GROUP BY ALL)
    SELECT 'maps' AS layout, sum(n * t * y * x)::BIGINT AS needed, sum(n * t * 721 * 1440)::BIGINT AS touched FROM s UNION ALL
    SELECT 'series', sum(n * t * y * x)::BIGINT, sum(n * ceil(t / 1460) * 1460 * ceil(y / 4) * 4 * ceil(x / 4) * 4)::BIGINT FROM s""",
        "fx_log",
    ),
)
def read_amplification(spark, d):
    point, grid = F.col("endpoint").endswith("point"), F.col("endpoint").endswith("grid")
    shapes = fx.query_log(spark, d).select(F.when(point, 1460).otherwise(1).alias("times"), F.lit(1).alias("levels"), F.when(grid, canon.N_LAT).otherwise(1).alias("lats"), F.when(grid, canon.N_LON).otherwise(1).alias("lons"))
    return U.read_amplification(shapes.groupBy("times", "levels", "lats", "lons").agg(F.count("*").alias("n")))


@query("stage_timings", "SELECT l_orderkey AS run_id, sum(s)::BIGINT AS total_s, arg_max(l_linenumber::VARCHAR, s * 10 + l_linenumber) AS slowest, sum(s) > 4800 AS over FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity * 60)::BIGINT AS s FROM lineitem GROUP BY ALL) GROUP BY 1")
def stage_timings(spark, d):
    rows = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("stage")).agg(F.sum(F.col("l_quantity") * 60).cast("long").alias("seconds"))
    return U.stage_timings(rows)


@query("query_journal", with_tables("SELECT endpoint, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (hit) AS hits FROM fx_log GROUP BY ALL", "fx_log"))
def query_journal(spark, d):
    rows = fx.query_log(spark, d)
    return rows.groupBy("endpoint", F.substring(iso(F.col("ts")), 1, 10).alias("day")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
