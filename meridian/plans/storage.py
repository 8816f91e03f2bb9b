"""Queries of sources, sinks and streams that write and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import from_epoch, iso, run_id
from ..operators import messages as M
from ..operators import normalize as N
from ..operators import runs as U
from ..operators import validate as V
from ..sources import fixtures as fx
from ..sources import layers as L
from ..sources import snapshots
from ..sources.fixtures import NOW, with_tables
from ..streaming import streams as S
from .book import query
from .fields import _CANON, raw
from .quality import _FAMILIES, _OF, KEY, _all_checks, metadata, whole_artifacts
from .requests import ISO, axes


def _stored(spark, d, layer="points", series=False):
    path = L.scratch(spark)
    L.write_layer(fx.field(spark, d), path, layer, series)
    return path


_COUNT = "SELECT variable, count(*) AS n, round(sum(CASE WHEN NOT isnan(value) THEN value::DOUBLE END), 2) AS total FROM fx_field {} GROUP BY variable"


def _counted(rows):
    return rows.groupBy("variable").agg(F.count("*").alias("n"), F.round(F.sum(F.when(~F.isnan("value"), F.col("value").cast("double"))), 2).alias("total"))


@query("scan_layer", with_tables(_COUNT.format("WHERE variable IN ('2t', 'msl') AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"), "fx_field"))
def scan_layer(spark, d):
    return _counted(L.scan_layer(spark, _stored(spark, d), ["2t", "msl"], "2024-01-05", "2024-01-12"))


@query("scan_archive_slice", with_tables(f"SELECT level, lat_i, lon_i, round(CASE WHEN NOT isnan(value) THEN value::DOUBLE END, 4) AS value FROM fx_level WHERE variable = 't' AND time = TIMESTAMP '2024-01-03 06:00:00' AND level IN {canon.LEVELS}", "fx_level"))
def scan_archive_slice(spark, d):
    """The contract's levels of one field and moment, of an archive that has more levels."""
    path = L.scratch(spark)
    L.write_layer(fx.level_field(spark, d), path, "coarse")
    rows = L.scan_archive_slice(spark, path, "t", "2024-01-03T06:00:00")
    return rows.select("level", "lat_i", "lon_i", F.round(F.when(~F.isnan("value"), F.col("value").cast("double")), 4).alias("value"))


_RUN_ROWS = "SELECT variable, level, count(*) AS n, max(time) AS last FROM (SELECT variable, NULL::INT AS level, time FROM fx_field UNION ALL SELECT variable, level, time FROM fx_level WHERE level IN (500, 850)) WHERE variable IN ('2t', 'msl', 't') AND time <= (SELECT max(time) FROM fx_grid) - INTERVAL 5 DAY GROUP BY ALL"


@query("scan_run", with_tables(f"SELECT variable, level, n, {ISO.format('last')} AS last FROM ({_RUN_ROWS})", "fx_field", "fx_level"))
def scan_run(spark, d):
    """Of two runs, the later of which ends five days before the other, the one that the pointer names; two levels of one field."""
    path, field = L.scratch(spark), N.with_level(fx.field(spark, d)).unionByName(fx.level_field(spark, d))
    end = F.broadcast(fx.grid(spark, d).agg((F.max("time") - F.expr("interval 5 days")).alias("end")))
    L.write_run(field, path, "2024-01-01T00Z", "coarse")
    L.write_run(field.join(end, F.col("time") <= F.col("end")).drop("end"), path, "2024-01-01T06Z", "coarse")
    pointers = L.scratch(spark)
    U.publish_advance(U.publish_advance(spark.createDataFrame([], "seq long, current string, previous string"), "2024-01-01T00Z"), "2024-01-01T06Z").write.parquet(pointers)
    rows = L.scan_run(spark, path, spark.read.parquet(pointers), "coarse", ["2t", "msl", "t"], levels=[500, 850])
    return rows.groupBy("variable", "level").agg(F.count("*").alias("n"), iso(F.max("time")).alias("last"))


@query("write_layer", with_tables(_COUNT.format("WHERE variable NOT IN ('tp_1h', 'i10fg')"), "fx_field"))
def write_layer(spark, d):
    return _counted(spark.read.schema(L.FIELD).parquet(_stored(spark, d, "analysis")))


@query("write_checked", with_tables("SELECT variable AS field, name, CASE name WHEN 'nan_fraction' THEN holes / n::DOUBLE <= 0.001 WHEN 'physical_range' THEN low IS NOT NULL AND low >= lo AND high <= hi ELSE low IS NULL OR low <> high END AS passed FROM (SELECT variable, count(*) AS n, count(*) FILTER (isnan(value)) AS holes, min(value) FILTER (NOT isnan(value)) AS low, max(value) FILTER (NOT isnan(value)) AS high FROM fx_field GROUP BY variable) JOIN (VALUES " + ", ".join(f"('{k}', {canon.VARIABLES[k][1]}, {canon.VARIABLES[k][2]})" for k in fx.FORMULAS) + ") r(variable, lo, hi) USING (variable), (VALUES ('nan_fraction'), ('physical_range'), ('not_constant')) c(name)", "fx_field"))
def write_checked(spark, d):
    """The physics checks of a layer, from the pass that writes it."""
    stats = L.write_checked(fx.field(spark, d), L.scratch(spark), "points").withColumn("artifact", F.lit("points"))
    return V.physics_checks(stats, KEY).select("field", "name", "passed")


@query("layout_maps", with_tables(_COUNT.format(""), "fx_field"))
def layout_maps(spark, d):
    return _counted(spark.read.schema(L.FIELD).parquet(_stored(spark, d)))


@query("layout_series", with_tables(_COUNT.format(""), "fx_field"))
def layout_series(spark, d):
    return _counted(spark.read.schema(L.FIELD).parquet(_stored(spark, d, series=True)))


_RUN = "strftime(make_timestamp(init * 1000000), '%Y-%m-%dT%HZ')"


def _manifests(spark, d):
    entry = lambda s, shift: F.struct(F.lit(s).alias("source"), (F.col("init") - shift).alias("valid_time"))
    return fx.runs(spark, d).select(run_id(from_epoch(F.col("init"))).alias("run_id"), (F.col("status") == "F").alias("published"), F.lit(40).alias("steps"), F.array(entry("era5t", 432000), entry("ifs-analysis", 0)).alias("inputs"))


@query("manifest_read", with_tables(f"SELECT {_RUN} AS run_id, 40 AS steps, init AS latest FROM fx_run WHERE status <> 'F'", "fx_run"))
def manifest_read(spark, d):
    path = L.scratch(spark)
    L.write_manifests(_manifests(spark, d), path)
    return L.read_manifests(spark, path).select("run_id", "steps", F.array_max(F.transform("inputs", lambda x: x["valid_time"])).alias("latest"))


@query("manifest_write", with_tables(f"SELECT {_RUN} AS refused FROM fx_run WHERE status = 'F'", "fx_run"))
def manifest_write(spark, d):
    return L.write_manifests(_manifests(spark, d), L.scratch(spark)).select(F.col("run_id").alias("refused"))


@query("log_query_append", with_tables("SELECT endpoint, count(*) AS n FROM fx_log GROUP BY endpoint", "fx_log"))
def log_query_append(spark, d):
    path, log = L.scratch(spark), fx.query_log(spark, d)
    for number, part in enumerate(("event_id % 2 = 0", "event_id % 2 = 1", "event_id % 2 = 1")):
        S.journal(path)(log.where(part), min(number, 1))  # the last batch is repeated and replaces itself
    return spark.read.parquet(path).groupBy("endpoint").agg(F.count("*").alias("n"))


def _listing(spark, d):
    path = F.concat_ws("/", F.concat(F.lit("stage"), (F.col("l_orderkey") % 50).cast("string")), F.col("l_linenumber").cast("string"))
    at = F.lit(NOW) - 3600 * (F.col("l_orderkey") % 50) - F.col("l_linenumber")
    return fx.table(spark, d, "lineitem").select(path.alias("path"), at.alias("at"), (1000 * F.col("l_quantity")).cast("long").alias("length"))


@query("scratch_stale", "SELECT 'stage' || l_orderkey % 50 AS top, 3600 * (l_orderkey % 50) + min(l_linenumber) >= 86400 AS stale FROM lineitem GROUP BY l_orderkey % 50")
def scratch_stale(spark, d):
    return L.scratch_listing(_listing(spark, d), NOW).select("top", "stale")


def _text_files(spark, d):
    """The texts of documents in sixteen files, a text and a newline after the other in the order of doc_id."""
    path = L.scratch(spark)
    rows = fx.table(spark, d, "documents").select((F.col("doc_id") % 16).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return path


@query("scratch_bytes", "SELECT sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, sum(octet_length(encode(coalesce(text, ''))) + 1) > 1000000 AS over_quota FROM documents")
def scratch_bytes(spark, d):
    """The weight of a folder, from its listing."""
    return M.folder_bytes(spark, f"{_text_files(spark, d)}/*/*.txt", quota=1_000_000)


@query("checksum_files", "SELECT doc_id % 16 AS part, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS length, 'sha256:' || sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS checksum FROM documents GROUP BY 1")
def checksum_files(spark, d):
    rows = M.checksum_files(spark, f"{_text_files(spark, d)}/*/*.txt")
    return rows.select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("part"), "length", "checksum")


@query("lat_descending", with_tables("SELECT DISTINCT lat_i, round_even(lat, 2) AS lat FROM fx_grid", "fx_grid"))
def lat_descending(spark, d):
    rows = N.rename_coords(raw(spark, d)).select("lat").distinct()
    lats, _ = axes(spark)
    return N.lat_round(rows).join(F.broadcast(lats), "lat").select("lat_i", "lat")


@query("init_time", with_tables(f"SELECT {ISO.format('time')} AS time, {ISO.format("time - INTERVAL 6 HOUR")} AS init_time FROM (SELECT DISTINCT time FROM fx_grid)", "fx_grid"))
def init_time(spark, d):
    rows = N.valid_time(raw(spark, d)).groupBy("time").agg(F.min("init_time").alias("init_time"))
    return rows.select(iso(F.col("time")).alias("time"), iso(F.col("init_time")).alias("init_time"))


@query("level_axis", "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 14 * 50 END AS level FROM lineitem")
def level_axis(spark, d):
    text = F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") % 14 * 50).cast("string"))
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), text.alias("isobaricInhPa"))
    return N.rename_coords(rows).withColumn("level", F.col("level").cast("long"))


@query("rename_coords", with_tables("SELECT lat, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon, count(*) * 5 AS n FROM fx_grid GROUP BY ALL", "fx_grid"))
def rename_coords(spark, d):
    return N.rename_coords(raw(spark, d)).groupBy("lat", "lon").agg(F.count("*").alias("n"))


@query("time_naive_utc", with_tables("SELECT count(DISTINCT time) AS steps, true AS passed FROM fx_grid", "fx_grid"))
def time_naive_utc(spark, d):
    field = fx.field(spark, d)
    return field.agg(F.count_distinct("time").alias("steps")).withColumn("passed", F.lit(V.time_naive(field)))


@query("check_families", with_tables(f"{_FAMILIES} SELECT level, count(*) AS n, count(*) FILTER (ok) AS passed FROM checks WHERE level <> 'grib' GROUP BY level", *_OF))
def check_families(spark, d):
    units, leads = metadata(spark, d)
    checks = V.check_families(whole_artifacts(spark, d), KEY, "points", (6, 8), 135.0, units=units, leads=leads)
    return checks.groupBy("level").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query("validate_layer", with_tables(f"{_FAMILIES} SELECT 'runs/' || artifact || '/points' AS path, 'points' AS layer, bool_and(ok) AS ok FROM checks WHERE level IN ('structure', 'semantics', 'physics') GROUP BY artifact", *_OF))
def validate_layer(spark, d):
    """Verdicts by path, of three levels of checks."""
    checks = _all_checks(spark, d, ["structure", "semantics", "physics"])
    rows = V.summary(checks, KEY).select(F.concat(F.lit("runs/"), "artifact", F.lit("/points")).alias("path"), "ok")
    return N.layer_from_path(rows).select("path", "layer", "ok")


def _run(frame, spark, batch=None, mode="append"):
    """Run a stream over what is there to a table, and read that; with a sink of batches there is nothing to read here."""
    path, checkpoint = L.scratch(spark), L.scratch(spark)
    writer = frame.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return None if batch else spark.read.schema(frame.schema).parquet(path)


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _replayed(spark, rows):
    """Rows as a stream: written to a folder that is read as it fills."""
    path = L.scratch(spark)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


_KIND = "CASE WHEN endpoint LIKE '%point%' THEN 'point' WHEN endpoint LIKE '%grid%' THEN 'grid' ELSE 'other' END"


def _log(spark, d):
    return fx.query_log_of(_stream(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _windows(frame, spark, key):
    """All windows of a stream as of its end, open ones too: each batch's windows replace their rows in a snapshot table."""
    path = L.scratch(spark)
    _run(frame, spark, S.upserter(path, key), "update")
    return snapshots.read(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema))


#: In output mode append, windows end when the watermark, ten minutes behind the last row, has passed them.
_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM {})"


@query(
    "stream_hit_rate",
    with_tables(
        f"""SELECT strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS start, kind, total, hits, CASE WHEN total > 0 THEN hits / total::DOUBLE ELSE 0.0 END AS rate, day_total, day_hits, day_hits / day_total::DOUBLE AS day_rate
        FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS start, {_KIND} AS kind, count(*) FILTER (k = 0) AS total, count(*) FILTER (k = 0 AND hit) AS hits, count(*) AS day_total, count(*) FILTER (hit) AS day_hits FROM fx_log, range(24) t(k) GROUP BY ALL)""",
        "fx_log",
    ),
)
def stream_hit_rate(spark, d):
    """The hour and the day that begin at each hour. An hour without requests has the rate 0."""
    rows = _windows(S.hit_rate(_log(spark, d)), spark, ["start", "stop", "kind"])
    hour = F.col("stop") == F.col("start") + F.expr("INTERVAL 1 HOUR")
    # A window has one row, so the sums are its values.
    of = lambda name, here: F.coalesce(F.sum(F.when(here, F.col(name))), F.lit(0))
    names = ["total", "hits", "rate"]
    both = rows.groupBy("start", "kind").agg(*[of(n, hour).alias(n) for n in names], *[of(n, ~hour).alias(f"day_{n}") for n in names])
    return both.withColumn("start", iso(F.col("start")))


@query("stream_hit_rate_day", with_tables(f"SELECT strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS start, kind, count(*) AS total, count(*) FILTER (hit) AS hits FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS start, {_KIND} AS kind, hit FROM fx_log, range(24) t(k)) WHERE start + INTERVAL 24 HOUR <= {_CLOSED.format('fx_log')} GROUP BY ALL", "fx_log"))
def stream_hit_rate_day(spark, d):
    """Days that slide by hours."""
    rows = _run(S.hit_rate(_log(spark, d), "24 hours", "1 hour"), spark)
    return rows.select(iso(F.col("start")).alias("start"), "kind", "total", "hits")


@query("stream_miss_latency", with_tables("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS start, count(*) AS misses, avg(latency_ms) AS mean, quantile_disc(latency_ms, 0.95) AS p95 FROM fx_log WHERE NOT hit GROUP BY ALL", "fx_log"))
def stream_miss_latency(spark, d):
    return _windows(S.miss_latency(_log(spark, d)), spark, ["start"]).select(iso(F.col("start")).alias("start"), "misses", "mean", "p95")


@query("stream_access_state", with_tables("SELECT area AS key, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_access, count(*) AS access_count FROM fx_log WHERE area IS NOT NULL GROUP BY area", "fx_log"))
def stream_access_state(spark, d):
    """Each batch's keys replace their rows in a snapshot table."""
    log = _log(spark, d).where("area is not null").withColumnRenamed("area", "key")
    path = L.scratch(spark)
    _run(S.access_state(log), spark, S.upserter(path, "key"), "update")
    return snapshots.read(spark, path).select("key", iso(F.col("last_access")).alias("last_access"), "access_count")


@query("stream_lateness", "SELECT o_orderkey AS id, CASE WHEN w < 30600 THEN 'on_time' WHEN w < 34200 THEN 'fallback' ELSE 'missed' END AS state, CASE WHEN w >= 30600 AND w < 34200 THEN 'late_input' END AS degraded FROM (SELECT o_orderkey, o_orderkey * 600 % 43200 AS w FROM orders)")
def stream_lateness(spark, d):
    rows = _stream(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("init"), (F.col("o_orderkey") * 600 % 43200).alias("arrived"))
    return _run(S.lateness(rows).select("id", "state", "degraded"), spark)


@query(
    "stream_negative_cache",
    """WITH e AS (SELECT 'u' || user_id AS key, epoch_us(ts) // 1000000 AS sec, event_type = 'error' AS refusal, event_id FROM events WHERE event_type IN ('error', 'purchase')),
    p AS (SELECT *, lag(refusal) OVER w AS refused, lag(sec) OVER w AS before FROM e WINDOW w AS (PARTITION BY key ORDER BY sec, event_id)),
    q AS (SELECT *, coalesce(refused AND before + 21600 > sec, false) AS shut FROM p)
    SELECT key, sec AS "at", CASE WHEN NOT refusal THEN 'closed' WHEN shut THEN 'prolonged' ELSE 'opened' END AS event, CASE WHEN refusal THEN sec + 21600 ELSE sec END AS until FROM q WHERE refusal OR shut""",
)
def stream_negative_cache(spark, d):
    """Errors of a user as refusals of a key, purchases as data that arrived."""
    rows = _stream(spark, d, "events").where("event_type in ('error', 'purchase')")
    kind = F.when(F.col("event_type") == "error", "refusal").otherwise("data")
    events = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return _run(S.negative_cache(events), spark)


@query("stream_ingest", with_tables(f"{_CANON} SELECT source, variable, count(*) AS n, round(sum(CASE WHEN NOT isnan(value) THEN value::DOUBLE END), 1) AS total FROM fx_canon GROUP BY ALL", "fx_grid"))
def stream_ingest(spark, d):
    """Decoded rows that all come twice, as a stream: each node of a message once, in canonical form."""
    rows = raw(spark, d)
    path = L.scratch(spark)
    stream = S.ingest(_replayed(spark, rows.unionByName(rows)), *axes(spark))
    _run(stream, spark, S.exactly_once(path))
    once = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
    return once.groupBy("source", "variable").agg(F.count("*").alias("n"), F.round(F.sum(F.when(~F.isnan("value"), F.col("value").cast("double"))), 1).alias("total"))


@query("stream_validate", "SELECT a AS artifact, bool_and(v BETWEEN 180 AND 340) AND min(v) <> max(v) AS ok, count(*) AS n FROM (SELECT user_id AS a, 180 + value AS v FROM events) GROUP BY a")
def stream_validate(spark, d):
    """Values of a user as a slice: good ones to one table, others to quarantine."""
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("artifact"), F.lit("2t").alias("variable"), (180 + F.col("value")).alias("value"))
    good, bad = L.scratch(spark), L.scratch(spark)
    _run(rows, spark, S.validator(good, bad))
    read = lambda path, ok: spark.read.schema(rows.schema).parquet(path).withColumn("ok", F.lit(ok))
    return read(good, True).unionByName(read(bad, False)).groupBy("artifact", "ok").agg(F.count("*").alias("n"))
