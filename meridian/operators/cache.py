"""The cache of history chunks: what a period needs, what is there, what goes, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import chunk_number, eviction_score

#: Hourly maps: a day of steps to a chunk, at most 48 chunks a request.
EPOCH, STEP_S, SPAN, MOST_CHUNKS = 1704067200, 3600, 24, 48
#: Seconds that a refused key is left alone; shares of the capacity at which eviction begins and ends.
ABSENT_S = 21600
HIGH, LOW = 0.85, 0.70


def align_period(requests: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """id, chunk (null if refused), code: all chunks of inclusive periods (start, stop in seconds)."""
    rows = requests.withColumns({"first": chunk_number(F.col("start"), EPOCH, STEP_S, SPAN), "last": chunk_number(F.col("stop"), EPOCH, STEP_S, SPAN)})
    code = F.when(F.col("stop") < F.col("start"), "backwards").when(F.col("last") - F.col("first") + 1 > most, "chunks")
    rows = rows.withColumn("code", code)
    chunks = F.when(F.col("code").isNull(), F.sequence("first", F.greatest("first", "last")))
    return rows.select("id", F.explode_outer(chunks).alias("chunk"), "code")


def cache_serve(wanted: DataFrame, index: DataFrame, files: DataFrame, absent: DataFrame, now: int) -> DataFrame:
    """id, key, status: hit, orphan (a row without its file), refused or fetch. files: key."""
    rows = wanted.join(index.select("key", F.lit(True).alias("row")), "key", "left").join(files.select("key", F.lit(True).alias("file")), "key", "left")
    rows = rows.join(absent.where(F.col("until") > now).select("key", F.lit(True).alias("no")), "key", "left")
    status = F.when(F.col("row") & F.col("file"), "hit").when(F.col("no"), "refused").when(F.col("row"), "orphan").otherwise("fetch")
    return rows.select("id", "key", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The table after new rows: keys that were there keep the columns in keep, the rest is replaced.

    new has a row a key; both have the same columns. One full outer join, written as a new snapshot.
    """
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, key, "full_outer")
    columns = [F.coalesce(f"a.{c}", f"b.{c}") if c in keep else F.coalesce(f"b.{c}", f"a.{c}") for c in old.columns if c != key]
    return rows.select(key, *[x.alias(c) for x, c in zip(columns, [c for c in old.columns if c != key], strict=True)])


def cache_record(index: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks go in; repeats update bytes, cost and last access, and keep counter and pin."""
    return upsert(index, new, "key", ["access_count", "pinned"])


def mark_absent(absent: DataFrame, refusals: DataFrame, ttl_s: int = ABSENT_S) -> DataFrame:
    """Refusals (key, reason, at) go in or are prolonged; since is kept."""
    new = refusals.select("key", "reason", F.col("at").alias("since"), (F.col("at") + ttl_s).alias("until"))
    return upsert(absent, new, "key", ["since"])


def clear_absent(absent: DataFrame, arrived: DataFrame) -> DataFrame:
    return absent.join(arrived, "key", "left_anti")


def cache_forget(index: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is there."""
    return index.join(files, "key", "left_semi")


def cache_pin(index: DataFrame, pins: DataFrame) -> DataFrame:
    """pins: key, pinned."""
    rows = index.join(pins.withColumnRenamed("pinned", "_new"), "key", "left")
    return rows.withColumn("pinned", F.coalesce("_new", "pinned")).drop("_new")


def cache_touch(index: DataFrame, accesses: DataFrame) -> DataFrame:
    """last_access and access_count after a batch of accesses (key, at)."""
    seen = accesses.groupBy("key").agg(F.max("at").alias("_at"), F.count("*").alias("_n"))
    rows = index.join(seen, "key", "left")
    return rows.withColumns({"last_access": F.greatest("last_access", "_at"), "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0))}).drop("_at", "_n")


def unknown_keys(index: DataFrame, accesses: DataFrame) -> DataFrame:
    return accesses.join(index, "key", "left_anti")


def with_score(index: DataFrame, now: int) -> DataFrame:
    age = F.greatest(F.lit(now) - F.col("last_access"), F.lit(0)).cast("double")
    return index.withColumn("score", eviction_score(F.col("cost_ms"), F.col("bytes"), age))


#: Ranges that the running sum over all rows is cut into.
RANGES = 64


def eviction_select(index: DataFrame, capacity: int | Column, now: int, ranges: int = RANGES) -> DataFrame:
    """key, bytes, score of what goes when over 85 % of capacity is used, down to 70 %.

    Unpinned rows in ascending score; the row that crosses the mark goes too. The running sum is
    made in two passes: sums of score ranges (a row each), then a running sum within each range.
    """
    totals = index.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    rows = with_score(index.where("not pinned"), now)
    cuts = rows.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10000).alias("cuts"))
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")
    sums = rows.groupBy("part").agg(F.sum("bytes").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))  # a row for each range
    inside = Window.partitionBy("part").orderBy("score", "last_access", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(F.broadcast(before), "part")
    rows = rows.crossJoin(F.broadcast(totals))
    left = F.col("total") - F.col("before") - F.col("_own")
    return rows.where((F.col("total") > F.floor(F.lit(capacity) * HIGH)) & (left > F.floor(F.lit(capacity) * LOW))).select("key", "bytes", "score")


def eviction_report(index: DataFrame, capacity: int | Column, now: int) -> DataFrame:
    """removed, freed, before, after, target, triggered, enough."""
    gone = eviction_select(index, capacity, now).agg(F.count("*").alias("removed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("freed"))
    rows = index.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("before")).crossJoin(gone)
    rows = rows.withColumn("after", F.col("before") - F.col("freed")).withColumn("target", F.floor(F.lit(capacity) * LOW))
    triggered = F.col("before") > F.floor(F.lit(capacity) * HIGH)
    return rows.select("removed", "freed", "before", "after", "target", triggered.alias("triggered"), (~triggered | (F.col("after") <= F.col("target"))).alias("enough"))


def occupancy(index: DataFrame) -> DataFrame:
    return index.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("pinned"), F.col("bytes"))), F.lit(0)).alias("pinned_bytes"), F.count("*").alias("objects"))


def hit_rate(log: DataFrame, now: int | Column) -> DataFrame:
    """name, total, hits, rate, poor of the last hour and day, and of points and maps of the day, in one pass."""
    day = log.where(F.col("at") >= now - 86400)
    which = {"hour": F.col("at") >= now - 3600, "day": F.lit(True), "point": F.col("endpoint").contains("point"), "grid": F.col("endpoint").contains("grid")}
    sums = [x for k, c in which.items() for x in (F.count_if(c).alias(f"{k}_n"), F.count_if(c & F.col("hit")).alias(f"{k}_h"))]
    one = day.agg(*sums)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}_n").alias("total"), F.col(f"{k}_h").alias("hits")) for k in which])).alias("x")).select("x.*")
    rate = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0)
    return rows.select("name", "total", "hits", rate.alias("rate"), ((F.col("total") > 0) & (rate < 0.5)).alias("poor"))


def miss_latency(log: DataFrame, since: int) -> DataFrame:
    """misses, mean, p95 (nearest rank: place min(n, floor(0.95 n) + 1)).

    Latencies are whole milliseconds: they are counted by value, so that ranks come from a
    table of distinct values and not from all rows.
    """
    counts = log.where((F.col("at") >= since) & ~F.col("hit")).groupBy("latency_ms").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"upto": F.sum("n").over(Window.orderBy("latency_ms")), "total": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    place = F.least(F.col("total"), F.floor(F.col("total") * 0.95) + 1)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("misses"), F.coalesce(F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.min(F.when(F.col("upto") >= place, F.col("latency_ms"))), F.lit(0)).alias("p95")
    )


def top_spots(log: DataFrame, since: int, k: int = 10) -> DataFrame:
    """area, asked, hits of the most asked areas; ties by name."""
    rows = log.where((F.col("at") >= since) & F.col("area").isNotNull()).groupBy("area").agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits"))
    return rows.orderBy(F.desc("asked"), "area").limit(k)


def cache_report(index: DataFrame, log: DataFrame, now: int | Column) -> DataFrame:
    """One row: occupancy, the day's hit rate, miss latency and the most asked area."""
    day = hit_rate(log, now).where("name = 'day'").select("total", "hits", "rate")
    top = top_spots(log, now - 86400, 1).select(F.col("area").alias("top_area"), F.col("asked").alias("top_asked"))
    return occupancy(index).crossJoin(day).crossJoin(miss_latency(log, now - 86400)).crossJoin(top)
