"""History aggregates and verification of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import nan_to_null

NODE = ["variable", "lat_i", "lon_i"]


def _value():
    return nan_to_null(F.col("value").cast("double"))


def period_aggregate(field: DataFrame, unit: str) -> DataFrame:
    """Mean, lowest and highest by node and day or month (unit)."""
    period = F.date_format(F.date_trunc(unit, "time"), "yyyy-MM-dd")
    return field.groupBy(*NODE, period.alias("period")).agg(F.avg(_value()).alias("mean"), F.min(_value()).alias("low"), F.max(_value()).alias("high"), F.count("*").alias("n"))


def thin_to_6h(field: DataFrame) -> DataFrame:
    return field.where((F.hour("time") % 6 == 0) & (F.minute("time") == 0))


def climatology(field: DataFrame) -> DataFrame:
    """Mean by node and calendar month."""
    return field.groupBy(*NODE, F.month("time").alias("month")).agg(F.avg(_value()).alias("mean"), F.count("*").alias("n"))


def persistence(forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Adds held: the value of each node at the first moment of its run, held constant."""
    first = forecast.groupBy(*keys, *NODE).agg(F.min_by("value", "time").alias("held"))
    return forecast.join(first, [*keys, *NODE])


def _errors(pairs: DataFrame, keys: list[str]) -> DataFrame:
    weight = F.cos(F.radians("lat"))
    gap = F.isnan("value") | F.isnan("truth") | F.col("value").isNull() | F.col("truth").isNull()
    d = F.col("value").cast("double") - F.col("truth").cast("double")
    return pairs.where(~gap).groupBy(*keys).agg(F.sqrt(F.sum(weight * d * d) / F.sum(weight)).alias("rmse"), F.count("*").alias("n"))


def rmse_weighted(forecast: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rmse, n: error weighted by the cosine of latitude."""
    pairs = forecast.join(truth.select(*NODE, "time", F.col("value").alias("truth")), [*NODE, "time"])
    return _errors(pairs, keys)


def anomaly_correlation(forecast: DataFrame, truth: DataFrame, normal: DataFrame, keys: list[str]) -> DataFrame:
    """keys, acc: weighted correlation of the anomalies against a climatology (NODE, month, mean)."""
    rows = forecast.join(truth.select(*NODE, "time", F.col("value").alias("truth")), [*NODE, "time"]).withColumn("month", F.month("time"))
    rows = rows.join(normal.select(*NODE, "month", "mean"), [*NODE, "month"]).where(~F.isnan("value") & ~F.isnan("truth"))
    a, b, w = F.col("value").cast("double") - F.col("mean"), F.col("truth").cast("double") - F.col("mean"), F.cos(F.radians("lat"))
    return rows.groupBy(*keys).agg((F.sum(w * a * b) / F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))).alias("acc"))


def skill_table(forecast: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rmse of the forecast and of persistence, and the share of persistence error removed. forecast has held."""
    pairs = forecast.join(truth.select(*NODE, "time", F.col("value").alias("truth")), [*NODE, "time"])
    own = _errors(pairs, keys).select(*keys, F.col("rmse").alias("forecast"))
    held = _errors(pairs.withColumn("value", F.col("held")), keys).select(*keys, F.col("rmse").alias("persistence"))
    rows = own.join(held, keys)
    return rows.withColumn("skill", F.when(F.col("persistence") > 0, 1 - F.col("forecast") / F.col("persistence")))


def run_comparison(current: DataFrame, previous: DataFrame) -> DataFrame:
    """NODE, time, now, before, change: how the forecast for one valid time changed between runs."""
    rows = current.select(*NODE, "time", F.col("value").alias("now")).join(previous.select(*NODE, "time", F.col("value").alias("before")), [*NODE, "time"])
    return rows.withColumn("change", F.col("now").cast("double") - F.col("before").cast("double"))


def period_gaps(have: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """start, stop, steps: the missing pieces of a period. have: at (seconds); steps from first to last."""
    spark = have.sparkSession
    lost = spark.range(first, last + 1, step).withColumnRenamed("id", "at").join(have, "at", "left_anti")
    order = Window.orderBy("at")  # the steps of one period: a year of hours is 8 760 rows
    island = F.col("at") - F.row_number().over(order) * step
    return lost.withColumn("island", island).groupBy("island").agg(F.min("at").alias("start"), F.max("at").alias("stop"), F.count("*").alias("steps")).drop("island")


def replace_preliminary(old: DataFrame, final: DataFrame, key: list[str]) -> DataFrame:
    """Rows after final ones replaced preliminary ones of the same key."""
    return old.join(final, key, "left_anti").unionByName(final)


def history_limits(requests: DataFrame) -> DataFrame:
    """Adds code: start before 1940, or a period over 100 years for a point and over 1 year for a map (start, stop in seconds)."""
    years = (F.col("stop") - F.col("start")) / (365.25 * 86400)
    code = F.when(F.col("start") < -946771200, "start").when(F.col("stop") < F.col("start"), "order").when((F.col("kind") == "point") & (years > 100), "years").when((F.col("kind") == "grid") & (years > 1), "years")
    return requests.withColumn("code", code)


def export_region(field: DataFrame, south: float, north: float, west: float, east: float, variables: list[str], start: str | None = None, stop: str | None = None) -> DataFrame:
    """Rows of a box, of some variables, in an inclusive period (None: open)."""
    rows = field.where(F.col("variable").isin(variables) & F.col("lat").between(south, north) & F.col("lon").between(west, east))
    for bound, keep in ((start, lambda t: F.col("time") >= t), (stop, lambda t: F.col("time") <= t)):
        if bound is not None:
            rows = rows.where(keep(F.lit(bound).cast("timestamp_ntz")))
    return rows


JOB = "job_id string, status string, url string, source string, init_time string, expires_at long"


def write_export(rows: DataFrame, path: str, job_id: str, source: str, init_time: str, expires_at: int) -> DataFrame:
    """Writes an export (one folder, its rows with their origin) and then its job record; returns the record.

    The record comes last, so a job without one is not ready. Exports carry source and init_time as answers do.
    """
    url = f"{path}/files/{job_id}"
    told = rows.withColumns({"source": F.lit(source), "init_time": F.lit(init_time)})
    told.write.mode("errorifexists").partitionBy("variable").option("compression", "zstd").parquet(url)
    record = rows.sparkSession.createDataFrame([(job_id, "ready", url, source, init_time, expires_at)], JOB)
    record.coalesce(1).write.mode("errorifexists").json(f"{path}/jobs/{job_id}")
    return record


def export_status(asked: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    """job_id, code (200, 404 for an unknown job, 410 for one whose file has expired) and url. asked: job_id; jobs: JOB."""
    rows = asked.join(jobs, "job_id", "left")
    code = F.when(F.col("status").isNull(), 404).when(F.col("expires_at") <= now, 410).otherwise(200)
    return rows.select("job_id", code.alias("code"), F.when(code == 200, F.col("url")).alias("url"))


def stale(index: DataFrame, final: DataFrame, key: str = "key") -> DataFrame:
    """Cache rows of preliminary data that final data of the same chunk has replaced."""
    return index.where("source_version = 'era5t'").join(final.select(key), key, "left_semi")
