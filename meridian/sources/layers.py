"""Layers of runs as partitioned tables, in two layouts; scratch folders for queries that write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.fields import nan_to_null, non_finite
from ..operators.normalize import in_canonical_order, order, select_layer, with_level

FIELD = "variable string, level int, time timestamp_ntz, lat_i int, lon_i int, lat double, lon double, value float"
MANIFEST = "run_id string, published boolean, steps int, inputs array<struct<source: string, valid_time: bigint>>"
RUN_FIELD = f"run_id string, layer string, {FIELD}"
#: Nodes of a tile's side in the series layout, and of a block within it.
TILE, BLOCK = 64, 4


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; only a local session may name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/meridian-{uuid.uuid4().hex}"


def layout_maps(field: DataFrame) -> DataFrame:
    """One map (all nodes at one moment) is what is read together."""
    return in_canonical_order(field)


def layout_series(field: DataFrame) -> DataFrame:
    """A node's whole series is what is read together: tiles of nodes, blocks within, time last."""
    tile = [F.floor(F.col(x) / TILE) for x in ("lat_i", "lon_i")]
    block = [F.floor(F.col(x) / BLOCK) for x in ("lat_i", "lon_i")]
    return field.repartitionByRange("variable", *tile).sortWithinPartitions("variable", *tile, *block, "lat_i", "lon_i", "level", "time")


def write_layer(field: DataFrame, path: str, layer: str, series: bool = False) -> None:
    """Exactly the layer's fields to a new path; an existing one is an error. Surface fields have no level."""
    rows = with_level(select_layer(field, layer))
    rows = layout_series(rows) if series else layout_maps(rows)
    rows.write.mode("errorifexists").partitionBy("variable").option("compression", "zstd").parquet(path)


def write_series_table(field: DataFrame, table: str, path: str, layer: str, buckets: int = 64) -> None:
    """A layer as a table of buckets of nodes, each sorted by node and moment.

    What is joined or grouped by (lat_i, lon_i) finds its rows in one bucket, so reads of series need no exchange of fields.
    """
    rows = with_level(select_layer(field, layer)).repartition(buckets, "lat_i", "lon_i")
    rows.write.mode("errorifexists").bucketBy(buckets, "lat_i", "lon_i").sortBy("lat_i", "lon_i", "variable", "time").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)


def write_checked(field: DataFrame, path: str, layer: str, series: bool = False) -> DataFrame:
    """write_layer(), and a profile (variable, n, holes, low, high; as validate.profile) from the write's own pass.

    The rows are looked at as they pass to the files; the layer is not read again. There are four numbers for each of
    the layer's variables.
    """
    spark = field.sparkSession
    surface, atmos, _, _ = canon.LAYERS[layer]
    seen, number = Observation(), {}
    for k, x in enumerate(surface + atmos):
        mine = F.col("variable") == x
        value = F.when(mine, nan_to_null(F.col("value").cast("double")))
        number |= {f"n_{k}": F.count(F.when(mine, F.col("value"))), f"holes_{k}": F.count_if(mine & non_finite(F.col("value"))), f"low_{k}": F.min(value), f"high_{k}": F.max(value)}
    write_layer(field.observe(seen, *[v.alias(k) for k, v in number.items()]), path, layer, series)
    got = seen.get
    rows = [(x, got[f"n_{k}"], got[f"holes_{k}"], got[f"low_{k}"], got[f"high_{k}"]) for k, x in enumerate(surface + atmos) if got[f"n_{k}"]]
    return spark.createDataFrame(rows, "variable string, n long, holes long, low double, high double")


def scan_layer(spark: SparkSession, path: str, variables: list[str], start: str | None = None, stop: str | None = None, levels: list[int] | None = None) -> DataFrame:
    """Only the partitions of the variables, and the row groups of the period and the levels (of level fields)."""
    return _cut(spark.read.schema(FIELD).parquet(path), variables, start, stop, levels)


def _cut(rows: DataFrame, variables: list[str], start: str | None, stop: str | None, levels: list[int] | None) -> DataFrame:
    rows = rows.where(F.col("variable").isin(variables))
    if start is not None:
        rows = rows.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        rows = rows.where(F.col("time") <= F.lit(stop).cast("timestamp_ntz"))
    if levels is not None:
        asked = F.col("level").isin(levels)
        surface = [x for x in variables if x not in canon.ATMOS]
        rows = rows.where(F.col("level").isNull() | asked if surface else asked)
    return rows


def scan_archive_slice(spark: SparkSession, path: str, variable: str, moment: str, levels: list[int] | None = None) -> DataFrame:
    """One variable at one moment, in canonical order; of a level field the given levels (None: the contract's) and no others are read."""
    if variable in canon.ATMOS:
        levels = list(canon.LEVELS) if levels is None else levels
    return scan_layer(spark, path, [variable], moment, moment, levels if variable in canon.ATMOS else None).orderBy(*order())


def write_run(field: DataFrame, path: str, run_id: str, layer: str) -> None:
    """A layer of a run to its own partition of the table of all runs; a run's layer is written once."""
    write_layer(field, f"{path}/run_id={run_id}/layer={layer}", layer)


def scan_run(spark: SparkSession, path: str, pointer: DataFrame, layer: str, variables: list[str], start: str | None = None, stop: str | None = None, levels: list[int] | None = None) -> DataFrame:
    """Rows of the run that the newest pointer row names. pointer: a stored table of seq (from 1 on) and current.

    The run is found while the query runs: its partitions are pruned dynamically, so that other runs' files are
    neither listed to tasks nor opened.
    """
    newest = pointer.where("seq > 0").agg(F.max_by("current", "seq").alias("run_id"))
    rows = _cut(spark.read.schema(RUN_FIELD).parquet(path).where(F.col("layer") == layer), variables, start, stop, levels)
    return rows.join(F.broadcast(newest), "run_id", "left_semi")  # one row


def write_artifact(field: DataFrame, units: DataFrame, leads: DataFrame, path: str, layer: str) -> None:
    """A layer with what its values mean: units of each variable, start of the run and lead time of each moment."""
    write_layer(field, f"{path}/fields", layer)
    units.select("variable", "units").write.mode("errorifexists").json(f"{path}/units")
    leads.select("time", "init_time", "lead_hours").write.mode("errorifexists").json(f"{path}/leads")


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields, units and leads of an artifact."""
    units = spark.read.schema("variable string, units string").json(f"{path}/units")
    leads = spark.read.schema("time timestamp_ntz, init_time timestamp_ntz, lead_hours int").json(f"{path}/leads")
    return spark.read.schema(FIELD).parquet(f"{path}/fields"), units, leads


def write_manifests(runs: DataFrame, path: str) -> DataFrame:
    """Manifests as JSON lines; rows that already say published are refused and returned."""
    runs.where("not published").write.mode("append").json(path)
    return runs.where("published")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def scratch_listing(files: DataFrame, now: int, older_s: int = 86400) -> DataFrame:
    """top, bytes, stale of a file listing (path, at in seconds, length): staging folders of a day and more."""
    top = F.element_at(F.split("path", "/"), 1)
    return files.groupBy(top.alias("top")).agg(F.sum("length").alias("bytes"), (F.lit(now) - F.max("at") >= older_s).alias("stale"))
