"""Small tables that are replaced whole: numbered snapshots in plain folders and a pointer table.

A commit writes the new rows to a folder of their own and then one pointer row that names it. Readers take the
folder that the newest pointer row names, so they see the table before the commit or after it, whenever a
writer fails. Of two writers that began with the same snapshot, the second one's pointer row is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "seq long, folder string"


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot was read."""


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """The pointer table: a row for each commit. A path without commits has an empty one."""
    try:
        return spark.read.schema(POINTER).option("recursiveFileLookup", "true").json(f"{path}/pointer")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the last commit; (0, None) before the first."""
    row = pointers(spark, path).agg(F.max("seq").alias("seq"), F.max_by("folder", "seq").alias("folder")).first()
    return (row["seq"] or 0), row["folder"]


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table as of its last commit. schema: of an empty table, where there may be no commit yet."""
    _, folder = newest(spark, path)
    if folder is None:
        if schema is None:
            raise LookupError(f"snapshots: got none below {path}, expected one")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{folder}")


def commit(rows: DataFrame, path: str, after: int | None = None) -> int:
    """Makes rows the table's next snapshot, the one after `after` (None: after the last). Returns its number."""
    spark = rows.sparkSession
    seq = (newest(spark, path)[0] if after is None else after) + 1
    folder = f"snapshots/{seq}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{folder}")
    point = spark.createDataFrame([(seq, folder)], POINTER).coalesce(1)
    try:
        point.write.mode("errorifexists").json(f"{path}/pointer/{seq}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"snapshot {seq} of {path}: got one already, expected none") from error
    return seq


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], schema: str | None = None) -> DataFrame:
    """Reads the table, commits what change makes of it, and reads it again."""
    seq, _ = newest(spark, path)
    commit(change(read(spark, path, schema)), path, seq)
    return read(spark, path)
