"""Provider indexes to messages, messages to byte ranges, fields to loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon

GAP = 1 << 20


def parse_json_index(lines: DataFrame) -> DataFrame:
    """file, line, offset, length, param, level, refusal of JSON lines (file, line, value)."""
    row = F.from_json("value", "_offset bigint, _length bigint, param string, levelist string")
    rows = lines.where("trim(value) <> ''").withColumn("x", row)
    refusal = F.when(F.col("x._offset").isNull() | F.col("x._length").isNull(), "offset, length")
    return rows.select("file", "line", F.col("x._offset").alias("offset"), F.col("x._length").alias("length"), F.coalesce("x.param", F.lit("")).alias("param"), F.coalesce("x.levelist", F.lit("")).alias("level"), refusal.alias("refusal"))


def parse_colon_index(lines: DataFrame, part: str | None = None) -> DataFrame:
    """file, offset, length, param, level of num:offset:date:param:level:... lines (file, line, value).

    The length is the next offset less this one in the order of offsets; the last is open (null). part: a column that
    cuts a large file into stretches, offsets rising from each to the next; each is sorted alone, and its last line ends where the next begins.
    """
    stretch = F.col(part) if part else F.lit(0)
    split = F.split("value", ":")
    rows = lines.where("trim(value) <> ''").select("file", "line", split.alias("p"), stretch.alias("part"))
    offset = F.expr("try_cast(try_element_at(p, 2) as bigint)")
    rows = rows.select("file", "part", "line", offset.alias("offset"), F.try_element_at("p", F.lit(4)).alias("param"), F.try_element_at("p", F.lit(5)).alias("level"), (F.size("p") > 4).alias("whole"))
    refusal = F.when(~F.col("whole"), "fields").when(F.col("offset").isNull(), "offset")
    order = Window.partitionBy("file", *(["part"] if part else []), refusal.isNull()).orderBy("offset", "param", "level")
    after = F.lead("offset").over(order)
    if part:
        later = Window.partitionBy("file").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
        # The line goes along so that both sides read the same columns, and lines that are dealt by stretch are dealt once.
        firsts = rows.groupBy("file", "part").agg(F.min(F.when(refusal.isNull(), F.struct("offset", "line"))).alias("first"))
        nexts = firsts.select("file", "part", F.min("first.offset").over(later).alias("next"))  # a row for each stretch
        rows = rows.withColumn("after", after).join(F.broadcast(nexts), ["file", "part"], "left")
        after = F.coalesce("after", "next")
    length = F.when(refusal.isNull(), after - F.col("offset"))
    return rows.select("file", "line", "offset", length.alias("length"), "param", "level", refusal.alias("refusal"))


def read_lines(spark, path: str, suffix: str = "", stream: bool = False) -> DataFrame:
    """file, line, value of the text files below a path, lines numbered from 1 within a file; as a table or as a stream."""
    from ..sources.index_files import IndexLines

    spark.dataSource.register(IndexLines)
    rows = (spark.readStream if stream else spark.read).format("index_lines").option("suffix", suffix).load(path)
    return rows.withColumnRenamed("path", "file")


def select_messages(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages whose (param, level) is wanted in their file. wanted: file, param, level."""
    return messages.join(wanted, ["file", "param", "level"], "left_semi")


def missing_messages(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(messages, ["file", "param", "level"], "left_anti")


def byte_ranges(messages: DataFrame, gap: int = GAP) -> DataFrame:
    """file, start, stop (inclusive; null to the end), n: messages merged over holes of at most gap bytes.

    Islands by a running maximum of the ends; an open message swallows what follows.
    """
    if gap < 0:
        raise ValueError(f"gap: got {gap}, expected zero or more bytes")
    open_end = F.lit((1 << 63) - 1)
    end = F.when(F.col("length").isNull(), open_end).otherwise(F.col("offset") + F.col("length"))
    order = Window.partitionBy("file").orderBy("offset", "length")
    rows = messages.withColumn("end", end)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("offset") - gap <= F.coalesce(reach, F.lit(-1) - gap), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("file", "island").agg(F.min("offset").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    return merged.select("file", "start", F.when(F.col("end") < open_end, F.col("end") - 1).alias("stop"), "n")


def index_keys(fields: DataFrame) -> DataFrame:
    """key columns, param, level: what to ask an index for. Level fields give a pair for each level. fields: id, pos, variable."""
    level = F.explode(F.array(*[F.lit(str(x)) for x in canon.LEVELS]))
    atmos = F.col("variable").isin(list(canon.ATMOS))
    on_levels = fields.where(atmos).select("*", level.alias("level")).withColumn("param", F.col("variable"))
    param, place = F.col("variable"), F.lit("")
    for k, (p, lv) in canon.INDEX_NAMES.items():
        param, place = F.when(F.col("variable") == k, p).otherwise(param), F.when(F.col("variable") == k, lv).otherwise(place)
    return on_levels.unionByName(fields.where(~atmos).withColumn("level", place).withColumn("param", param))


def plan_requests(fields: DataFrame, lag_days: int = canon.REANALYSIS_LAG_DAYS) -> DataFrame:
    """id, source, stream, at, names, pos: fields (id, at seconds, pos, variable) grouped into loads, in order."""
    late = F.col("variable").isin(list(canon.PERSISTED))
    stream = F.lit(canon.DEFAULT_STREAM)
    for k, v in canon.STREAMS.items():
        stream = F.when(F.col("variable") == k, v).otherwise(stream)
    rows = fields.withColumns({
        "source": F.when(late, "era5t").otherwise("ifs-analysis"),
        "stream": F.when(late, canon.REANALYSIS_STREAM).otherwise(stream),
        "at": F.when(late, F.col("at") - lag_days * 86400).otherwise(F.col("at")),
    })
    first = rows.groupBy("id", "source", "stream", "at", "variable").agg(F.min("pos").alias("pos"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "variable"))), lambda x: x["variable"])
    return first.groupBy("id", "source", "stream", "at").agg(names.alias("names"), F.min("pos").alias("pos"))


def undownloadable(fields: DataFrame) -> DataFrame:
    return fields.where(~F.col("variable").isin([*canon.INGESTED, *canon.ATMOS, *canon.STATIC]))


def manifest_inputs(requests: DataFrame, checksums: DataFrame) -> DataFrame:
    """Requests with their checksums; refusal where there is none."""
    rows = requests.join(checksums, ["source", "stream", "at"], "left")
    return rows.withColumn("refusal", F.when(F.col("checksum").isNull(), "checksum"))


def checksum_files(spark, path: str) -> DataFrame:
    """path, length, checksum of binary files; Spark leaves out empty ones."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"))


def folder_bytes(spark, path: str, quota: int = 30 << 30) -> DataFrame:
    """bytes, over_quota of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("over_quota", F.col("bytes") > quota)
