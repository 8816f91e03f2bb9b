"""Quality rules with thresholds that follow each language and source.

Every document is measured once. A metric's values are counted in buckets of relative width
5 % (bucket = floor(log(value) / log(1.05))), by language and source. Such a table of counts is
a quantile sketch: tables merge by adding counts, in any order, and any quantile is known to
within a bucket. Spark adds them up before and after the shuffle, so a source with a third of
all documents costs a few hundred rows. A limit is the upper quartile plus a multiple of the
spread between the quartiles (in buckets, that is of the logarithm), and never below a floor
for shares that are harmless in any source (FLOORS; word lengths have none). A group's counts are merged with PRIOR
documents dealt like its language, and those of a language with PRIOR dealt like all, so a group
of few documents follows its language and a large one itself, by one rule at every size.
Documents are joined to the limits and filtered.

Nulls: a null text has no words and fails; a null language or source is a group of its own.
Rows are measured and judged each, also if they repeat a doc_id; documents of equal values (ties)
fall on the same side of a limit. Texts of any length are measured whole. Other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACE, Rolling, checkpointed, mix, runs_of, slices, spread, stretch_names, word_names, words_of

_U = np.uint64
WIDTH = 1.05
#: Quartile spreads above the upper quartile that are still allowed.
SPREADS = 3.0
#: Documents of the wider group that are merged into a group's counts.
PRIOR = 200
#: Counts are in such fractions of a document.
UNITS = 1000
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Metric -> value that is allowed everywhere: shares (of words; of lines for lines) that are 0 in most documents, so that a
#: group's quartiles say little about small ones. Word lengths have none: the sketches alone decide.
FLOORS = {"word_length": 0.0, "symbol_share": 0.01, "dup_line_share": 0.35, "repeat_share": 0.3}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def _by_byte(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[off])


def _triples(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name of the three words from each place on."""
    return mix(mix(mix(word[at]) ^ word[at + 1]) ^ word[at + 2])


def _alike(own: np.ndarray, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by document and (two independent) names, and whether each entry equals the one before."""
    order = np.lexsort((*names, own))
    columns = [x[order] for x in (own, *names)]
    return order, np.logical_and.reduce([x[1:] == x[:-1] for x in columns])


def measures_of(part) -> list[np.ndarray]:
    """The columns of MEASURES for the documents of a slice."""
    data, off, n_docs = part.data, part.off, len(part)
    starts, ends, doc = words_of(part)
    solid = ~_SPACE[data]
    word_chars = _by_byte(solid & ((data & 0xC0) != 0x80), off)
    # Lines with a word; the first of equal lines of a document is not counted.
    first, last = runs_of(data != 10, off)
    sums = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    filled = sums[last] > sums[first]
    first, last = first[filled], last[filled]
    line_doc = part.owner(first)
    order, same = _alike(line_doc, [stretch_names(data, first, last, x) for x in (False, True)])
    dup_lines = _per(line_doc[order][1:][same], n_docs)
    # Words in windows of three that the document has twice or more.
    covered = np.zeros(len(starts), dtype=bool)
    at = np.flatnonzero(doc[: max(0, len(doc) - 2)] == doc[2:])
    if len(at):
        order, same = _alike(doc[at], [_triples(word_names(part, starts, ends, x), at) for x in (False, True)])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered[spread(at[twice], np.full(int(twice.sum()), 3))] = True
    return [_per(doc, n_docs), word_chars, _by_byte(_SYMBOL[data], off), dup_lines, _per(doc[covered], n_docs), _per(line_doc, n_docs)]


def row_hash(docs: DataFrame | None = None) -> Column:
    """What a row is judged by, as one number: nulls and empty texts differ."""
    column = F.col if docs is None else docs.__getitem__
    return F.xxhash64(*[x for c in ("lang", "source", "text") for x in (column(c).isNull(), column(c).cast("string"))])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of lang, source and text), lang and source (texts), and MEASURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for part in slices(batches):
            columns = [part.column(x) for x in ("doc_id", "row", "lang", "source")] + [pa.array(x) for x in measures_of(part)]
            yield pa.record_batch(columns, names=["doc_id", "row", "lang", "source", *names])

    group = [F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("")).alias(x) for x in ("lang", "source")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row"), *group, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, row long, lang string, source string, {MEASURES}")


def _metrics() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
    }


#: The lowest bucket; what is smaller (or 0) counts there.
_LOWEST = -200


def bucket(value: Column) -> Column:
    return F.greatest(F.lit(_LOWEST), F.when(value > 0, F.floor(F.log(value) / math.log(WIDTH)).cast("int")).otherwise(_LOWEST))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: mergeable counts. rows: measured()."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in _metrics().items()]))
    return rows.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def _blended(counts: DataFrame, wider: DataFrame, by: list[str], to: list[str]) -> DataFrame:
    """Weights of buckets by group: UNITS for each document, and PRIOR documents dealt like the wider group.

    counts: by, metric, bucket, n. wider: to (a part of by), metric, bucket, weight.
    """
    whole = wider.groupBy(*to, "metric").agg(F.sum("weight").alias("whole"))
    share = wider.join(whole, [*to, "metric"]).select(*to, "metric", "bucket", F.expr(f"({UNITS * PRIOR} * weight) div whole").alias("weight"))
    prior = counts.select(*by, "metric").distinct().join(share, [*to, "metric"]).select(*by, "metric", "bucket", "weight")
    own = counts.select(*by, "metric", "bucket", (UNITS * F.col("n")).alias("weight"))
    return own.union(prior).groupBy(*by, "metric", "bucket").agg(F.sum("weight").alias("weight"))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and a limit for each metric."""
    counts = lambda by: sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    every = counts([]).select("metric", "bucket", (UNITS * F.col("n")).alias("weight"))
    by_lang = _blended(counts(["lang"]), every, ["lang"], [])
    by = ["lang", "source"]
    weights = _blended(counts(by), by_lang, by, ["lang"])
    group = Window.partitionBy(*by, "metric")
    upto = F.sum("weight").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    weights = weights.withColumn("upto", upto).withColumn("total", F.sum("weight").over(group))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    found = weights.groupBy(*by, "metric").agg(quartile(1).alias("low"), quartile(3).alias("high"))
    # The bucket above the last one allowed, as a value.
    value = F.pow(F.lit(WIDTH), F.col("high") + 1 + SPREADS * (F.col("high") - F.col("low")))
    found = found.withColumn("value", F.when(F.col("high") > _LOWEST, value).otherwise(0.0))
    columns = [F.max(F.when(F.col("metric") == k, F.greatest(F.col("value"), F.lit(v)))).alias("limit_" + k) for k, v in FLOORS.items()]
    return found.groupBy(*by).agg(*columns)


def judged_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, the measures, base_failed, kept and the first metric beyond its limit (or null)."""
    rows = checkpointed(measured(docs))
    sketch = checkpointed(sketches(rows))
    rows = rows.join(limits(sketch), ["lang", "source"], "left")
    over = F.coalesce(*[F.when(v > F.col("limit_" + k), F.lit(k)) for k, v in _metrics().items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("over", over)
    rows = rows.withColumn("kept", ~F.col("base_failed") & F.col("over").isNull())
    return rows.select("doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "over")


def judged(docs: DataFrame) -> DataFrame:
    """judged_rows without row: a row for each row of docs."""
    return judged_rows(docs).drop("row")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns."""
    gone = judged_rows(docs).where("not kept").select("doc_id", "row").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (row_hash(docs) == gone["row"])
    return docs.join(gone, same, "left_anti")
