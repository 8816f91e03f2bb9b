"""What the operators on text share: scratch space, byte views of Arrow batches, hashing.

Texts travel as Arrow batches and are worked on as one byte array per slice of a few
megabytes, so that a task's memory depends on the slice and on its longest document,
not on the table.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on. A step holds some ten arrays of eight bytes for each.
SLICE_BYTES = 800_000

_U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Without that setting a local session takes a folder of its own; a cluster must name one, as
    a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As checkpointed, as a table in the same folder.

    A checkpoint hands on the sizes that the planner has guessed; through rounds of joins these
    multiply until numbers have millions of digits. A table's size is known.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def with_twins(docs: DataFrame) -> DataFrame:
    """doc_id, twin, hash and text of every row; (doc_id, twin) is the key of a document.

    twin is 0 where all rows of an id have one text, and else a hash of the text. So rows that
    share an id (or have none) and differ are documents of their own, in the order of twin, and
    equal rows are one document. The ids with several texts are looked for first; only if
    there are any, rows are joined to them.
    """
    docs = id_and_text(docs)
    rows = docs.withColumn("hash", text_hash(F.col("text")))
    several = rows.groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low != high").select("doc_id")
    several = checkpointed(several)
    if several.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("twin"), "hash", "text")
    several = several.select(F.col("doc_id").alias("id"), F.lit(True).alias("some"))
    rows = rows.join(several, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return rows.select("doc_id", F.when(F.col("some"), F.col("hash")).otherwise(F.lit(0)).cast("long").alias("twin"), "hash", "text")


def same_document(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, twin), where a null id is a key like any other."""
    right = right.withColumnsRenamed({"doc_id": "_right_id", "twin": "_right_twin"})
    match = left["doc_id"].eqNullSafe(right["_right_id"]) & (left["twin"] == right["_right_twin"])
    return left.join(right, match, how).drop("_right_id", "_right_twin")


def unsigned_crc(value: Column) -> Column:
    return F.crc32(value)


class TextSlice:
    """Some documents as one byte array; document i is data[off[i]:off[i + 1]]."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray):
        self.batch, self.data, self.off = batch, data, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The document that holds each byte position."""
        return np.searchsorted(self.off, at, side="right") - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Cut batches into slices of at most limit bytes of text (or one longer document)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null("")
        text = text.cast(pa.large_string())
        buffers = text.buffers()
        off = np.frombuffer(buffers[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(text):
            last = max(int(np.searchsorted(off, off[first] + limit, side="right")) - 1, first + 1)
            last = min(last, len(text))
            yield TextSlice(batch.slice(first, last - first), data[off[first] : off[last]], off[first : last + 1] - off[first])
            first = last


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def runs_of(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, cut at the documents' borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(n + 1, dtype=bool)
    fresh[1:n] = ~inside[:-1]
    fresh[off[off < n]] = True
    starts = np.flatnonzero(inside & fresh[:n])
    stop = np.ones(n, dtype=bool)
    stop[:-1] = ~inside[1:]
    inner = off[(off > 0) & (off <= n)]
    stop[inner - 1] = True
    return starts, np.flatnonzero(inside & stop) + 1


def words_of(part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word [^\\x20\\x09-\\x0D]+."""
    starts, ends = runs_of(~_SPACE[part.data], part.off)
    return starts, ends, part.owner(starts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Two seeds of names that are independent of each other.
SEEDS = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)
#: Longer stretches of bytes are hashed one by one.
LONG = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros after the end) as one number."""
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def stretch_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit name of the bytes of each stretch: eight bytes at a time are mixed into it.

    A stretch of up to eight bytes is told apart from all others of its length for certain.
    """
    seed = SEEDS[second]
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) + _U(seed))
    if not len(starts):
        return out
    eight = eights(data)
    todo = np.flatnonzero(size <= LONG)
    at = 0
    while len(todo):
        left = size[todo] - at
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            break
        out[todo] = mix(out[todo] ^ (eight[starts[todo] + at] & MASKS[np.minimum(left, 8)]))
        at += 8
    for i in np.flatnonzero(size > LONG):
        raw = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(raw, "little")
    return out


#: Polynomials are taken modulo this prime.
_PRIME = (1 << 61) - 1
_M61, _M31, _M30 = _U(_PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)
#: Numbers that one numpy step multiplies, so that all intermediate arrays stay in a core's cache.
_STEP = 1 << 14


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 as numbers below the prime."""
    x = (x & _M61) + (x >> _U(61))
    return np.where(x >= _M61, x - _M61, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it."""
    a_high, a_low, b_high, b_low = a >> _U(31), a & _M31, b >> _U(31), b & _M31
    middle = a_high * b_low + a_low * b_high
    return _folded(_U(2) * a_high * b_high + (middle >> _U(30)) + ((middle & _M30) << _U(31)) + a_low * b_low)


class Rolling:
    """Polynomial fingerprints modulo 2**61 - 1 of any stretch of a sequence, after one prefix sum."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, second: bool = False):
        n = len(values)
        up, self.down = self._tables(SEEDS[second] % _PRIME, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        carry = 0
        for k in range(0, n, _STEP):
            some = slice(k, min(k + _STEP, n))
            term = _times(_folded(values[some].astype(np.uint64)), up[some])
            # Sums of the two halves of the terms can't overflow.
            high, low = np.cumsum(term >> _U(31)), np.cumsum(term & _M31)
            high = _folded(high)
            total = _folded(_folded((high >> _U(30)) + ((high & _M30) << _U(31))) + _folded(low) + _U(carry))
            self.sums[k + 1 : some.stop + 1] = total
            carry = int(total[-1])

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls._powers.get(base)
        if got is None or len(got[0]) < n:
            size = -(-n // (1 << 18)) << 18  # in large steps, so that it is seldom made anew
            pair = []
            for b in (base, pow(base, -1, _PRIME)):
                powers = np.ones(1, dtype=np.uint64)
                while len(powers) < size:
                    powers = np.concatenate([powers, _times(powers, np.full(1, pow(b, len(powers), _PRIME), np.uint64))])
                pair.append(powers[:size].copy())
            got = cls._powers[base] = (pair[0], pair[1])
        return got

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        for k in range(0, len(start), _STEP):
            a, b = start[k : k + _STEP], end[k : k + _STEP]
            out[k : k + _STEP] = mix(_times(_folded(self.sums[b] + (_M61 - self.sums[a])), self.down[a]))
        return out


def byte_rolling(data: np.ndarray, second: bool = False) -> Rolling:
    return Rolling(data + np.uint16(1), second)


def word_names(part: TextSlice, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit name of each word's bytes."""
    return stretch_names(part.data, starts, ends, second)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def flat_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts - starts, counts)
