"""Suffix-array dedup on bytes, by prefix-free parsing.

Triggers are the smallest rolling fingerprints of 32 bytes in every stretch of 69 positions,
so each 100-byte string holds a trigger that its own bytes pick. They cut a document into
phrases: the starts that share a trigger, with the bytes up to the end of the last string.
A phrase begins and ends by the same rule wherever it occurs, none is a proper prefix of
another with that trigger and extent, and the parse is the sequence of phrases.

The corpus order that decides is that of suffixes cut off after 100 bytes. It is put
together from two sorts. The parse is sorted by (trigger, phrase, document, position), which orders
all starts of equal phrases at once. Suffixes of the dictionary (the distinct phrases) need an
order only where a trigger has several phrases: there, stretches of eight starts are told apart
by what they cover, and what is left open is sorted over the whole table by its 100 bytes, as a
suffix array in range partitions. Neighbours with equal bytes are one group, in which the first by
(doc_id, start) stays; bytes of the others go. repeats.py has the sorts.

Null and empty texts have no bytes and lose none; texts under 100 bytes lose none. Rows that
repeat id and text are read as one document; rows that share an id and differ are documents of
their own, in the order of a hash of their texts. A null doc_id comes before all others. Texts of
any length are searched whole. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rolling, mix, slices, text_hash
from .repeats import covered, parse_rows, repeated_windows

_U = np.uint64
LENGTH = 100
TRIGGER = 32
#: Key of the digests that tell whole stretches apart.
SPAN_KEY = b"whole stretches"
#: Suffixes of a phrase that are compared at once before they are compared one by one.
BLOCK = 8
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (upper 32 bits; leftmost) in values[i : i + width]."""
    best = (values & _U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (best & _U(0xFFFFFFFF)).astype(np.int64)


def keyed_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed digest of each stretch of bytes, independent of the rolling fingerprints that choose triggers."""
    raw = data.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=8, key=SPAN_KEY).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), dtype="<u8").copy()


def _parse(length: int, trigger: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if len(part.data) < length:
                continue
            rolling = byte_rolling(part.data)
            i = np.arange(len(part.data) - trigger + 1)
            grams = rolling.of(i, i + trigger)
            chosen = sliding_argmin(grams, length - trigger + 1)
            size = np.diff(part.off)
            left = np.repeat(part.off[1:], size) - np.arange(len(part.data))  # bytes to the document's end
            at = np.flatnonzero(left[: len(chosen)] >= length)
            if not len(at):
                continue
            where = chosen[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (where[1:] != where[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(at)))
            begin, where = at[first], where[first]
            own = part.owner(begin)
            span = keyed_names(part.data, begin, begin + count - 1 + length)
            span = mix(span ^ mix(((where - begin) << 16 | count).astype(np.uint64)))
            anchor, start = grams[where], begin - part.off[own]
            yield parse_rows(part, own, anchor, span, (start, where - begin, count), True)

    return parse


def _names(part, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = part.off[doc]
    return tuple(byte_rolling(part.data, second).of(base + start, base + end) for second in (False, True))


def _contents(length: int):
    def contents(part, doc: np.ndarray, start: np.ndarray) -> list[bytes]:
        raw, at = part.data.tobytes(), (part.off[doc] + start).tolist()
        return [raw[a : a + length] for a in at]

    return contents


def _with_repeats(docs: DataFrame, length: int, trigger: int) -> DataFrame:
    sizes = lambda part: np.diff(part.off)
    return repeated_windows(docs, _parse(length, trigger), _names, sizes, length, first_only=True, block=BLOCK, contents=_contents(length))


def _cut(part, length: int):
    """Removed bytes (a mask), and for each document how many and in how many runs."""
    size = np.diff(part.off)
    gone = covered(part, size, length)
    sums = np.concatenate([[0], np.cumsum(gone)])
    edge = np.zeros(len(gone), dtype=bool)
    if len(gone):
        edge[0] = gone[0]
        edge[1:] = gone[1:] & ~gone[:-1]
        inner = part.off[part.off < len(gone)]
        edge[inner] = gone[inner]
    edges = np.concatenate([[0], np.cumsum(edge)])
    return gone, np.diff(sums[part.off]), np.diff(edges[part.off])


def later_copies_report(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            gone, removed, spans = _cut(part, length)
            kept = part.data[~gone]
            size = np.diff(part.off)
            edge = np.concatenate([[0], np.cumsum(size - removed)])
            digest = [hashlib.sha256(kept[a:b].tobytes()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(size), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(digest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_repeats(docs, length, trigger).mapInArrow(finish, REPORT)


def remove_later_copies(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """The same rows and columns, with later copies of long strings cut out of text.

    A character of which only some bytes go, goes whole. A null text stays null.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            gone, removed, _ = _cut(part, length)
            kept = part.data[~gone]
            edge = np.concatenate([[0], np.cumsum(np.diff(part.off) - removed)])
            text = [kept[a:b].tobytes().decode(errors="ignore") for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id"), part.column("hash"), pa.array(text, pa.string())], names=["doc_id", "hash", "cut"])

    found = _with_repeats(docs, length, trigger)
    changed = found.where("coalesce(size(settled), 0) + coalesce(size(settled_2), 0) + coalesce(size(single), 0) > 0")
    changed = changed.select("doc_id", "settled", "settled_2", "single", "text", text_hash(F.col("text")).alias("hash"))
    # Copies of a row (equal id and text) are cut alike. The rows keep their columns, whatever their names, in a struct.
    changed = changed.mapInArrow(finish, "doc_id long, hash long, cut string").dropDuplicates(["doc_id", "hash"])
    changed = changed.select(F.col("doc_id").alias("id"), "hash", "cut")
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (text_hash(F.col("row.text")) == F.col("hash"))
    rows = rows.join(changed, same, "left")
    text = F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.coalesce("cut", "row.text"))
    return rows.select(*[text.alias("text") if x == "text" else F.col("row")[x].alias(x) for x in docs.columns])
