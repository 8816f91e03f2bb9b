"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together again in another order.

A text is a list of units ([A-Za-z]+ or one other code point). Everything after the draw is a
pipeline of Arrow arrays, batch by batch: units as list arrays over the text's own bytes, flattened
with the indices of their texts, numbered within each, filtered by role, rebuilt as lists and joined.
Rows are worked on where they are: nothing is shuffled, and memory depends on the slice of texts (or on its
longest text) alone.

The draw depends on doc_id alone (four 32-bit numbers of a digest, made by Spark), so it is the same in
every run and partitioning. A null doc_id is drawn as an empty one. Null and empty texts are plain, as are texts that
hold a marker, so every output can be read back. Rows that are equal give equal rows; rows that share a
doc_id are cut by the same draw, each by its own number of units. An empty table gives an empty one. Columns other
than doc_id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextSlice, id_and_text, slices

#: Markers of prefix, suffix and middle. None may begin inside another or at another's end.
MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many stay plain, and how many of the others have their suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
FORMS = ("plain", "psm", "spm")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def units(part: TextSlice) -> pa.ListArray:
    """The units of each text of a slice, as views of its bytes."""
    data, off = part.data, part.off
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[off[:-1][off[:-1] < off[1:]]] = True
    at = np.flatnonzero(begins).astype(np.int32)
    ends = pa.py_buffer(np.append(at, np.int32(len(data))))
    flat = pa.StringArray.from_buffers(len(at), ends, pa.py_buffer(np.ascontiguousarray(data)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, off).astype(np.int32)), flat)


def pieces(lists: pa.ListArray, low: pa.Array, high: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The units before low, from there to high, and from high on, of each list, joined."""
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    first = pc.subtract(lists.offsets[:-1], lists.offsets[0])
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))
    before, after = pc.less(ordinal, pc.take(low, parent)), pc.greater_equal(ordinal, pc.take(high, parent))
    roles = (before, pc.invert(pc.or_(before, after)), after)
    n = pc.list_value_length(lists)
    counts = (low, pc.subtract(high, low), pc.subtract(n, high))
    out = []
    for role, count in zip(roles, counts, strict=True):
        off = np.concatenate([[0], np.cumsum(np.asarray(count))]).astype(np.int32)
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(off), pc.filter(flat, role)), ""))
    return out[0], out[1], out[2]


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def infilled(docs: DataFrame, markers: tuple[str, str, str] = MARKERS, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of docs (doc_id, text)."""
    p, s, m = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = units(part)
            text = pc.fill_null(part.column("text"), "")
            n = pc.list_value_length(lists).cast(pa.int64())
            one, two = (_modulo(part.column(h), pc.add(n, 1)) for h in ("h1", "h2"))
            low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
            prefix, middle, suffix = pieces(lists, low, high)
            plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(part.column("h3"), pa.scalar(100)), 100 - plain_percent))
            for x in markers:
                plain = pc.or_(plain, pc.match_substring(text, x))
            spm = pc.less(_modulo(part.column("h4"), pa.scalar(100)), suffix_first_percent)
            glued = lambda *x: pc.binary_join_element_wise(*x, "")
            output = pc.if_else(plain, text, pc.if_else(spm, glued(s, suffix, p, prefix, m, middle), glued(p, prefix, s, suffix, m, middle)))
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            yield pa.record_batch([part.column("doc_id"), n, form, *chars, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return id_and_text(docs).select("doc_id", "text", *draws).mapInArrow(run, OUTPUT)


def _read_back(output: pa.Array, order: tuple[str, str, str], places: tuple[int, int, int]) -> pa.Array:
    """The texts of outputs whose pieces follow the markers in this order; places: of prefix, middle and suffix."""
    rest, found = output, []
    for marker in order:
        halves = pc.split_pattern(rest, marker, max_splits=1)
        found.append(pc.list_element(halves, 0))
        rest = pc.list_element(halves, 1)
    found.append(rest)
    return pc.binary_join_element_wise(*(found[k + 1] for k in places), "")


def restored(outputs: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """The rows of infilled() with the text that each output was made of, rebuilt from output and form alone."""
    p, s, m = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "output"):
            form, output = part.column("form"), part.column("output")
            at = [np.flatnonzero(np.asarray(pc.equal(form, x))) for x in FORMS]
            plain, psm, spm = (output.take(pa.array(x)) for x in at)
            found = [plain, _read_back(psm, (p, s, m), (0, 2, 1)), _read_back(spm, (s, p, m), (1, 2, 0))]
            back = np.argsort(np.concatenate(at), kind="stable")
            text = pa.concat_arrays([x.cast(pa.string()) for x in found]).take(pa.array(back))
            yield pa.RecordBatch.from_arrays([*part.batch.columns, text], names=[*part.batch.schema.names, "text"])

    return outputs.mapInArrow(run, f"{OUTPUT}, text string")


def infilled_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of each output and of the text read back from it."""
    rows = restored(infilled(docs))
    digest = lambda name, x: F.sha2(F.col(x).cast("binary"), 256).alias(name)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output_sha256", "output"), digest("restored_sha256", "text"))
