"""Exact search for repeated strings of a fixed length, by shared anchors.

Every string of the given length ("window") has an anchor in it that its own content
picks, so equal windows have equal anchors at equal offsets. A row of the parse is a run
of consecutive windows with one anchor:

    anchor   name of what all windows of the run have in common
    span     name of the whole stretch that they cover, with the offset of the anchor
    doc_id, twin   document (twin tells rows apart that share an id, see with_twins)
    code     first window << 24 | offset of the anchor << 16 | number of windows << 2 | state

Rows go to the anchors' partitions once. A span that is met again settles all its windows
at once, which is how long repeats are settled. Only where an anchor comes with different
spans (at the edges of a repeat) are its windows looked at more closely: in blocks of a few
windows, by the same step (the anchor is then what the block's windows share, the span what
they cover), and at last one by one.

Before a shuffle, rows that repeat within a slice are settled on the spot and sent to a
partition of their own choice, so a group of copies has one row a slice at most in its
anchor's partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mix, same_document, signed, slices, spread, with_twins

_U = np.uint64
PLAIN, SETTLED, ASIDE = 0, 1, 2
PARSE = "anchor long, span long, doc_id long, twin long, code long"
KEY = ["doc_id", "twin"]
#: names(slice, document, start, end) -> two fingerprints of each stretch of units.
Names = Callable[[object, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def encoded(start: np.ndarray, offset: np.ndarray, count: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (start << 24) | (offset << 16) | (count << 2) | state


def decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return code >> 24, (code >> 16) & 0xFF, (code >> 2) & 0x3FFF, code & 3


def presettle(names: list[np.ndarray], doc: np.ndarray, at: np.ndarray, first_only: bool) -> np.ndarray:
    """States of rows of one slice: the first of each name stands for the others.

    first_only: only rows after the first are repeats, else all of them are. Rows of a
    document that comes twice are at the same place and no repeats of each other.
    """
    order = np.lexsort((at, doc, *names[::-1]))
    new = np.ones(len(order), dtype=bool)
    place = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        new[1:] = np.logical_or.reduce([x[a] != x[b] for x in names])
        place[1:] = new[1:] | (doc[a] != doc[b]) | (at[a] != at[b])
    group = np.cumsum(new) - 1
    places = np.bincount(group, weights=place)[group] if len(order) else group
    nth_place = np.cumsum(place)
    later = nth_place > nth_place[np.flatnonzero(new)][group] if len(order) else new
    state = np.where(later, ASIDE, PLAIN)
    if not first_only:
        state[new & (places > 1)] = SETTLED
        state[~later & ~new & (places > 1)] = ASIDE
    out = np.empty(len(order), dtype=np.int64)
    out[order] = state
    return out


def document_order(part) -> np.ndarray:
    """The rank of each row of a slice by (doc_id, twin), null first; equal for equal keys."""
    ids, twin = part.column("doc_id"), np.asarray(part.column("twin"))
    known, key = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
    order = np.lexsort((twin, key, known))
    new = np.zeros(len(order), dtype=np.int64)
    a, b = order[1:], order[:-1]
    new[1:] = (known[a] != known[b]) | (key[a] != key[b]) | (twin[a] != twin[b])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def document_salt(part) -> np.ndarray:
    """A number of each row's key, the same in every slice."""
    ids = part.column("doc_id")
    key = np.asarray(ids.fill_null(0)).astype(np.uint64) ^ mix(np.asarray(ids.is_valid()).astype(np.uint64))
    return mix(mix(key) ^ np.asarray(part.column("twin")).astype(np.uint64))


def parse_rows(part, own: np.ndarray, anchor: np.ndarray, span: np.ndarray, run: tuple, first_only: bool, done: np.ndarray | None = None) -> pa.RecordBatch:
    """PARSE rows of a slice; run: start, offset and count of each, done: known to repeat."""
    start, offset, count = run
    ids, twin = (part.column(x).take(pa.array(own)) for x in KEY)
    state = presettle([anchor, span], document_order(part)[own], start, first_only)
    if done is not None:
        state = np.where((state == PLAIN) & done, SETTLED, state)
    code = encoded(start, offset, count, state)
    anchor = np.where(state == ASIDE, mix(mix(code.astype(np.uint64)) ^ document_salt(part)[own]), anchor)
    return pa.record_batch([pa.array(signed(anchor)), pa.array(signed(span)), ids, twin, pa.array(code)], names=["anchor", "span", *KEY, "code"])


def _settled(rows: DataFrame, first_only: bool) -> DataFrame:
    """KEY, settled, open: codes of runs that repeat, and of runs to look at more closely."""
    rows = rows.repartition("anchor").withColumn("start", F.shiftright("code", 24))
    state, here = F.col("code").bitwiseAND(3), F.struct(*KEY, "start")
    same_span = Window.partitionBy("anchor", "span")
    in_order = same_span.orderBy(F.col("doc_id").asc_nulls_first(), "twin", "start")
    same_anchor = Window.partitionBy("anchor")
    rows = rows.withColumn("rank", F.rank().over(in_order)).withColumn("n", F.row_number().over(in_order))
    if first_only:
        repeat = (state > 0) | (F.col("rank") > 1)
    else:
        rows = rows.withColumn("others", F.min(here).over(same_span) != F.max(here).over(same_span))
        repeat = (state > 0) | F.col("others")
    mixed = F.min("span").over(same_anchor) != F.max("span").over(same_anchor)
    rows = rows.withColumn("mixed", mixed).withColumn("repeat", repeat)
    rows = rows.withColumn("open", F.col("mixed") & (F.col("n") == 1) & (state < ASIDE)).where("repeat or open")
    return rows.groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("repeat"), F.col("code"))).alias("settled"),
        F.collect_list(F.when(F.col("open"), F.col("code"))).alias("open"),
    )


def _runs(part) -> tuple[np.ndarray, ...]:
    """Document, start, offset, count and state of the open runs of a slice."""
    codes = part.column("open")
    owner = np.repeat(np.arange(len(part)), np.asarray(codes.value_lengths()).astype(np.int64))
    return owner, *decoded(np.asarray(codes.flatten()).astype(np.int64))


def _blocks(names: Names, sizes: Callable, length: int, block: int, first_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owner, start, offset, count, state = _runs(part)
            # Block j: windows that begin block * j to block * (j + 1) - 1 before the anchor.
            low, high = (offset - count + 1) // block, offset // block
            n = high - low + 1
            j = spread(low, n)
            owner, start, offset, count, state = (np.repeat(x, n) for x in (owner, start, offset, count, state))
            anchor = start + offset
            early = anchor - block * (j + 1) + 1  # the block's first window, also if outside the run
            first, last = np.maximum(early, start), np.minimum(early + block - 1, start + count - 1)
            common, _ = names(part, owner, early + block - 1, early + length)
            fits = (early >= 0) & (early + block - 1 + length <= sizes(part)[owner])
            begin, end = np.where(fits, early, 0), np.where(fits, early + block - 1 + length, 0)
            _, hull = names(part, owner, begin, end)
            of_run = encoded(np.zeros_like(j), anchor - first, last - first + 1, np.zeros_like(j)).astype(np.uint64)
            # A block that does not fit has a name of its own, so it stays open: its bytes are not compared here.
            place = mix(mix(mix(first.astype(np.uint64)) ^ document_salt(part)[owner]))
            span = mix(np.where(fits, hull, place) ^ mix(of_run))
            core = mix(common + j.astype(np.uint64))
            yield parse_rows(part, owner, core, span, (first, anchor - first, last - first + 1), first_only, state > 0)

    return run


def _singles(names: Names, length: int, first_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owner, start, offset, count, state = _runs(part)
            at, doc, done = spread(start, count), np.repeat(owner, count), np.repeat(state, count) > 0
            one, two = names(part, doc, at, at + length)
            yield parse_rows(part, doc, one, two, (at, np.zeros_like(at), np.ones_like(at)), first_only, done)

    return run


#: Windows whose contents are in memory at once.
CHUNK = 1 << 16


def _suffixes(names: Names, contents: Callable, length: int, first_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owner, start, _, count, state = _runs(part)
            at, doc, done = spread(start, count), np.repeat(owner, count), np.repeat(state, count) > 0
            for k in range(0, len(at), CHUNK):
                some = slice(k, k + CHUNK)
                own, begin = doc[some], at[some]
                rows = parse_rows(part, own, *names(part, own, begin, begin + length), (begin, np.zeros_like(begin), np.ones_like(begin)), first_only, done[some])
                # What is settled here has a short content of its own, and so meets nothing.
                aside = np.asarray(rows.column("code")) & 3 == ASIDE
                own_content = pa.array([x.tobytes() for x in np.asarray(rows.column("anchor"))[aside]], pa.binary())
                whole = pa.array(contents(part, own[~aside], begin[~aside]), pa.binary())
                which = np.where(aside, np.cumsum(aside) - 1, len(own_content) + np.cumsum(~aside) - 1)
                suffix = pa.concat_arrays([own_content, whole]).take(pa.array(which))
                yield pa.record_batch([suffix, *[rows.column(x) for x in (*KEY, "code")]], names=["suffix", *KEY, "code"])

    return run


def repeated_windows(docs: DataFrame, parse: Callable, names: Names, sizes: Callable, length: int, first_only: bool, block: int = 1, contents: Callable | None = None) -> DataFrame:
    """doc_id, twin and text of every row with the lists settled, settled_2 and single of its repeated windows.

    settled*: codes of runs of windows, single: windows' starts; null if there are none.
    parse makes PARSE rows of (doc_id, twin, text) batches; sizes(slice) counts the units of each
    document. With first_only, a window counts if it also starts earlier (smaller doc_id, null
    first, then twin, or same document and earlier start), else if it starts anywhere else. Rows of
    one key (equal id and text) are one document. block: windows of a block, 1 for none.
    contents(slice, document, start): the bytes of windows; with it, what blocks leave open is sorted
    by these bytes over the whole table, else it is told apart by names.
    """
    docs = with_twins(docs).drop("hash")
    by_doc = checkpointed(_settled(docs.mapInArrow(parse, PARSE), first_only))
    out = same_document(docs, by_doc.select(*KEY, "settled"))
    todo = by_doc.where(F.size("open") > 0).select(*KEY, "open")
    closer_look = lambda todo: same_document(docs, todo, "inner").select(*KEY, "text", "open")
    if block > 1:
        closer = _settled(closer_look(todo).mapInArrow(_blocks(names, sizes, length, block, first_only), PARSE), first_only)
        out = same_document(out, closer.select(*KEY, F.col("settled").alias("settled_2")))
        todo = closer.where(F.size("open") > 0).select(*KEY, "open")
    else:
        out = out.withColumn("settled_2", F.lit(None).cast("array<long>"))
    if contents:
        rows = closer_look(todo).mapInArrow(_suffixes(names, contents, length, first_only), "suffix binary, doc_id long, twin long, code long")
        rows, key = rows.repartitionByRange("suffix"), Window.partitionBy("suffix")
    else:
        rows, key = closer_look(todo).mapInArrow(_singles(names, length, first_only), PARSE), Window.partitionBy("anchor", "span")
    rows = rows.withColumn("start", F.shiftright("code", 24))
    if first_only:
        again = F.rank().over(key.orderBy(F.col("doc_id").asc_nulls_first(), "twin", "start")) > 1
    else:
        here = F.struct(*KEY, "start")
        again = F.min(here).over(key) != F.max(here).over(key)
    rows = rows.withColumn("again", (F.col("code").bitwiseAND(3) > 0) | again).where("again")
    return same_document(out, rows.groupBy(*KEY).agg(F.collect_list("start").alias("single")))


def covered(part, n_units: np.ndarray, length: int) -> np.ndarray:
    """Which units (all documents in a row, n_units each) some repeated window covers."""
    base = np.concatenate([[0], np.cumsum(n_units)]).astype(np.int64)
    delta = np.zeros(int(base[-1]) + 1, dtype=np.int64)
    for name in ("settled", "settled_2", "single"):
        lists = part.column(name)
        lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        flat = np.asarray(lists.flatten()).astype(np.int64)
        owner = base[np.repeat(np.arange(len(part)), lengths)]
        if name == "single":
            start, count = flat, np.ones_like(flat)
        else:
            start, _, count, _ = decoded(flat)
        np.add.at(delta, owner + start, 1)
        np.add.at(delta, owner + start + count - 1 + length, -1)
    return np.cumsum(delta)[:-1] > 0
