"""Token counts without ids: distinct pre-tokens counted once, joined to frequencies, summed.

The model's pieces hold the blank sign only at their beginning, so merges never cross from a
character into a following blank. A pre-token is a run of blanks with the stretch after it;
a text's count is the sum over its pre-tokens. The sign itself (U+2581) is a blank to the model.

A slice of documents gives one row: its distinct pre-tokens, dealt by hash into lots, and each
document's frequencies of them. Lots are sorted and packed: as rows of their own, pre-tokens and
their keys took more disk than the texts. Equal lots of all slices are brought together (a
frequent word is in as many as there are slices), where the model counts each distinct pre-token
once. Counts go back to the slices, are joined to the documents' frequencies and summed.

A null text is empty; an empty text has no tokens. Rows are counted each, also if they repeat a
doc_id; a text of any length is counted whole. Other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, written
from .pieces import joined, once

LIMIT = 4096
#: Bytes of text whose pre-tokens are put together. Larger slices have fewer distinct ones for a word of text.
SLICE = 24_000_000
REPORT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Lots that distinct pre-tokens are dealt to.
LOTS = 1024
#: Pre-tokens of a lot that a worker remembers; its table starts anew beyond that.
LOT = 400_000
FREQUENCIES = "slice int, doc_id array<long>, n_bytes array<long>, pieces array<struct<lot: int, packed: binary>>, entries array<int>, counts binary"
NAMES = ["slice", "doc_id", "n_bytes", "pieces", "entries", "counts"]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first blank: what the model adds itself."""
    if not text:
        return []
    pieces = text.replace("▁", " ").split(" ")
    if "" not in pieces:
        return pieces
    out, blanks = [], 0
    for x in pieces[:-1]:
        if x:
            out.append(" " * blanks + x)
            blanks = 0
        else:
            blanks += 1
    out.append(" " * blanks + pieces[-1])
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**31, mostly small, in few bytes: all lowest bytes come first."""
    return zlib.compress(np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def packed_pieces(pieces: list[str]) -> bytes:
    coded = [x.encode() for x in pieces]
    sizes = packed(np.fromiter(map(len, coded), np.int32, len(coded)))
    return len(sizes).to_bytes(4, "little") + sizes + zlib.compress(b"".join(coded), 1)


def unpacked_pieces(raw: bytes) -> list[str]:
    edge = 4 + int.from_bytes(raw[:4], "little")
    ends = np.cumsum(unpacked(raw[4:edge]), dtype=np.int64).tolist()
    data = zlib.decompress(raw[edge:])
    return [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


class Frequencies:
    """Distinct pre-tokens of some documents, and how often each document has them."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.columns: dict[str, list] = {x: [] for x in ("doc_id", "n_bytes", "entries", "steps", "count")}
        self.bytes = 0

    def add(self, part) -> None:
        flat, edge = joined([pre_tokens(x) for x in part.column("text").fill_null("").to_pylist()])
        add, number = self.number.setdefault, self.number
        which = np.fromiter((add(x, len(number)) for x in flat), dtype=np.int64, count=len(flat))
        own = np.repeat(np.arange(len(part)), np.diff(edge))
        key, count = np.unique(own << 32 | which, return_counts=True)
        own, which = key >> 32, key & 0xFFFFFFFF
        # A document's numbers ascend; their steps are small.
        steps = np.diff(which, prepend=0)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        steps[first] = which[first]
        entries = np.bincount(own, minlength=len(part))
        for name, x in zip(self.columns, (part.column("doc_id"), np.diff(part.off), entries, steps, count), strict=True):
            self.columns[name].append(x)
        self.bytes += len(part.data)

    def lots(self) -> tuple[pa.Array, np.ndarray]:
        """The lots of pieces, and for each place in them, lot by lot, the piece's number."""
        pieces = sorted(self.number)
        lot = np.fromiter((zlib.crc32(x.encode()) % LOTS for x in pieces), np.int32, len(pieces))
        order = np.argsort(lot, kind="stable")
        found, first = np.unique(lot[order], return_index=True)
        groups = [packed_pieces([pieces[i] for i in x]) for x in np.split(order, first[1:])] if len(found) else []
        rows = pa.StructArray.from_arrays([pa.array(found, pa.int32()), pa.array(groups, pa.binary())], names=["lot", "packed"])
        return rows, np.fromiter((self.number[pieces[i]] for i in order), np.int64, len(order))

    def row(self, number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.columns["doc_id"])
        n_bytes, entries, steps, count = (np.concatenate(self.columns[x]) for x in ("n_bytes", "entries", "steps", "count"))
        pieces, numbers = self.lots()
        raw = [packed(x) for x in (steps, count, numbers)]
        raw = b"".join(len(x).to_bytes(8, "little") + x for x in raw)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        lists = [whole(x) for x in (ids, pa.array(n_bytes), pieces, pa.array(entries.astype(np.int32)))]
        return pa.record_batch([pa.array([number], pa.int32()), *lists, pa.array([raw], pa.binary())], names=NAMES)


def totals(entries: np.ndarray, raw: bytes, sizes: np.ndarray) -> np.ndarray:
    """Each document's sum, from its frequencies and the sizes of the pieces, lot by lot."""
    parts, at = [], 0
    for _ in range(3):
        end = at + 8 + int.from_bytes(raw[at : at + 8], "little")
        parts.append(unpacked(raw[at + 8 : end]).astype(np.int64))
        at = end
    steps, count, numbers = parts
    size_of = np.zeros(len(numbers), np.int64)
    size_of[numbers] = sizes
    own = np.repeat(np.arange(len(entries)), entries)
    sums = np.cumsum(steps)
    first = (np.cumsum(entries) - entries)[entries > 0]
    before = np.zeros(len(entries), np.int64)
    before[entries > 0] = sums[first] - steps[first]
    n = np.zeros(len(entries), np.int64)
    np.add.at(n, own, size_of[sums - before[own]] * count)
    return n


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = Frequencies(), 0
        for part in slices(batches):
            rows.add(part)
            if rows.bytes >= size:
                yield rows.row(n)
                rows, n = Frequencies(), n + 1
        if rows.columns["doc_id"]:
            yield rows.row(n)

    return run


class Counter:
    """The number of pieces that the model makes of pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.stem = self._sizes(["a"])[0]

    def _sizes(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def of(self, pieces: list[str]) -> list[int]:
        # The model puts one blank before what it is given; a run of blanks alone needs a stem before it.
        bare = [i for i, x in enumerate(pieces) if not x.strip(" ")]
        asked = list(pieces)
        for i in bare:
            asked[i] = "a " + pieces[i]
        found = self._sizes(asked)
        for i in bare:
            found[i] -= self.stem
        return found


def counted(pieces: DataFrame, model: str) -> DataFrame:
    """slice, lot, sizes of the rows slice, lot, packed: equal lots come to one task in a row, where equal pieces are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("count", model), lambda: Counter(model))
        last, known = None, {}
        for batch in batches:
            lots, out = batch.column("lot").to_pylist(), []
            for lot, raw in zip(lots, batch.column("packed"), strict=True):
                if lot != last or len(known) > LOT:
                    last, known = lot, {}
                some = unpacked_pieces(raw.as_py())
                fresh = [x for x in some if x not in known]
                known.update(zip(fresh, counter.of(fresh), strict=True))
                out.append(packed(np.fromiter((known[x] for x in some), np.int32, len(some))))
            yield pa.record_batch([batch.column("slice"), batch.column("lot"), pa.array(out, pa.binary())], names=["slice", "lot", "sizes"])

    return pieces.repartition("lot").sortWithinPartitions("lot").mapInArrow(run, "slice long, lot int, sizes binary")


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, size: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    parts = id_and_text(docs).mapInArrow(_frequencies(size), FREQUENCIES)
    # A slice's number is its place in the table that is written.
    parts = written(parts.drop("slice").withColumn("slice", F.monotonically_increasing_id()))
    pieces = parts.select("slice", F.explode("pieces").alias("x")).select("slice", "x.lot", "x.packed")
    counts = counted(pieces, model)
    back = counts.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("lot", "sizes"))).alias("found"))
    rows = parts.drop("pieces").join(back, "slice", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids, n_bytes, entries, found = (one.column(batch.schema.get_field_index(x)).flatten() for x in ("doc_id", "n_bytes", "entries", "found"))
                sizes = [unpacked(x["sizes"]) for x in found.to_pylist()]
                raw = one.column(batch.schema.get_field_index("counts"))[0].as_py()
                n = pa.array(totals(np.asarray(entries), raw, np.concatenate([np.zeros(0, np.int32), *sizes])))
                yield pa.record_batch([ids, n_bytes, n, pc.greater(n, limit)], names=[x.split()[0] for x in REPORT.split(", ")])

    return rows.mapInArrow(run, REPORT)
