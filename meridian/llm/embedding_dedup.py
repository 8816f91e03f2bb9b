"""Near-duplicate vectors by an exact range join in a metric space.

Vectors are linked at a cosine of 0.95 or more, that is, within an angle r on the unit sphere. Pivots part the sphere:
a vector's home is the cell of its nearest pivot. A vector y can have a link x in the cell of another pivot p
only if
- its angle to p is at most the cell's radius plus r (the triangle inequality by way of x), and
- its distance from the plane half-way between its own pivot and p is at most r's chord (x lies on p's side).
Only to such cells a copy of y travels, and of each pair of cells only one is visited by the other, so each pair of
vectors meets once. Large cells are dealt in blocks of a bounded number of vectors that visit each other like
cells. A task holds one block and streams its visitors past it in pieces; pairs become sums and a forest there
and are never written down. So memory is bounded, whatever the number of vectors in a cell, or of links.

Equal vectors are one class before that and are counted, not paired. Pivots come from a bounded sample of
classes (farthest first, at most MAX_PIVOTS); they decide where work is done and not what is found. Vectors that spread in
all directions of a high-dimensional space lie near most cells' borders, whatever the pivots: then half of all blocks are visited, and the
work is that of comparing all vectors. That is the price of an exact answer.

Cosines near the threshold are taken in double precision, and within 1e-12 of it from correctly rounded sums, so both
ends of a pair and all partitionings agree. Vectors that are null, zero or empty or hold null or non-finite components
have no links; vectors of different lengths have none with each other. A null vec_id is an id like any other, and
smaller ids go before it. Rows that repeat id and vector are one vector, and each of them gets its row; rows
that share an id only are vectors of their own. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import mix, written
from .near_dedup import components

COSINE = 0.95
#: Vectors of a block, and visitors that it is held against at a time.
BLOCK, PIECE = 8192, 256
#: Pivots: one for each block, a few for small tables, and never more than this; farthest first of so many times as many vectors.
MAX_PIVOTS, FEW_PIVOTS, CANDIDATES = 1024, 16, 4
#: Slack of the bounds, far over what rounding can do.
SLACK = 1e-6
CLASS = "vec_id long, vector binary"
PLACED = "block int, visits boolean, node long, members long, vector binary"
FOUND = "node long, links long, to long"


def _vectors(raw: pa.Array, kind: str) -> np.ndarray:
    """Stored vectors of one length as unit vectors in double precision."""
    out = np.frombuffer(b"".join(raw.to_pylist()), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    out /= np.abs(out).max(axis=1)[:, None]  # no square can overflow
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _stored(kind: str) -> Callable:
    """Rows (vec_id, embedding) with the vector as bytes, or null where it has no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat, n = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # no -0.0
            ends = np.cumsum(n)
            odd, some = np.zeros(len(values) + 1, np.int64), np.zeros(len(values) + 1, np.int64)
            np.cumsum(~np.isfinite(values), out=odd[1:])
            np.cumsum(values != 0, out=some[1:])
            good = (odd[ends] == odd[ends - n]) & (some[ends] > some[ends - n])
            raw = [values[e - k : e].tobytes() if g else None for e, k, g in zip(ends, n, good, strict=True)]
            yield pa.record_batch([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "vector"])

    return run


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sample's unit vectors, each as far from those before it as can be (fewer if they coincide)."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < n and near.min() < COSINE:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _at_home(pivots: np.ndarray, kind: str) -> Callable:
    """Adds the nearest pivot, and the angle to it; vectors of another length than the pivots have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = pivots.shape[1] * np.dtype(kind).itemsize
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            here = np.flatnonzero(np.asarray(pc.binary_length(batch.column("vector"))) == width)
            if len(here):
                cosine = _vectors(batch.column("vector").take(pa.array(here)), kind) @ pivots.T
                cell[here] = cosine.argmax(axis=1)
                angle[here] = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return run


class Layout:
    """Cells, their radii and their blocks; blocks of all cells are numbered through.

    Vectors of another length than the pivots have a cell for each length, which no other visits.
    """

    def __init__(self, pivots: np.ndarray, cells: list[tuple[int, int, int, float]]):
        """cells: (bytes of a vector, nearest pivot or -1, vectors, largest angle to the pivot)."""
        self.pivots, n = pivots, len(pivots)
        self.radius = np.full(n, -np.inf)
        first, self.home, blocks = 0, {}, np.zeros(n, np.int64)
        self.first = np.zeros(n, np.int64)
        for width, cell, rows, angle in sorted(cells):
            several = -(-rows // BLOCK)
            self.home[width if cell < 0 else -1, cell] = (first, several)
            if cell >= 0:
                self.radius[cell], self.first[cell], blocks[cell] = angle, first, several
            first += several
        self.blocks = blocks
        gap = pivots @ pivots.T
        self.apart = np.sqrt(np.maximum(2 - 2 * gap, 1e-30))

    def visited(self, unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        """For each vector, which pivots' cells may hold vectors linked with it."""
        cosine = unit @ self.pivots.T
        own = cosine[np.arange(len(unit)), home]
        chord, reach = math.sqrt(2 - 2 * COSINE) + SLACK, math.acos(COSINE) + SLACK
        plane = own[:, None] - cosine <= chord * self.apart[home] + SLACK
        return plane & (np.arccos(np.clip(cosine, -1, 1)) <= self.radius[None, :] + reach)


def _one_way(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of each two blocks one visits the other, about half of them each way."""
    return (here < there) == ((here + there) % 2 == 0)


def _placed(layout: Layout, kind: str) -> Callable:
    """Each vector in its own block, and in those that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                cell, node = np.asarray(batch.column("cell")), np.asarray(batch.column("node"))
                width = np.asarray(pc.binary_length(batch.column("vector")))
                homes = [layout.home[-1 if c >= 0 else w, c] for w, c in zip(width.tolist(), cell.tolist(), strict=True)]
                first, several = (np.array(x, dtype=np.int64) for x in zip(*homes, strict=True))
                block = first + (mix(node.astype(np.uint64)) % several.astype(np.uint64)).astype(np.int64)
                rows, blocks = [np.arange(len(cell))], [block]
                at = np.flatnonzero(cell >= 0)
                if len(at):
                    to = layout.visited(_vectors(batch.column("vector").take(pa.array(at)), kind), cell[at])
                    to[np.arange(len(at)), cell[at]] = False
                    row, pivot = np.nonzero(to)
                    n = layout.blocks[pivot]
                    rows.append(np.repeat(at[row], n))
                    blocks.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - layout.first[pivot], n))
                # The other blocks of a vector's own cell.
                rows.append(np.repeat(np.arange(len(cell)), several))
                blocks.append(np.arange(several.sum()) - np.repeat(np.cumsum(several) - several - first, several))
                row, there = np.concatenate(rows), np.concatenate(blocks)
                visits = np.arange(len(row)) >= len(cell)
                keep = ~visits | ((there != block[row]) & _one_way(block[row], there))
                row, there, visits = row[keep], there[keep], visits[keep]
                for s in range(0, len(row), BLOCK):
                    some = pa.array(row[s : s + BLOCK])
                    taken = [batch.column(x).take(some) for x in ("node", "members", "vector")]
                    yield pa.record_batch([pa.array(there[s : s + BLOCK].astype(np.int32)), pa.array(visits[s : s + BLOCK]), *taken], names=["block", "visits", "node", "members", "vector"])

    return run


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i], for all i; a label is the smallest place of its group."""
    while True:
        one, two = label[a], label[b]
        if (one == two).all():
            return
        low = np.minimum(one, two)
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while (label[label] != label).any():
            label[:] = label[label]


class Block:
    """The vectors of a block, their links so far, and a forest of them."""

    def __init__(self, rows: list[pa.RecordBatch], kind: str):
        table = pa.Table.from_batches(rows)
        self.node, self.members = (np.asarray(table[x]) for x in ("node", "members"))
        self.unit = _vectors(table["vector"].combine_chunks(), kind)
        self.single = self.unit.astype(np.float32)
        self.links, self.label = np.zeros(len(self.node), np.int64), np.arange(len(self.node))

    def linked(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (own, other) of a cosine of COSINE and more."""
        rough = self.single @ unit.T.astype(np.float32)
        doubt = max(1e-5, unit.shape[1] * 2.5e-7)
        own, other = np.nonzero(rough >= COSINE - doubt)
        unsure = np.flatnonzero(rough[own, other] < COSINE + doubt)
        keep = np.ones(len(own), bool)
        for k in range(0, len(unsure), 65536):
            some = unsure[k : k + 65536]
            cosine = np.einsum("ij,ij->i", self.unit[own[some]], unit[other[some]])
            for i in np.flatnonzero(np.abs(cosine - COSINE) < 1e-12):
                cosine[i] = _exact_cosine(self.unit[own[some[i]]], unit[other[some[i]]])
            keep[some] = cosine >= COSINE
        return own[keep], other[keep]

    def meet(self, unit: np.ndarray, members: np.ndarray, itself: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts links with others (or with its own vectors from itself on): the others' links, and one of mine (-1: none)."""
        own, other = self.linked(unit)
        size, first = len(self.node), len(self.node) if itself is None else itself
        if itself is not None:
            apart = own != first + other
            own, other = own[apart], other[apart]
        np.add.at(self.links, own, members[other])
        theirs = np.zeros(len(unit), np.int64)
        np.add.at(theirs, other, self.members[own])
        label = np.concatenate([self.label, np.arange(size, size + len(unit))])
        united(label, own, first + other)
        self.label = label[:size]
        to = label[first : first + len(unit)]
        return theirs, np.where(to < size, to, -1)

    def meet_itself(self) -> None:
        for k in range(0, len(self.node), PIECE):
            self.meet(self.unit[k : k + PIECE], self.members[k : k + PIECE], k)

    def visit(self, batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
        """The links of visitors, where they have any, each with one of the block's vectors that it reaches."""
        theirs, to = self.meet(_vectors(batch.column("vector"), kind), np.asarray(batch.column("members")))
        some = np.flatnonzero(to >= 0)
        return _found(np.asarray(batch.column("node"))[some], theirs[some], self.node[to[some]])

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        return _found(self.node[some], self.links[some], self.node[self.label[some]])


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["node", "links", "to"])


def _linked(kind: str) -> Callable:
    """Rows sorted by block, its own vectors first, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            blocks, visits = np.asarray(batch.column("block")), batch.column("visits").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (visits[1:] != visits[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != number:
                    if block or held:
                        block = block or _whole(held, kind)
                        yield block.rows()
                    number, held, block = blocks[a], [], None
                rows = batch.slice(a, b - a).select(["node", "members", "vector"])
                if not visits[a]:
                    held.append(rows)
                    continue
                block = block or _whole(held, kind)
                for k in range(0, rows.num_rows, PIECE):
                    yield block.visit(rows.slice(k, PIECE), kind)
        if block or held:
            yield (block or _whole(held, kind)).rows()

    return run


def _whole(held: list[pa.RecordBatch], kind: str) -> Block:
    block = Block(held, kind)
    block.meet_itself()
    return block


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept of every row of vectors (vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, FloatType) else "<f8"
    embedding = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding")).mapInArrow(_stored(kind), CLASS)
    rows = written(rows)
    classes = rows.where("vector is not null").groupBy("vector", "vec_id").agg(F.lit(1).alias("one")).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("members"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    found = _links(classes, kind)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node != to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = classes.join(links, "node", "left").join(labels, "node", "left").select("vector", "first", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    known = written(known)
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "label").select("vector", (F.col("members") - 1 + F.col("links")).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    out = rows.join(known, "vector", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(classes: DataFrame, kind: str) -> DataFrame:
    """node, links and to: for each class, sums of its links, and links that hold components together."""
    widths = classes.groupBy(F.octet_length("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    n = widths["count"] if widths else 0
    wanted = min(MAX_PIVOTS, max(-(-n // BLOCK), min(FEW_PIVOTS, n)))
    sample = classes.where(F.octet_length("vector") == (widths["width"] if widths else 0)).orderBy(F.xxhash64("vector"), "node").limit(CANDIDATES * wanted).select("vector").collect()
    pivots = farthest_first(_vectors(pa.array([bytes(r[0]) for r in sample]), kind), wanted) if sample else np.zeros((0, 1))
    homes = written(classes.select("node", "members", "vector").mapInArrow(_at_home(pivots, kind), "node long, members long, vector binary, cell int, angle double"))
    cells = homes.groupBy(F.octet_length("vector").alias("width"), "cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()
    layout = Layout(pivots, [tuple(r) for r in cells])
    placed = homes.select("node", "members", "vector", "cell").mapInArrow(_placed(layout, kind), PLACED)
    return written(placed.repartition("block").sortWithinPartitions("block", "visits").mapInArrow(_linked(kind), FOUND))


def drop_near_vectors(vectors: DataFrame) -> DataFrame:
    """The vec_ids that stay, one of each component."""
    return near_vectors(vectors).where("kept").select("vec_id")
