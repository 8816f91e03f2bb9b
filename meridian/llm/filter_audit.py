"""What five filters remove, alone, together and in every order, with exact copies found by radix tries.

Failure conditions of a text (null: empty; words: maximal [^\\x20\\x09-\\x0D]+): A under 200 words, B fewer distinct
words than half, C over two capitals [A-Z] in a hundred code points, D any of #$%&*|, E the text of a smaller
doc_id, table-wide.

E is decided by compressed tries over whole texts. Prefixes of a bounded sample, long enough to tell the sample's
texts apart, cut the table into ranges; a range that no prefix splits is dealt by a checksum of whole texts. Before
the shuffle each task merges its copies in tries of a bounded size, so what moves is a text for each trie, not
for each copy, with the ids of its rows. A terminal holds the smallest doc_id; any other row that reaches it is a
copy and leaves at once, as a few bytes (doc_id, part, failure mask), so a group of copies of any size costs one node. What is left
in the terminals when a trie is complete are the first documents. A text that is frequent in the sample goes to several
tries before that, whose first documents then meet in one. Masks are joined with labels by doc_id and
counted by part; all 120 orders are sums over these counts (32 masks a part). The sample decides where work is
done; results don't depend on it.

Rows without doc_id equal nothing and have no labels, and rows of one doc_id are not copies of each other (nor are they
merged: a repeated row counts twice). A doc_id with several rows in labels is good, or toxic, if any of them says so.
A null source is the part "". An empty table gives no rows. Columns of other names are not looked at.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
#: Rows (as many in expectation) and bytes of each that the ranges are made from.
SAMPLE, SAMPLE_BYTES = 2000, 4096
#: So many copies in the sample may be chance.
FREQUENT = 3
#: Bytes of distinct texts in a task's trie before it is sent on, and bytes of text that a range should hold.
TRIE_BYTES, RANGE_BYTES = 16 << 20, 16 << 20
#: Rows of such a trie.
TRIE_ROWS = 200_000
#: The bit of condition E.
COPY = 16

_SYMBOLS, _CAPITALS = b"#$%&*|", bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # all bytes of a code point but the first

def failing(text: bytes) -> int:
    """Bits of the conditions A to D that a text meets."""
    words = text.split()
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    has_symbol = len(text.translate(None, _SYMBOLS)) < len(text)
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * capitals > 2 * points) + 8 * has_symbol


class Copies:
    """A terminal: the smallest doc_id of a text and the parts of its rows; the conditions that the text meets."""

    __slots__ = ("low", "parts", "mask")

    def __init__(self, mask: int = 0):
        self.low: int | None = None
        self.parts: list[str] = []
        self.mask = mask

    def add(self, doc_id: int, part: str) -> tuple[int, list[str]] | None:
        """Takes a row in; the rows that are now known to have a smaller one before them."""
        if doc_id == self.low:
            self.parts.append(part)
            return None
        if self.low is not None and doc_id > self.low:
            return doc_id, [part]
        gone = None if self.low is None else (self.low, self.parts)
        self.low, self.parts = doc_id, [part]
        return gone


class Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes):
        self.label, self.children, self.value = label, {}, None


def shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of label are those of text from at on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie: each edge has as many bytes as its texts share, each text ends at a node."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def terminal(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = child = Node(text[at:])
                self.size += len(child.label)
                return child
            if not text.startswith(child.label, at):
                k = shared(child.label, text, at)
                fork = Node(child.label[:k])
                child.label = child.label[k:]
                fork.children[child.label[0]] = child
                node.children[text[at]] = child = fork
            node, at = child, at + len(child.label)
        return node

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """Texts and their nodes, in the order of bytes."""
        todo = [(b"", self.root)]
        while todo:
            prefix, node = todo.pop()
            text = prefix + node.label
            if node.value is not None:
                yield text, node
            todo.extend((text, node.children[x]) for x in sorted(node.children, reverse=True))


class Ranges:
    """Where texts go: ranges between prefixes, and how many parts each is dealt to.

    split: parts by a checksum of the text, for ranges that are large whatever their prefixes; spread: parts by the
    task that sends, for texts that are frequent themselves.
    """

    def __init__(self, sample: list[tuple[bytes, int]], parts: int):
        trie, target = Trie(), max(1, len(sample) // parts)
        for text, _ in sample:
            node = trie.terminal(text)
            node.value = (node.value or 0) + 1
        starts, held, last = {b""}, 0, b""
        for text, node in trie.walk():
            alone = node.value > max(target, FREQUENT)
            if alone or held and held + node.value > target:
                # The shortest prefix that parts it from the text before; a frequent text has a range of its own.
                starts.add(text if alone else text[: shared(last, text, 0) + 1])
                held = 0
            held += node.value
            if alone and len(text) < SAMPLE_BYTES:
                starts.add(text + b"\0")
                held = 0
            last = text
        self.starts = sorted(starts)
        rows, most = Counter(), Counter()
        for (k, _), n in Counter((self.range_of(text), name) for text, name in sample).items():
            rows[k] += n
            most[k] = max(most[k], n if n > FREQUENT else 0)
        needed = lambda n: max(1, math.ceil(n * parts / max(len(sample), 1) - 1e-9))
        self.split = [needed(rows[k] - most[k]) for k in range(len(self.starts))]
        self.spread = [needed(most[k]) for k in range(len(self.starts))]

    def range_of(self, text: bytes) -> int:
        return bisect_right(self.starts, text) - 1


PLACED = "range int, split int, spread int, text binary, ids array<long>, parts array<string>"
MASKED = "doc_id long, part string, mask int, n long"
EITHER = [x.split()[0] for x in f"{PLACED}, {MASKED}".split(", ")]
_PLACED = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
_MASKED = [pa.int64(), pa.string(), pa.int32(), pa.int64()]


def _batch(rows: list[tuple], types: list[pa.DataType], before: list[pa.DataType] = [], after: list[pa.DataType] = []) -> list[pa.Array]:  # noqa: B006
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    blank = lambda kinds: [pa.nulls(len(rows), x) for x in kinds]
    return [*blank(before), *(pa.array(x, t) for x, t in zip(columns, types, strict=True)), *blank(after)]


def _entry(ranges: Ranges, text: bytes, ids: list, parts: list[str], task: int | None) -> tuple:
    k = ranges.range_of(text)
    return k, zlib.crc32(text) % ranges.split[k], 0 if task is None else task % ranges.spread[k], text, ids, parts


def _condensed(ranges: Ranges) -> Callable:
    """Rows (doc_id, text, part) to one entry for each text of a trie, with the ids and parts of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def entries(trie: Trie) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for text, node in trie.walk():
                rows.append(_entry(ranges, text, *node.value, task))
                size += len(text)
                if size > TRIE_BYTES // 4:
                    yield pa.record_batch(_batch(rows, _PLACED), names=EITHER[: len(_PLACED)])
                    rows, size = [], 0
            yield pa.record_batch(_batch(rows, _PLACED), names=EITHER[: len(_PLACED)])

        trie, seen = Trie(), 0
        for batch in batches:
            for doc_id, text, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                node = trie.terminal(text)
                if node.value is None:
                    node.value = ([], [])
                node.value[0].append(doc_id)
                node.value[1].append(part)
            seen += batch.num_rows
            if trie.size > TRIE_BYTES or seen > TRIE_ROWS:
                yield from entries(trie)
                trie, seen = Trie(), 0
        yield from entries(trie)

    return run


def _judged(ranges: Ranges, last: bool) -> Callable:
    """Entries sorted by place to masked rows; first documents of tries that don't hold all copies go on as entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, trie = None, Trie()
        out: list[tuple] = []
        nameless: Counter = Counter()

        def masked() -> pa.RecordBatch:
            rows = out + [(None, part, mask, n) for (part, mask), n in nameless.items()]
            out.clear()
            nameless.clear()
            return pa.record_batch(_batch(rows, _MASKED, before=_PLACED), names=EITHER)

        def finished() -> Iterator[pa.RecordBatch]:
            """What is left in the terminals."""
            entries, size = [], 0
            for text, node in trie.walk():
                copies = node.value
                if copies.low is None:
                    continue
                if not last and ranges.spread[place[0]] > 1:
                    entries.append(_entry(ranges, text, [copies.low] * len(copies.parts), copies.parts, None))
                    size += len(text)
                    if size > TRIE_BYTES // 4:
                        yield pa.record_batch(_batch(entries, _PLACED, after=_MASKED), names=EITHER)
                        entries, size = [], 0
                else:
                    out.extend((copies.low, part, copies.mask, 1) for part in copies.parts)
                    if len(out) > 20_000:
                        yield masked()
            if entries:
                yield pa.record_batch(_batch(entries, _PLACED, after=_MASKED), names=EITHER)

        for batch in batches:
            for *there, text, ids, parts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if there != place:
                    if place is not None:
                        yield from finished()
                    place, trie = there, Trie()
                node = trie.terminal(text)
                if node.value is None:
                    node.value = Copies(failing(text))
                for doc_id, part in zip(ids, parts, strict=True):
                    if doc_id is None:
                        nameless[part, node.value.mask] += 1
                    elif gone := node.value.add(doc_id, part):
                        out.extend((gone[0], x, node.value.mask | COPY, 1) for x in gone[1])
                if len(out) > 20_000:
                    yield masked()
        if place is not None:
            yield from finished()
        yield masked()

    return run


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: filter k of ABCDE fails), documents, good and toxic: how many documents of each."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-total // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sampled = rows.select(F.xxhash64("text").alias("name"), F.substring("text", 1, SAMPLE_BYTES).alias("text")).sample(min(1.0, SAMPLE / max(n, 1)), seed=1).collect()
    ranges = Ranges([(bytes(r["text"]), r["name"]) for r in sampled], parts)

    place = ("range", "split", "spread")
    dealt = lambda df: df.repartition(*place).sortWithinPartitions(*place)
    found = dealt(rows.mapInArrow(_condensed(ranges), PLACED)).mapInArrow(_judged(ranges, False), f"{PLACED}, {MASKED}")
    if max(ranges.spread) > 1:
        found = written(found)
        again = dealt(found.where("text is not null").select(*EITHER[: len(_PLACED)]))
        found = found.where("text is null").union(again.mapInArrow(_judged(ranges, True), f"{PLACED}, {MASKED}"))
    says = lambda x: F.max((F.col(x) == 1).cast("int"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("bad"))
    marked = found.select("doc_id", "part", "mask", "n").join(marks, "doc_id", "left")
    of = lambda x: F.sum(F.col("n") * F.coalesce(x, F.lit(0)))
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("documents"), of("good").alias("good"), of("bad").alias("toxic"))


def orders(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order):
            out.append({"filter_order": "".join(filters[x] for x in order), "step": step + 1, "bit": 1 << k, "before": before})
            before |= 1 << k
    return out


def audited(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each step of each order keeps, removes and loses, by part, of the counts of failure_masks."""
    steps = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order:string, step:int, bit:int, before:int>>")
    rows = masks.select("*", F.inline(steps))
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(before) > 0
    total = lambda x, where: F.coalesce(F.sum(F.when(where, F.col(x))), F.lit(0)).cast("long")
    # In all orders, a filter removes a document as often as it comes first among those that the document fails.
    first = F.when(fails, (F.col("documents") * math.factorial(len(filters)) / F.bit_count("mask")).cast("long"))
    return rows.groupBy("part", "filter_order", "step").agg(
        total("documents", ~gone & ~fails).alias("kept"),
        total("documents", fails & ~gone).alias("removed"),
        total("documents", fails & gone).alias("redundant"),
        total("documents", mask == bit).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
        F.coalesce(F.sum(first), F.lit(0)).cast("long").alias("shapley"),
    )
