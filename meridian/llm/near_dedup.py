"""Near-duplicate groups by SetSketch registers, with exact links.

A document is the set of its distinct 5-word shingles (A-Z lower-cased; under five words, the
whole sequence). Register i of a set is the exponentially spaced, truncated minimum
floor(1 - log_b(x / a)) of an exponential variate x that every shingle draws for i; the draws
of a shingle are made in ascending order, register by register without repetition, so most
shingles stop after one or two (SetSketch2). Registers merge by maximum and are equal with a
probability of about the Jaccard similarity.

Steps: sets that are equal become one class. Classes that agree on the four registers of any
of 48 bands meet in a bucket; at a similarity of 0.75 a pair misses all bands with a
probability of 1.2e-8. In a bucket, each class is held against the bucket's centre
(never all against all): by length, then by the joint likelihood of the registers, then
exactly, on full shingle sets (two independent names for each shingle). Links give components
by label propagation. Pairs of a bucket that are then in different components are still open.
Two such sets with a link share part of what sets them apart from such a centre, so they meet
in an exact prefix filter on these deviations (see _deviations). Where many meet, they are first
held against one more centre, the one that most of their groups have: a family that shares what
its hub lacks becomes one component at the cost of its members, not of its pairs. What is then
still in different components, and may be linked by the numbers of its deviations, is compared
in pairs, so no link between classes that met is lost.

Null and empty texts, and texts without words, have an empty set and no links. Rows with a
null doc_id have no links, a null component and are kept. Rows that share a doc_id and differ
in text are nodes of their own; rows that repeat both are one node, and all kept if it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, TextSlice, checkpointed, mix, signed, slices, text_hash, with_twins, word_names, words_of, written

_U = np.uint64
SHINGLE = 5
PERCENT = 75
#: A prime, so that any step runs through all registers.
REGISTERS = 193
BANDS, BAND = 48, 4
BASE, RATE = 1.001, 20.0
#: Pairs whose most likely similarity is below this are dropped: five standard errors under 0.75.
LIKELY = 0.59
#: Groups of deviations beyond this size get centres of their own before what is left is compared in pairs.
SMALL = 64
#: Rounds of such centres.
ROUNDS = 1
#: Pairs with one centre that go to one task in a join.
PAIRS_A_TASK = 256
SIGNATURE = "doc_id long, hash long, twin long, n_shingles long, set_1 long, set_2 long, registers binary"


def shingles(part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document and two independent names, sorted by these."""
    data = part.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    part = TextSlice(part.batch, data, part.off)
    starts, ends, doc = words_of(part)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: max(0, len(doc) - SHINGLE + 1)] == doc[SHINGLE - 1 :])
    n = np.bincount(doc, minlength=len(part))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    first = np.searchsorted(doc, short, side="left")
    begin, size = np.concatenate([at, first]), np.concatenate([np.full(len(at), SHINGLE), n[short]])
    names = [mix(Rolling(word_names(part, starts, ends, x), x).of(begin, begin + size) + size.astype(np.uint64)) for x in (False, True)]
    return distinct(doc[begin], *names)


def distinct(own: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows, sorted."""
    order = np.lexsort((*names[::-1], own))
    columns = [x[order] for x in (own, *names)]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return tuple(x[new] for x in columns)


def sketch(own: np.ndarray, name: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x REGISTERS truncated minima as uint16; 0 for an empty set."""
    m = REGISTERS
    least = np.full(n_docs * m, np.inf)
    spot = (mix(name + _U(101)) % _U(m)).astype(np.int64)
    step = (mix(name + _U(202)) % _U(m - 1)).astype(np.int64) + 1
    x = np.zeros(len(name))
    bound = np.full(n_docs, np.inf)
    for j in range(m):
        u = ((mix(name + _U(1000 + j)) >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53
        x = x - np.log(u) / (m - j)
        keep = x < bound[own]
        if not keep.all():
            own, name, spot, step, x = own[keep], name[keep], spot[keep], step[keep], x[keep]
        if not len(own):
            break
        np.minimum.at(least, own * m + spot, x)
        spot = spot + step
        spot[spot >= m] -= m
        if j < 6 or j % 8 == 0:
            bound = least.reshape(n_docs, m).max(axis=1)
    with np.errstate(divide="ignore"):
        value = np.floor(1.0 - np.log(least / RATE) / np.log(BASE))
    return np.clip(value, 0, 65535).astype(np.uint16).reshape(n_docs, m)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        own, *names = shingles(part)
        n = np.bincount(own, minlength=len(part)).astype(np.int64)
        sums = []
        for name in names:  # sums over a set don't depend on its order
            total = np.zeros(len(part), dtype=np.uint64)
            np.add.at(total, own, mix(name))
            sums.append(pa.array(signed(mix(total))))
        registers = sketch(own, names[0], len(part))
        raw = pa.array([x.tobytes() for x in registers], pa.binary())
        yield pa.record_batch([*[part.column(x) for x in ("doc_id", "hash", "twin")], pa.array(n), *sums, raw], names=["doc_id", "hash", "twin", "n_shingles", "set_1", "set_2", "registers"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        bands = np.ascontiguousarray(regs[:, : BANDS * BAND]).view(np.uint64)
        keys = mix(mix(bands) + np.arange(BANDS, dtype=np.uint64)[None, :])
        node = np.repeat(np.asarray(batch.column("node")), BANDS)
        yield pa.record_batch([pa.array(signed(keys.ravel())), pa.array(node)], names=["bucket", "node"])


def likely_similarity(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """The similarity that makes the registers of two sets of known sizes most likely."""
    above = (first > second).sum(axis=1)[:, None]
    below = (first < second).sum(axis=1)[:, None]
    same = first.shape[1] - above - below
    u = (n_first / (n_first + n_second))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    part = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = part(u - (1 - u) * grid), part(1 - u - u * grid)
    chance = above * np.log(more) + below * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))
    return grid[np.arange(len(grid)), chance.argmax(axis=1)]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for x in ("r_a", "r_b"))
        n_a, n_b = (np.asarray(batch.column(x)).astype(float) for x in ("n_a", "n_b"))
        keep = pa.array(likely_similarity(one, two, n_a, n_b) >= LIKELY)
        yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text_a"):
        other = next(slices(iter([part.batch]), "text_b", 1 << 62))
        own, *names = (np.concatenate(x) for x in zip(shingles(part), shingles(other), strict=True))
        union = np.bincount(distinct(own, *names)[0], minlength=len(part)).astype(np.int64)
        both = np.bincount(own, minlength=len(part)).astype(np.int64) - union
        yield pa.record_batch([part.column("a"), part.column("b"), pa.array(both), pa.array(union)], names=["a", "b", "both", "union"])


def dealt_join(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """pairs (a, b, ...) joined to of_a (a, ...) and of_b (b, ...); the pairs of a centre a are dealt over tasks, each with a copy of its row."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("parts"))
    several = parts.where("parts > 1")
    dealt = pairs.join(several, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = of_a.join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(of_b, "b").join(copies, ["a", "part"]).drop("part")


def with_texts(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with text_a and text_b. Only texts that are needed move."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = cards.select("node", "text").join(needed, "node", "left_semi")
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return dealt_join(pairs, text("a"), text("b"))


def measured(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """a, b, both, union of the pairs (a, b) that pass lengths and likelihood."""
    of = lambda x: cards.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    near = dealt_join(pairs, of("a"), of("b")).where(100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b))
    near = checkpointed(near.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_likely, "a long, b long"))
    rows = with_texts(near, cards).select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_exact, "a long, b long, both long, union long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of all nodes of the edges (a, b) that are not their own label.

    In each round a node goes into its smallest smaller neighbour, and so on down to one that has
    none. The edges between these go on, so a round costs the edges that are still open.
    """
    edges = written(_open_edges(edges.select("a", "b")))
    rounds = []
    while not edges.isEmpty():
        into = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
        while not into.join(into.select(F.col("node").alias("label")), "label", "left_semi").isEmpty():
            into = written(_relabelled(into, "label", into))
        rounds.append(into)
        edges = written(_open_edges(_relabelled(_relabelled(edges, "a", into), "b", into)))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds.pop()
    while rounds:
        labels = merged(rounds.pop(), labels)
    return written(labels)


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (node, label) whose labels went into others by more, a table of the same form."""
    return _relabelled(labels, "label", more).union(more)


def _relabelled(rows: DataFrame, name: str, labels: DataFrame) -> DataFrame:
    """rows with the label of the column's node in its place."""
    of = labels.select(F.col("node").alias(name), F.col("label").alias("_label"))
    return rows.join(of, name, "left").withColumn(name, F.coalesce("_label", name)).select(rows.columns)


def _open_edges(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys by which two members of a bucket that deviate from a class b in their midst must meet.

    For sets x and y with a link, U = x - b, P = b - x, and x without a link to b:
    at most a quarter of x is not in y, so the U have at least |U| - |x| / 4 shingles in
    common, and the first |x| / 4 + 1 of each U (by name) share one if the U meet at all. If
    they don't, both U are at most a quarter of their sets, and fewer than 3/7 (|P_y| - |U_y|)
    of P_y are outside of P_x: any that many of P_y meet P_x.
    """
    for part in slices(batches, "text_a"):
        other = next(slices(iter([part.batch]), "text_b", 1 << 62))
        (own_a, *_), (own_b, *_) = both = shingles(part), shingles(other)
        own, name, second = (np.concatenate(x) for x in zip(*both, strict=True))
        extra = np.arange(len(own)) >= len(own_a)
        order = np.lexsort((second, name, own))
        own, name, second, extra = own[order], name[order], second[order], extra[order]
        same = (own[1:] == own[:-1]) & (name[1:] == name[:-1]) & (second[1:] == second[:-1])
        alone = ~(np.append(same, False) | np.append(False, same))
        own, name, extra = own[alone], name[alone], extra[alone]
        n = np.bincount(own_b, minlength=len(part)).astype(np.int64)
        far = np.asarray(part.column("far"))
        chosen = []
        n_u, n_p = (np.bincount(own[k], minlength=len(part)).astype(np.int64) for k in (extra, ~extra))
        nth = np.zeros(len(own), dtype=np.int64)
        for k in (extra, ~extra):
            doc = own[k]
            nth[k] = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
        near_all = 4 * n_u <= n
        some = n_p - ((4 * n_p + 3 * n_u) // 7 + 1) + 1
        for role, pick in enumerate((extra & (nth <= (n // 4)[own]), ~extra & near_all[own] & (nth < some[own]), ~extra & (near_all & far)[own])):
            at = np.flatnonzero(pick)
            chosen.append((own[at], name[at], np.full(len(at), role, dtype=np.int32), nth[at]))
        own, name, role, place = (np.concatenate(x) for x in zip(*chosen, strict=True))
        doc = pa.array(own)
        columns = [part.column("a").take(doc), pa.array(signed(name)), pa.array(role), part.column("b").take(doc)]
        columns += [pa.array(x) for x in (n[own], n_u[own], n_p[own], place)]
        yield pa.record_batch(columns, names=["hub", "name", "role", "node", "n", "u", "p", "at"])


DEVIATIONS = "hub long, name long, role int, node long, n long, u long, p long, at long"
GROUP = ["hub", "name", "kind"]


def _first_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: hubs and the members of buckets whose pairs, neither of them the centre, are still open.

    A class's hub is the most central of its buckets' centres. Members of a bucket are set
    against the most central of their hubs, so a family of copies has one or few. A hub that
    is a member of the bucket is its centre, so its pairs are measured already.
    """
    rank = F.struct("central", (-F.col("pivot")).alias("k"))
    hubs = members.groupBy("node").agg(F.max(rank).alias("hub"))
    label = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(hubs, "node")
    others = label.where("node != pivot")
    split = others.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("hub").alias("x")).where("low != high")
    split = split.select("bucket", (-F.col("x.k")).alias("a"))
    return others.select("bucket", F.col("node").alias("b")).join(split, "bucket").select("a", "b").distinct()


def _deviating(known: DataFrame, labels: DataFrame, cards: DataFrame) -> DataFrame:
    """DEVIATIONS of the members b of hubs a whose members are in several components."""
    of = lambda x, name: labels.select(F.col("node").alias(x), F.col("label").alias(name))
    known = known.join(of("b", "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    known = known.join(of("a", "of_hub"), "a", "left").withColumn("far", F.col("label") != F.coalesce("of_hub", "a"))
    several = known.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    known = checkpointed(known.join(several.select("a"), "a", "left_semi").select("a", "b", "far"))
    rows = with_texts(known, cards).select("a", "b", "far", "text_a", "text_b")
    return written(rows.mapInArrow(_deviations, DEVIATIONS).withColumn("kind", F.least("role", F.lit(1))))


def _open_groups(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """DEVIATIONS with labels, of the groups that have members of several components, and the groups' sizes."""
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = rows.groupBy(*GROUP).agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return rows.join(groups.where("low != high").drop("low", "high"), GROUP)


def _centres(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each member of large groups with the centre that most of its groups have.

    A group's centre is its member that most large groups of the hub have; turn decides between equals.
    """
    large = rows.where(F.col("size") > SMALL).select(*GROUP, "node")
    degree = large.groupBy("hub", "node").agg(F.count("*").alias("degree"))
    ranked = large.join(degree, ["hub", "node"]).withColumn("rank", F.struct("degree", F.xxhash64("node", F.lit(turn)).alias("k"), "node"))
    centre = ranked.groupBy(*GROUP).agg(F.max("rank").alias("x")).select(*GROUP, F.col("x.node").alias("a"))
    often = large.join(centre, GROUP).where("a != node").groupBy("hub", "node", "a").agg(F.count("*").alias("n"))
    chosen = often.groupBy("hub", "node").agg(F.max(F.struct("n", "a")).alias("x"))
    return chosen.select(F.col("x.a").alias("a"), F.col("node").alias("b")).distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a group and, by the numbers of their deviations, may be linked."""
    side = lambda x: rows.select(*GROUP, *[F.col(y).alias(f"{y}_{x}") for y in ("role", "node", "label", "n", "u", "p", "at")])
    # Seven times what the deviations must have in common, and what they can have at most.
    need = F.expr("4 * (p_a + p_b) + 3 * (u_a + u_b) - (n_a - u_a + p_a)")
    alike, most = 7 * F.least("p_a", "p_b"), 7 * (F.least("u_a", "u_b") + F.least("p_a", "p_b"))
    roles = "(role_a = 0 and role_b = 0 and node_a < node_b) or (role_a = 1 and role_b = 2)"
    sizes = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    # In the order of names, the first shingle in common must leave room for as many as both must have in common.
    left = lambda x, k: F.col(f"{k}_{x}") - F.col(f"at_{x}")
    few = F.least(left("a", "u"), left("b", "u"))
    room_u = (7 * few >= need - alike) & (4 * few >= F.greatest(4 * F.col("u_a") - F.col("n_a"), 4 * F.col("u_b") - F.col("n_b")))
    room_p = 7 * F.least(left("a", "p"), left("b", "p")) > 4 * F.col("p_a") + 3 * F.col("u_a")
    room = F.when(F.col("role_a") == 0, room_u).otherwise(room_p & (need <= alike))
    both = side("a").join(side("b"), GROUP).where("label_a != label_b").where(roles).where(sizes).where(most >= need).where(room)
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _other_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return _judged(with_twins(docs)).drop("hash")


def _judged(docs: DataFrame) -> DataFrame:
    sets = written(docs.mapInArrow(_signatures, SIGNATURE))
    key = ["set_1", "set_2", "n_shingles"]
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*key).agg(F.min(F.struct("doc_id", "twin")).alias("x"), F.first("registers").alias("registers"))
    # A class's number is its place in the checkpoint.
    classes = written(classes.select(*key, "registers", "x.doc_id", "x.twin", F.monotonically_increasing_id().alias("node")))
    bands = classes.select("node", "registers").mapInArrow(_bands, "bucket long, node long")
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(bands.join(buckets, "bucket"))
    # The centre of a bucket is the class that meets most others, over all buckets; the smallest of equals.
    degree = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    members = members.join(degree, "node")
    centre = members.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("k"))).alias("x"))
    centre = centre.select("bucket", (-F.col("x.k")).alias("pivot"), F.col("x.degree").alias("central"))
    members = checkpointed(members.select("bucket", "node").join(centre, "bucket"))
    stars = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    # What the comparisons need of the classes that meet any other, without all other texts.
    met = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n_shingles", "registers", F.col("doc_id").alias("id"), F.col("twin").alias("its"))
    cards = docs.join(met, (F.col("doc_id") == F.col("id")) & (F.col("twin") == F.col("its"))).select("node", "n_shingles", "registers", "text")
    cards = written(cards.dropDuplicates(["node"]))  # rows that repeat id and text
    linked = F.col("both") * 100 >= F.col("union") * PERCENT
    labels = components(checkpointed(measured(stars, cards).where(linked)).select("a", "b"))
    rows = _deviating(_first_open(members, labels), labels, cards)
    turn = 0
    while turn <= ROUNDS:
        groups = _open_groups(rows, labels)
        pairs = checkpointed(_other_components(_centres(groups, turn) if turn < ROUNDS else _pairs(groups), labels))
        some = not pairs.isEmpty()
        if some:
            links = checkpointed(measured(pairs, cards).where(linked)).select("a", "b")
            between = _relabelled(_relabelled(links, "a", labels), "b", labels)
            labels = written(merged(labels, components(between)))
        turn = turn + 1 if some or turn == ROUNDS else ROUNDS  # without large groups, the pairs are next
    of_node = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min("doc_id").alias("component"))
    of_set = of_node.join(least, "label").select(*key, "component")
    out = sets.select("doc_id", "hash", *key).join(of_set, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept: the smallest doc_id of each group, all columns."""
    gone = _judged(with_twins(docs)).where("not kept").select("doc_id", "hash").distinct()
    same = (docs["doc_id"].cast("long") == gone["doc_id"]) & (text_hash(docs["text"]) == gone["hash"])
    return docs.join(gone, same, "left_anti")
