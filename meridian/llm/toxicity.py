"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult (with a weight), threat, target, negation, reporting verb, other.
Four small transducers read the classes of a clause: one remembers a target, one counts down
from a negation, one remembers a reporting verb, one a threat. Their composition (product of
states, product of factors) is one table; a path through a clause earns each insult's weight
times the factors of its states, and a threat at a target earns a weight of its own. A
document's clauses give a few figures, of which a logistic curve makes the score.

Insults are learned: whole words and word beginnings that labelled documents show in toxic
rows and hardly elsewhere, beside a short list that is always there. The curve is fitted on
rows that the list was not learned from. Both see at most TRAIN_ROWS labelled rows in
expectation (by hash of doc_id, distinct texts), none of the held-out quarter.

Null and empty texts, and texts without such words, get the curve's lowest score. Labels are
joined on doc_id; rows that repeat a doc_id are scored each, and equal texts (ties) alike. A text
of any length is scored whole. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TextSlice, checkpointed, id_and_text, mix, runs_of, signed, slices, stretch_names

_U = np.uint64
#: Expected number of labelled rows that are learned from.
TRAIN_ROWS = 20_000
LEAST_ODDS, LEAST_ROWS = 2.5, 3
CUTOFF = 0.3
#: Lengths in bytes of word beginnings; 0 is the whole word.
STEMS = (0, 4, 5, 6)
REPORT = "doc_id long, score double, predicted int, clauses int"

#: Word lists of the grammar.
WORDS = {
    "insult": "idiot moron stupid scum trash loser worthless pathetic disgusting clown",
    "threat": "kill hurt destroy burn beat shoot stab hang",
    "target": "you your yours he she they this that these those du dein ihr sie tu vous ton votre il elle usted ustedes ellos",
    "negation": "not no never nobody isn aren nicht kein keine nie pas jamais nunca tampoco",
    "report": "said says called calls wrote claimed quoted sagte nannte dit appela dijo llamó",
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTING = range(6)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".!?;:\n")] = True


@dataclass(frozen=True)
class Transducer:
    """next state and factor by (state, class); what is not listed stays where it is, at factor 1."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return self.arcs.get((state, kind), (state, 1.0))


def _negation(reach: int, factor: float) -> Transducer:
    arcs = {(s, k): (max(0, s - 1), 1.0) for s in range(reach + 1) for k in range(len(CLASSES))}
    arcs |= {(s, INSULT): (s - 1, factor) for s in range(1, reach + 1)}
    arcs |= {(s, THREAT): (s - 1, factor) for s in range(1, reach + 1)}
    arcs |= {(s, NEGATION): (reach, 1.0) for s in range(reach + 1)}
    return Transducer(reach + 1, arcs)


PARTS = (
    Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.3)}),
    _negation(3, 0.5),
    Transducer(2, {(0, REPORTING): (1, 1.0), (1, INSULT): (1, 0.7), (1, THREAT): (1, 0.7)}),
    # A threat counts at a target only, before or after it.
    Transducer(3, {(0, TARGET): (1, 1.0), (0, THREAT): (2, 0.0), (2, TARGET): (1, 1.0), (1, THREAT): (1, 1.0)}),
)
THREAT_WEIGHT = 0.5


def composed(parts: tuple[Transducer, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Next state and factor of the composition, by state and class."""
    states = list(product(*[range(p.states) for p in parts]))
    number = {s: i for i, s in enumerate(states)}
    after = np.zeros((len(states), len(CLASSES)), dtype=np.int64)
    factor = np.ones((len(states), len(CLASSES)))
    for state, kind in product(states, range(len(CLASSES))):
        steps = [p.step(x, kind) for p, x in zip(parts, state, strict=True)]
        after[number[state], kind] = number[tuple(x for x, _ in steps)]
        factor[number[state], kind] = math.prod(y for _, y in steps)
    return after, factor


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lowered(part: TextSlice) -> TextSlice:
    data = part.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    return TextSlice(part.batch, data, part.off)


def word_features(part: TextSlice) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts and ends of the words, and for each stem length the words that have one, and its name."""
    starts, ends = runs_of(_LETTER[part.data], part.off)
    out = []
    for k in STEMS:
        which = np.flatnonzero(ends - starts > k) if k else np.arange(len(starts))
        stop = starts[which] + k if k else ends
        out.append((which, mix(stretch_names(part.data, starts[which], stop) + _U(k))))
    return starts, ends, out


def names_of(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), dtype=np.uint8)
    part = TextSlice(None, data, np.array([0, len(data)]))
    return word_features(part)[2][0][1]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        part = lowered(part)
        toxic = np.asarray(part.column("toxic")).astype(np.int64)
        starts, _, features = word_features(part)
        doc = part.owner(starts)
        own = np.concatenate([doc[w] for w, _ in features])
        name = np.concatenate([x for _, x in features])
        order = np.lexsort((own, name))
        own, name = own[order], name[order]
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
        own, name = own[new], name[new]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(name)))
        bad = np.add.reduceat(toxic[own], first) if len(first) else n
        yield pa.record_batch([pa.array(signed(name[first])), pa.array(bad), pa.array(n - bad)], names=["name", "toxic", "clean"])


@dataclass(frozen=True)
class Grammar:
    """Sorted names of listed words, with class and weight, and the curve's coefficients."""

    names: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray
    curve: np.ndarray | None = None

    @classmethod
    def of(cls, learned: dict[int, float]) -> Grammar:
        found = {int(x): (INSULT, w) for x, w in learned.items()}
        for kind, words in WORDS.items():
            for x in names_of(words):
                found[int(x)] = (CLASSES.index(kind), max(1.0, learned.get(int(x), 0.0)))
        names = np.array(sorted(found), dtype=np.uint64)
        return cls(names, np.array([found[int(x)][0] for x in names]), np.array([found[int(x)][1] for x in names]))


def figures(part: TextSlice, grammar: Grammar) -> np.ndarray:
    """Documents x (log of the sum, largest clause, distinct insults, sum by length, scoring clauses)."""
    part = lowered(part)
    starts, ends, features = word_features(part)
    kind, weight = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts))
    which_name = np.zeros(len(starts), dtype=np.int64)
    for words, name in features:
        at = np.minimum(np.searchsorted(grammar.names, name), len(grammar.names) - 1)
        hit = grammar.names[at] == name
        words, at = words[hit], at[hit]
        better = (kind[words] == OTHER) | (grammar.kinds[at] == INSULT) & (kind[words] == INSULT) & (grammar.weights[at] > weight[words])
        words, at = words[better], at[better]
        kind[words], weight[words], which_name[words] = grammar.kinds[at], grammar.weights[at], at
    out = np.zeros((len(part), 5))
    hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(hits):
        return out
    doc = part.owner(starts)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[part.data])])[starts]
    clause = np.cumsum(np.append(0, (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])))
    n_words = np.bincount(doc, minlength=len(part))
    after, factor = once_composed()
    seen: dict[int, set[int]] = {}
    for c in np.unique(clause[hits]):
        a, b = np.searchsorted(clause, [c, c + 1])
        state, total = 0, 0.0
        for k, w in zip(kind[a:b].tolist(), weight[a:b].tolist(), strict=True):
            if k == INSULT:
                total += w * factor[state, k]
            elif k == THREAT:
                total += THREAT_WEIGHT * factor[state, k]
            state = after[state, k]
        i = doc[a]
        out[i, 0] += total
        out[i, 1] = max(out[i, 1], total)
        out[i, 4] += total > 0
        seen.setdefault(i, set()).update(which_name[a:b][kind[a:b] == INSULT].tolist())
    for i, x in seen.items():
        out[i, 2] = len(x)
    out[:, 3] = out[:, 0] / np.log(2.0 + n_words)
    out[:, 0] = np.log1p(out[:, 0])
    return out


_composed: list = []


def once_composed() -> tuple[np.ndarray, np.ndarray]:
    if not _composed:
        _composed.append(composed(PARTS))
    return _composed[0]


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0], np.minimum(x[:, 1], 6.0), np.minimum(x[:, 2], 6.0), np.minimum(x[:, 3], 3.0)])


def fitted_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic coefficients by Newton steps, with a penalty on all but the constant."""
    x = _inputs(x)
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


#: Without any labelled rows: a curve by hand.
_DEFAULT_CURVE = np.array([-3.0, 2.0, 0.3, 0.5, 0.3])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """Learn insults and the curve from labelled rows outside the held-out quarter. An id that is labelled both ways is toxic."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, rows / max(n, 1)))
    # The sample's ids have an expected number of at most rows, whatever the table's size.
    sample = id_and_text(docs).join(F.broadcast(marked.where(part)), "doc_id").where("text is not null")
    # One pass over the documents; the sample is bounded, as its ids are.
    sample = checkpointed(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    learn, fit = sample.where(fold != 3), sample.where(fold == 3)
    counts = learn.select("doc_id", "text", "toxic").mapInArrow(_count_features, "name long, toxic long, clean long")
    counts = counts.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(f"toxic >= {LEAST_ROWS}")
    sizes = learn.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in sizes}
    n_toxic, n_clean = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    odds = F.log((F.col("toxic") - 1) / n_toxic) - F.log((F.col("clean") + 1) / n_clean)
    best = counts.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()  # words of a bounded sample
    learned = {r["name"] & (1 << 64) - 1: min(3.0, r["odds"] / 2) for r in best}
    grammar = Grammar.of(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = figures(part, grammar)
            yield pa.record_batch([*[pa.array(c) for c in x.T], part.column("toxic")], names=["a", "b", "c", "d", "e", "toxic"])

    rows_ = fit.select("text", "toxic").mapInArrow(run, "a double, b double, c double, d double, e double, toxic int").collect()
    curve = _DEFAULT_CURVE
    if rows_ and len({r["toxic"] for r in rows_}) == 2:
        table = np.array([tuple(r) for r in rows_], dtype=float)
        curve = fitted_curve(table[:, :5], table[:, 5])
    return Grammar(grammar.names, grammar.kinds, grammar.weights, curve)


def _scores(part: TextSlice, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of scoring clauses of each document of a slice."""
    x = figures(part, grammar)
    return 1 / (1 + np.exp(-np.clip(_inputs(x) @ grammar.curve, -30, 30))), x[:, 4]


def scored(docs: DataFrame, grammar: Grammar, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, score, predicted and the number of scoring clauses of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score, clauses = _scores(part, grammar)
            columns = [part.column("doc_id"), pa.array(score), pa.array((score >= cutoff).astype(np.int32)), pa.array(clauses.astype(np.int32))]
            yield pa.record_batch(columns, names=["doc_id", "score", "predicted", "clauses"])

    return id_and_text(docs).mapInArrow(run, REPORT)


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns. Rows are filtered where they are, without a join."""
    grammar = train(docs, labels)
    # Tasks see columns by place: a name may hold a full stop.
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield part.batch.filter(pa.array(_scores(part, grammar)[0] < cutoff))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
