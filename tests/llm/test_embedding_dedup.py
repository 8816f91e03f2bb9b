"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

embedding_dedup = pytest.importorskip("meridian.llm.embedding_dedup")

SCHEMA = "vec_id long, embedding array<{}>, label int, vector string, node long, cell int, first string, `meta.url` string"


def plain(rows):
    """(vec_id, n_links, component_id, kept) of every row, in any order."""
    nodes = sorted({(i, None if e is None else tuple(e)) for i, e in rows}, key=str)
    good = [k for k, (_, e) in enumerate(nodes) if e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = {k: set() for k in range(len(nodes))}
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            x, y = (np.array(nodes[k][1], float) / np.abs(nodes[k][1]).max() for k in (a, b))
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo.extend(new)
        ids = [nodes[j][0] for j in seen if nodes[j][0] is not None]
        low = min(ids) if ids else None
        out[nodes[k]] = (nodes[k][0], len(links[k]), low, nodes[k][0] == low)
    return sorted((out[i, None if e is None else tuple(e)] for i, e in rows), key=str)


def found(spark, rows, kind="float", n=3):
    frame = spark.createDataFrame([(i, e, 1, "v", 2, 3, "f", "u") for i, e in rows], SCHEMA.format(kind)).repartition(n)
    return sorted(map(tuple, embedding_dedup.near_vectors(frame).collect()), key=str)


def some_rows(rnd, n=400, d=16):
    """Families of near copies, chains that link ends which are far apart, and equal and parallel vectors."""
    base = rnd.normal(size=(n, d))
    for k in range(n // 4, n // 2):
        base[k] = base[k % 7] + rnd.normal(size=d) * 0.2
    for k in range(n // 2, n // 2 + 40):
        base[k] = base[k - 1] + rnd.normal(size=d) * 0.3
    base[n - 20 : n - 10] = base[0]
    base[n - 10 :] = base[1] * np.arange(1, 11)[:, None]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rnd.permutation(n), base, strict=True)]


@pytest.mark.parametrize("block", [8192, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PIECE", 5)
    rows = some_rows(np.random.default_rng(block))
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [nan] + [1.0] * 15), (1003, [inf] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [1.0, 2.0]), (1008, [1.0, 2.1])]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, [5.0, -2.0]), (None, None), (5, rows[9][1]), (5, rows[9][1]), (1009, [1e-30] * 16), (1010, [1e30] * 16), (1011, [-0.0] * 15 + [1.0]), (1012, [0.0] * 15 + [1.0])]
    assert found(spark, rows) == plain(rows)


def test_a_family_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rnd = np.random.default_rng(4)
    rows = rnd.normal(size=(900, 24))
    rows[::3] = rows[0] + rnd.normal(size=(300, 24)) * 0.1
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    assert found(spark, rows, "double") == plain(rows)


def test_thresholds_and_small_tables(spark):
    edge = [math.sqrt(1 - 0.95**2)]
    for pair in ([[1.0, 0.0], [0.95, *edge]], [[1.0, 0.0], [0.9499999, *edge]], [[19.0, 0.0], [19.0, math.sqrt(39)]]):
        rows = list(enumerate(pair))
        assert found(spark, rows, "double", 1) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(3, [1.0])]) == [(3, 0, 3, True)] and found(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_bounds_keep_every_link():
    """Whatever the pivots: a vector visits the cells of all vectors that it is linked with."""
    rnd = np.random.default_rng(0)
    for d in (2, 3, 8, 64):
        x = rnd.normal(size=(1500, d))
        x[500:] = x[rnd.integers(0, 500, 1000)] + rnd.normal(size=(1000, d)) * 0.2 / math.sqrt(d)
        x /= np.linalg.norm(x, axis=1)[:, None]
        pivots = embedding_dedup.farthest_first(x[:200], 12)
        home = (x @ pivots.T).argmax(axis=1)
        angle = np.arccos(np.clip((x @ pivots.T).max(axis=1), -1, 1))
        layout = embedding_dedup.Layout(pivots, [(8 * d, int(c), int((home == c).sum()), float(angle[home == c].max())) for c in set(home)])
        visits = layout.visited(x, home)
        a, b = np.nonzero(x @ x.T >= 0.95)
        assert (visits[a, home[b]]).all()
        if d <= 3:
            assert visits.mean() < 0.6
