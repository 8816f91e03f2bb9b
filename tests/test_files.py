"""Operators on files: digests, sizes, lines, and the two layouts of a layer."""

import hashlib

import pyarrow.parquet as pq
from conftest import SMALL

from meridian.operators import messages as M
from meridian.sources import fixtures as fx
from meridian.sources import layers as L


def test_checksums_sizes_and_lines(spark, tmp_path):
    contents = {"a.idx": b"1:0:d=2024\n2:10:d=2024\n\n", "b.idx": b"", "c.idx": bytes(range(10)) * 100}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "d.idx").write_bytes(b"x" * 7)
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["checksum"]) for r in M.checksum_files(spark, f"{tmp_path}/*.idx").collect()}
    assert got == {k: (len(v), "sha256:" + hashlib.sha256(v).hexdigest()) for k, v in contents.items() if v}
    total = sum(map(len, contents.values())) + 7
    assert M.folder_bytes(spark, str(tmp_path), quota=total).first().asDict() == {"bytes": total, "over_quota": False}
    assert M.folder_bytes(spark, str(tmp_path), quota=total - 1).first()["over_quota"]
    lines = M.read_lines(spark, f"{tmp_path}/a.idx").collect()
    assert [(r["line"], r["value"]) for r in lines] == [(1, "1:0:d=2024"), (2, "2:10:d=2024"), (3, "")]


def _index(tmp_path):
    good = '{"_offset": 0, "_length": 5, "param": "2t", "levelist": ""}'
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.index").write_text(f"{good}\n\nbroken\n{good}")
    (tmp_path / "run" / "b.index").write_bytes(b'{"_offset": 7, "param": "t"}\n\xff\n')
    (tmp_path / "run" / "_SUCCESS").write_text("no data")
    (tmp_path / "run" / "empty.index").write_text("")
    (tmp_path / "run" / "c.idx").write_text("other files")
    return str(tmp_path / "run")


def test_refusals_carry_path_and_line(spark, tmp_path):
    rows = M.parse_json_index(M.read_lines(spark, _index(tmp_path), ".index")).collect()
    got = {(r["file"].rsplit("/", 1)[1], r["line"]): (r["offset"], r["refusal"]) for r in rows}
    assert got == {("a.index", 1): (0, None), ("a.index", 3): (None, "offset, length"), ("a.index", 4): (0, None), ("b.index", 1): (7, "offset, length"), ("b.index", 2): (None, "offset, length")}


def test_index_files_as_a_stream(spark, tmp_path):
    folder = _index(tmp_path)

    def run():
        q = M.parse_json_index(M.read_lines(spark, folder, ".index", stream=True)).select("file", "line").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a.index", 1), ("a.index", 3), ("a.index", 4), ("b.index", 1), ("b.index", 2)]
    assert run() == first
    (tmp_path / "run" / "a2.index").write_text("later\n")
    assert run() == sorted([*first, ("a2.index", 1)])


def test_small_files_share_a_task_and_long_ones_are_streamed(tmp_path):
    from meridian.sources import index_files as X

    (tmp_path / "x").write_text("".join(f"{k}\n" for k in range(300_000)))
    rows = [v for b in X.lines_of(str(tmp_path), (str(tmp_path / "x"),)) for v in zip(b["line"].to_pylist(), b["value"].to_pylist(), strict=True)]
    assert rows == [(k + 1, str(k)) for k in range(300_000)]
    sizes = [5, 5, X.TASK_BYTES, 1, 1, X.TASK_BYTES + 1]
    assert [len(p.paths) for p in X.dealt([(k, str(k), n) for k, n in enumerate(sizes)])] == [2, 1, 2, 1]


def _ordered(path, key):
    """The number of rows, if each file's rows are in the order of the key."""
    rows = 0
    for file in path.rglob("*.parquet"):
        table = pq.read_table(file, partitioning=None)
        values = [key(*x) for x in zip(*[table[c].to_pylist() for c in ("time", "lat_i", "lon_i")], strict=True)]
        assert values == sorted(values)
        rows += len(values)
    return rows


def test_layouts_keep_together_what_is_read_together(spark, tmp_path):
    field = fx.field(spark, SMALL)
    L.write_layer(field, f"{tmp_path}/maps", "points")
    L.write_layer(field, f"{tmp_path}/series", "points", series=True)
    maps = _ordered(tmp_path / "maps", lambda t, i, j: (t, i, j))
    assert maps == _ordered(tmp_path / "series", lambda t, i, j: (i // L.BLOCK, j // L.BLOCK, i, j, t)) > 0
    # A node's series is one stretch of one file, and only its variable's folder is read.
    for file in (tmp_path / "series").rglob("*.parquet"):
        table = pq.read_table(file, partitioning=None)
        nodes = list(zip(table["lat_i"].to_pylist(), table["lon_i"].to_pylist(), strict=True))
        assert sum(a != b for a, b in zip(nodes, nodes[1:], strict=False)) == len(set(nodes)) - 1
    plan = L.scan_layer(spark, f"{tmp_path}/series", ["2t"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variable" in plan or "PartitionFilters: [(variable" in plan
