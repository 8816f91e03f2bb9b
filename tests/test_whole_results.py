"""Queries whose results were once cut to fewer rows: all of them are there."""

import duckdb
from conftest import SMALL

from meridian.plans import registry


def sql(text):
    connection = duckdb.connect()
    for t in ("customer", "events"):
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection.execute(text).fetchall()


def test_point_series_has_a_row_for_each_moment(spark):
    got = registry.QUERIES["point_series"](spark, SMALL)
    assert got.columns == ["id", "name", "time", "value"]
    moments = got.groupBy("id", "name").count().selectExpr("max(count)", "sum(count)").first()
    most = sql("select max(n) from (select count(distinct floor(epoch(ts) / 21600)) as n from events group by event_id % 48)")[0][0]
    assert 1 < moments[0] <= most
    assert moments[1] == sql(f"select count(*) from ({registry.ORACLES['point_series']})")[0][0]


def test_hit_rate_has_the_windows_that_are_open_at_the_end(spark):
    rows = registry.QUERIES["stream_hit_rate"](spark, SMALL).collect()
    assert sum(r["total"] for r in rows) == sql("select count(*) from events")[0][0]
    assert max(r["start"] for r in rows) == sql("select strftime(date_trunc('hour', max(ts)), '%Y-%m-%dT%H:%M:%SZ') from events")[0][0]


def test_hit_rate_has_days_that_slide_by_hours_beside_hours(spark):
    rows = registry.QUERIES["stream_hit_rate"](spark, SMALL).collect()
    log = "(select date_trunc('hour', ts) as h, case when event_type in ('click', 'purchase') then 'point' when event_type in ('view', 'error') then 'grid' else 'other' end as kind, value < 30 as hit from events)"
    hours = dict(((h, k), (n, y)) for h, k, n, y in sql(f"select epoch(h)::bigint // 3600, kind, count(*), count(*) filter (hit) from {log} group by all"))
    seconds = dict(sql(f"select distinct strftime(h - to_hours(k), '%Y-%m-%dT%H:%M:%SZ'), epoch(h)::bigint // 3600 - k from {log}, range(24) t(k)"))
    assert {(seconds[r["start"]], r["kind"]) for r in rows} == {(h - k, kind) for h, kind in hours for k in range(24)}
    assert len(rows) == len({(r["start"], r["kind"]) for r in rows})
    for r in rows:
        h = seconds[r["start"]]
        n, y = hours.get((h, r["kind"]), (0, 0))
        day = [hours.get((h + k, r["kind"]), (0, 0)) for k in range(24)]
        assert (r["total"], r["hits"], r["rate"]) == (n, y, y / n if n else 0.0)
        assert (r["day_total"], r["day_hits"]) == tuple(map(sum, zip(*day, strict=True))) and r["day_rate"] == r["day_hits"] / r["day_total"]


def test_miss_latency_has_the_windows_that_are_open_at_the_end(spark):
    rows = registry.QUERIES["stream_miss_latency"](spark, SMALL).collect()
    assert sum(r["misses"] for r in rows) == sql("select count(*) from events where value >= 30")[0][0]
    assert max(r["start"] for r in rows) == sql("select strftime(date_trunc('hour', max(ts)), '%Y-%m-%dT%H:%M:%SZ') from events where value >= 30")[0][0]


def test_accesses_are_put_together_before_states_whatever_a_task_holds(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from meridian.streaming import streams as S

    rows = [(f"k{i * i % 7}", i * 37 % 101) for i in range(60)]
    table = pa.table({"key": [k for k, _ in rows], "ts": pa.array([t for _, t in rows], pa.timestamp("us", "UTC")), "n": [1] * 60})
    for limit in (4, 16, 1000):
        monkeypatch.setattr(S, "HELD_ROWS", limit)
        got = [r for b in S._together(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
        n, last = Counter(), {}
        for r in got:
            n[r["key"]] += r["n"]
            last[r["key"]] = max(last.get(r["key"], 0), r["ts"].microsecond)
        assert n == Counter(k for k, _ in rows) and last == {k: max(t for j, t in rows if j == k) for k in n}
        assert len(got) < 60 and (limit < 16 or len(got) == len(n))
    assert not list(S._together(iter(())))


def test_messages_come_in_more_tasks_where_their_table_is_larger(spark, monkeypatch):
    from pyspark.sql import functions as F

    from meridian.sources import fixtures as fx

    few = fx.messages(spark, SMALL)
    monkeypatch.setattr(fx, "ROWS_A_TASK", 100)
    many = fx.messages(spark, SMALL)
    tasks = many.groupBy(F.spark_partition_id()).count().selectExpr("count(*)", "max(count)").first()
    assert tasks[0] > 40 and tasks[1] < 400
    assert many.count() == few.count() and many.exceptAll(few).isEmpty()


def test_index_files_in_many_parts_have_the_lines_of_whole_ones(spark, monkeypatch):
    from meridian.plans import fields

    monkeypatch.setattr(fields, "PART_LINES", 60)
    connection = duckdb.connect()
    connection.execute(f"create view lineitem as select * from '{SMALL}/lineitem.parquet'")
    columns = ["kind", "file", "line", "offset", "length", "refusal"]
    want = connection.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({registry.ORACLES['index_files']})").fetchall()
    got = registry.QUERIES["index_files"](spark, SMALL).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
