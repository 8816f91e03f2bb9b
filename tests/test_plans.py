"""What the plans of the main queries look like."""

from conftest import SMALL

from meridian.plans import registry
from meridian.sources import fixtures as fx


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    text = plan(fx.query_log(spark, SMALL).select("hit"))
    assert "ReadSchema: struct<value:double>" in text


def test_to_canonical_has_no_shuffle_of_fields(spark):
    from meridian.operators import normalize as N
    from meridian.plans.fields import raw
    from meridian.plans.requests import axes

    rows = spark.createDataFrame(raw(spark, SMALL).limit(10).collect(), raw(spark, SMALL).schema)
    text = plan(N.to_canonical(rows, *axes(spark)))
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text and "Python" not in text


def test_no_python_on_the_main_path(spark):
    for name in ("point_series", "grid_window", "validate", "eviction_select", "byte_ranges", "to_canonical"):
        assert "Python" not in plan(registry.QUERIES[name](spark, SMALL))


def test_no_cartesian_product_of_tables(spark):
    for name in ("point_series", "nearest_node", "compact_grid"):
        assert "CartesianProduct" not in plan(registry.QUERIES[name](spark, SMALL))
