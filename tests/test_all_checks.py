"""The query for all checks has every family of check_families."""

from conftest import SMALL

from meridian.functions import canon
from meridian.plans import registry
from meridian.sources import fixtures as fx


def test_validate_has_all_families(spark):
    rows = registry.QUERIES["validate"](spark, SMALL).collect()
    got = {(r["artifact"], r["name"]): (r["n"], r["passed"]) for r in rows}
    assert len(got) == len(rows)
    variables = {}
    for r in fx.field(spark, SMALL).selectExpr("date_format(time, 'yyyy-MM-dd') as artifact", "variable").distinct().collect():
        variables.setdefault(r["artifact"], set()).add(r["variable"])
    surface, atmos, _, _ = canon.LAYERS["points"]
    for artifact, names in variables.items():
        for name in ("lat_descending", "lon_ascending", "time_unique", "time_naive_utc"):  # the fixture's axes and keys are in order by construction
            assert got[artifact, name] == (1, 1)
        assert got[artifact, "fields_present"] == (1, int({*surface, *atmos} <= names))
    assert len({name for _, name in got}) == 17  # and the levels, three of semantics, and messages
