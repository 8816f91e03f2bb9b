"""Index queries give every line of a file, also those after the two broken ones."""

from conftest import SMALL

from meridian.plans import registry
from meridian.sources import fixtures as fx


def lines(spark):
    files = {}
    for r in fx.messages(spark, SMALL).orderBy("file", "n").collect():
        files.setdefault(r["file"], []).append(r)
    assert max(map(len, files.values())) > 8
    return files


def test_json_index_is_whole(spark):
    want = set()
    for file, rows in lines(spark).items():
        for r in rows:
            if r["n"] in (6, 7):
                want.add((file, r["n"], None, None, "x" if r["n"] == 7 else "", "", "offset, length"))
            else:
                want.add((file, r["n"], r["offset"], r["length"], str(r["param"]), str(r["level"]), None))
    got = registry.QUERIES["parse_ecmwf_index"](spark, SMALL).select("file", "line", "offset", "length", "param", "level", "refusal").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_colon_index_is_whole(spark):
    want = set()
    for file, rows in lines(spark).items():
        good = [r for r in rows if r["n"] not in (6, 7)]
        for r, after in zip(good, [*good[1:], None], strict=True):
            want.add((file, r["n"], r["offset"], after and after["offset"] - r["offset"], None))
        want |= {(file, r["n"], None if r["n"] == 6 else 2, None, "offset" if r["n"] == 6 else "fields") for r in rows if r["n"] in (6, 7)}
    got = registry.QUERIES["parse_gfs_idx"](spark, SMALL).select("file", "line", "offset", "length", "refusal").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
