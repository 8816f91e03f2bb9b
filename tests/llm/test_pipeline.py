"""The pipeline against a brute-force version of its stages."""

import pytest

pytest.importorskip("corpus_pipeline")
from test_operators import groups, suffix_cut  # noqa: E402

import corpus_pipeline  # noqa: E402
from meridian.llm import quality, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "near_dedup", "suffix_dedup", "packing"]
    rows = {r["doc_id"]: r for r in documents.collect()}

    calm = stages["toxicity"](spark, documents, SMALL).cache()
    grammar = toxicity.train(documents, spark.read.parquet(f"{SMALL}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scored(documents, grammar).collect() if r["predicted"]}
    assert {r["doc_id"] for r in calm.collect()} == set(rows) - toxic and calm.columns == documents.columns

    good = stages["quality_rules"](spark, calm, SMALL).cache()
    bad = {r["doc_id"] for r in quality.judged(calm).collect() if not r["kept"]}
    assert {r["doc_id"] for r in good.collect()} == set(rows) - toxic - bad

    single = stages["near_dedup"](spark, good, SMALL).cache()
    want = groups(sorted((r["doc_id"], r["text"]) for r in good.collect()))
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}

    cut = stages["suffix_dedup"](spark, single, SMALL).cache()
    assert cut.columns == documents.columns
    expected = suffix_cut(sorted((r["doc_id"], r["text"]) for r in single.collect()))
    for r in cut.collect():
        b, gone = expected[r["doc_id"]]
        assert r["text"] == bytes(x for x, y in zip(b, gone, strict=True) if not y).decode(errors="ignore")

    pieces = stages["packing"](spark, cut, SMALL)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in cut.collect()}
