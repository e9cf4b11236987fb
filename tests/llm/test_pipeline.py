"""The pipeline against brute force, stage by stage."""

import os

import pytest
from test_llm import brute_join, brute_repeats

import corpus_pipeline as P
from siteseer.llm import quality, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = dict(P.STAGES)
    assert len(P.STAGES) in (4, 5)
    good = names["quality"](spark, docs, SF).cache()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.judge(quality.ledger(docs)).where("kept").collect()}
    calm = names["toxicity"](spark, good, SF).cache()
    assert 0.7 * good.count() < calm.count() <= good.count()
    rows = sorted((r["doc_id"], r["text"]) for r in calm.collect())
    texts = [t for _, t in rows]
    heads = {rows[i][0] for i, (_, c) in brute_join(texts, 5, 80).items() if c == i}
    single = names["near_duplicates"](spark, calm, SF).cache()
    assert {r["doc_id"] for r in single.collect()} == heads
    rows = sorted((r["doc_id"], r["text"]) for r in single.collect())
    want = brute_repeats([t for _, t in rows], 13)
    out = names["substring_dedup"](spark, single, SF).cache()
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, (d, t) in enumerate(rows):
        assert got[d] == (t if not want[i][1] else want[i][2])
    packed = names["packing"](spark, out, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(got)
    assert P.run(spark, SF).count() == packed.count()


def test_queries_are_registered():
    q = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in q) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(q)
