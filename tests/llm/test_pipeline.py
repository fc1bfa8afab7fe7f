"""The pipeline's stages against plain versions, on whole small tables."""

import importlib

import pytest

from pairlens.llm.pii import redact
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_packing import check as check_packing
from tests.llm.test_quality import plain as plain_quality
from tests.llm.test_similar import plain_kept

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    for name in ("quality", "near_duplicates", "personal_data", "mixing"):
        assert steps[name].columns == steps["documents"].columns
        assert all(r.n_chars == len(r.text) for r in steps[name].collect())


def test_quality_rejects_what_fails(steps):
    kept = set(ids(steps["quality"]))
    docs = steps["documents"].collect()
    assert not [d.doc_id for d in docs if plain_quality(d.text)[-1] and d.doc_id in kept]
    assert len(kept) > 0.7 * len(docs)
    before = {d.doc_id: d.text for d in docs}
    for r in steps["quality"].collect():  # lines are only removed
        lines = iter(before[r.doc_id].split("\n"))
        assert all(x in lines for x in r.text.split("\n"))


def test_near_duplicates_keep_one_of_each_group(steps):
    assert ids(steps["near_duplicates"]) == plain_kept([(r.doc_id, r.text) for r in steps["quality"].collect()])


def test_personal_data_is_replaced(steps):
    before = {r.doc_id: r.text for r in steps["near_duplicates"].collect()}
    assert {r.doc_id: r.text for r in steps["personal_data"].collect()} == {i: redact(t) for i, t in before.items()}


def test_mix_and_packing(spark, steps):
    from pairlens.llm.mixing import mix

    check_mix(mix(steps["personal_data"]).collect(), steps["personal_data"].collect())
    check_packing(steps["packing"].collect(), steps["mixing"].collect())


def test_the_stages_are_those_asked_for():
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]


def test_run_equals_the_stages(spark, sf, steps):
    assert ids(pipeline.run(spark, sf)) == ids(steps["packing"])


def test_stages_take_empty_and_odd_tables(spark, sf, odd_docs, no_docs):
    for start in (no_docs, odd_docs.select(*no_docs.columns), odd_docs.selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars")):
        docs = start
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
