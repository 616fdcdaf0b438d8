"""Registered text queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from adledger.llm import exact_dedup
from adledger.llm.queries import registry
from tests.check import compare, duck
from tests.llm.helpers import near_roots


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, registry.queries[name], registry.sql[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries) - set(registry.sql)))
def test_query_has_a_row_for_each_input_row(spark, sf_dir, name):
    source = "conversations" if name.startswith("op3") else "documents"
    assert registry.queries[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    good = corpus_pipeline.quality_classifier(spark, docs, sf_dir).cache()
    distinct = corpus_pipeline.exact_duplicates(spark, good, sf_dir).cache()
    assert distinct.count() == good.select("text").distinct().count()
    assert {(r.doc_id,) for r in distinct.select("doc_id").collect()} == {
        (r.doc_id,) for r in exact_dedup.exact_groups(good).where("kept").collect()}
    near = corpus_pipeline.near_duplicates(spark, distinct, sf_dir).cache()
    roots, _ = near_roots([(r.doc_id, r.text) for r in distinct.select("doc_id", "text").collect()])
    assert {r.doc_id for r in near.select("doc_id").collect()} == set(roots.values()) and near.count() == len(set(roots.values()))
    clean = corpus_pipeline.benchmark_decontamination(spark, near, sf_dir)
    ids = corpus_pipeline.token_ids(spark, clean, sf_dir)
    for frame in (good, distinct, near, clean):
        assert frame.columns == docs.columns
    assert ids.count() == clean.count() < docs.count()
