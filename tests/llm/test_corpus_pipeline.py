"""The stages of the corpus pipeline on odd tables and on a small corpus."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabledeltas.llm.common import saved, working_folder


def stages(spark, docs, sf_dir):
    folder = working_folder(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
        yield name, docs


def test_stages_keep_clean_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    before = set(given)
    for name, out in stages(spark, docs, tiny):
        rows = out.collect()
        ids = collections.Counter(r["doc_id"] for r in rows)
        assert set(ids) <= before
        assert all(tuple(r)[: len(docs.columns)] == tuple(given[r["doc_id"]]) for r in rows)
        if name == "language":
            assert len(ids) >= 0.97 * len(before)
        if name not in ("mixing", "sharding"):
            assert set(ids.values()) == {1}
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert len({r["text"] for r in rows}) == len(rows)
        before = set(ids)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, odd_docs, no_docs, tiny, empty):
    docs = no_docs if empty else odd_docs
    for name, out in stages(spark, docs, tiny):
        assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == ["shard_", "slot_"]
    assert (out.count() == 0) == empty


@pytest.mark.parametrize("lang", ["en", None])
def test_one_language_or_none_passes_every_stage(spark, tiny, lang):
    """All rows labelled alike, and no row labelled at all."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("lang = 'en'")
    docs = docs.withColumn("lang", F.lit(lang).cast("string"))
    given = docs.where("text rlike '[a-z]'").count()
    sizes = {name: out.count() for name, out in stages(spark, docs, tiny)}
    assert sizes["language"] >= 0.97 * given > 0
    assert all(sizes.values())


def test_language_stage_keeps_mixed_languages(spark, small):
    """Clean text in three and in all four languages, in equal parts, stays; noise does not."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    best = docs.where("length(text) > 600").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"))
    parts = [r["text"][:600] for r in best.orderBy("lang").collect() if r["lang"] is not None]
    assert len(parts) >= 4
    added = [(-1, " ".join(parts[:3])), (-2, " ".join(parts)), (-3, "булок ещё этих " * 50)]
    more = spark.createDataFrame(added, "doc_id long, text string")
    out = corpus_pipeline.language_stage(spark, docs.unionByName(more, allowMissingColumns=True), small)
    assert {r["doc_id"] for r in out.where("doc_id < 0").collect()} == {-1, -2}
