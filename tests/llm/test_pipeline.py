"""The pipeline on the smallest tables, each stage against what it may change, and BPE against tiktoken at the end."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import jaccard_join, mixing, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            assert 0 < new.count() <= before and new.join(docs, columns, "left_anti").count() == 0
        if name == "line_dedup":
            assert new.count() == docs.count()
        if name == "ngram_jaccard_join":
            found = jaccard_join.join(docs).where("doc_id = component_id")
            assert {r[0] for r in new.select("doc_id").collect()} == {r[0] for r in found.select("doc_id").collect()}
        if name == "mixing_sources":
            assert new.count() == mixing.plan(docs).where("size > 0").agg(F.sum("copies")).first()[0]
        if name == "byte_level_bpe":
            import public_tokenizers as P
            import tiktoken

            from factloom.llm import bpe

            t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            assert sorted((r["doc_id"], r["ids"]) for r in new.collect()) == sorted((r["doc_id"], t.encode_ordinary(r["text"])) for r in docs.collect())
        docs = new
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    df, want = registry.QUERIES[name](spark, SF), db.execute(registry.ORACLE_SQL[name])
    order = [df.columns.index(d[0]) for d in want.description]
    assert sorted(tuple(r[i] for i in order) for r in df.collect()) == sorted(want.fetchall())
