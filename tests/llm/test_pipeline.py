"""The pipeline, stage by stage, on the smallest tables."""

import re

import corpus_pipeline
from codeweave.llm import quality
from codeweave.llm.common import Scratch

from .conftest import SF_SMALL
from .test_dedup import brute_components


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.store(stage(spark, docs, SF_SMALL), name)
        kept[name] = docs = out
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in kept.items() if name != "packing"}
    all_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    scored = quality.score(all_docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).collect()
    assert sorted(d for d, _ in rows["quality"]) == sorted(r.doc_id for r in scored if r.predicted == 1)
    first = {}
    for d, t in sorted(rows["quality"]):
        first.setdefault(re.sub("[\x20\x09-\x0D]+", " ", t), d)
    assert sorted(first.values()) == sorted(d for d, _ in rows["exact"])
    assert {c for _, _, c in brute_components(rows["exact"], 5, 80)} == {d for d, _ in rows["near"]}
    assert {d for d, _ in rows["mixing"]} < {d for d, _ in rows["near"]}
    packed = kept["packing"].collect()
    assert {r.doc_id for r in packed} == {d for d, _ in rows["mixing"]}
    ran = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in ran) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_registered_queries_and_sql():
    from codeweave.llm.queries import QUERIES
    assert set(QUERIES) > {"pipeline"} and sum(re.match(r"op\d+_", q) is not None for q in QUERIES) == 13


def test_stages_on_odd_rows(spark, make, corpus):
    """Null ids, null and empty texts, repeated rows, further columns with names of inner ones."""
    docs = make(corpus)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == {d for d, _ in corpus}
            assert sum(r.piece == 0 for r in rows) == len(corpus)
        else:
            assert out.columns == docs.columns
            every = docs.collect()
            assert all(r in every for r in rows)
        if name == "exact":
            norm = {re.sub("[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus}
            assert len(rows) == len(norm)
        empty = stage(spark, docs.where("false"), SF_SMALL)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
    nulls = docs.selectExpr("CAST(NULL AS long) AS doc_id", "CAST(NULL AS string) AS text", "CAST(NULL AS string) AS lang",
                            "CAST(NULL AS string) AS source").limit(5)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, SF_SMALL).count() <= 5
