"""Vector search against brute force, and recall of the index."""

import numpy as np
import pytest

from codeweave.operators.vectors import LshIndex, search


def brute(questions, vectors):
    out = []
    for qid, project, k, q in questions:
        q = np.array(q)
        rows = []
        for p, i, v in vectors:
            if p == project and v is not None and len(v) == len(q):
                n = np.linalg.norm(v) * np.linalg.norm(q)
                rows.append((-np.floor(max(0.0, float(np.dot(v, q)) / n if n else 0.0) * 10_000 + 0.5) / 10_000, i))
        out += [(qid, i, -s, r + 1) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def tables(spark, questions, vectors):
    return (spark.createDataFrame(questions, "question_id long, project_id string, top_k int, qvec array<double>"),
            spark.createDataFrame(vectors, "project_id string, id string, embedding array<double>").repartition(5))


def found(df):
    return sorted((r.question_id, r.id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    vectors = []
    for p in range(2):
        for c in range(120):
            centre = rng.normal(size=24)
            vectors += [(f"p{p}", f"{p}-{c:03d}-{k}", (centre + 0.05 * rng.normal(size=24)).tolist()) for k in range(8)]
    questions = [(i, v[0], 5, (np.array(v[2]) + 0.02 * rng.normal(size=24)).tolist()) for i, v in enumerate(vectors[::40])]
    return questions, vectors


@pytest.mark.parametrize("most", [16_384, 3])
def test_search(spark, most):
    rng = np.random.default_rng(1)
    vectors = [(f"p{i % 3}", f"v{i}", np.round(rng.normal(size=6), 1).tolist()) for i in range(400)]
    vectors += [("p0", f"same{i}", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [("p0", "zero", [0.0] * 6), ("p0", "none", None),
                                                                              ("p0", "short", [1.0, 2.0])]
    questions = [(i, f"p{i % 4}", 1 + i % 20, np.round(rng.normal(size=6), 1).tolist()) for i in range(12)]
    questions += [(50, "p0", 20, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (51, "p1", 5, [0.0] * 6)]
    q, v = tables(spark, questions, vectors)
    assert found(search(q, v, unit_vectors=False, most=most)) == brute(questions, vectors)


def test_search_of_nothing(spark, clustered):
    questions, vectors = clustered
    q, v = tables(spark, questions, vectors)
    assert search(q.limit(0), v, unit_vectors=False).count() == 0
    assert search(q, v.limit(0), unit_vectors=False).count() == 0


def test_index_finds_neighbours_in_small_cells(spark, clustered):
    questions, vectors = clustered
    q, v = tables(spark, questions, vectors)
    index = LshIndex(v)
    got = index.search(q).cache()
    want = {x[:2] for x in brute(questions, vectors)}
    rows = got.collect()
    assert {r.way for r in rows} == {"index"} or sum(r.way == "index" for r in rows) > 0.8 * len(rows)
    assert all(r["rank"] <= 5 for r in rows)
    assert len(want & {(r.question_id, r.id) for r in rows}) >= 0.95 * len(want)
    asked = index.codes(q.selectExpr("project_id", "question_id AS id", "qvec"), probes=True).withColumnRenamed("id", "question_id")
    pairs = asked.join(index.postings, ["project_id", "part", "code"]).select("question_id", "id").distinct().count()
    assert pairs < 0.2 * len(questions) * len(vectors) / 2, "cells hold few vectors"


def test_questions_without_near_vectors_are_searched_exactly(spark, clustered):
    questions, vectors = clustered
    rng = np.random.default_rng(8)
    far = [(i, "p0", 5, rng.normal(size=24).tolist()) for i in range(6)]
    q, v = tables(spark, far, vectors)
    got = LshIndex(v).search(q)
    assert {r.way for r in got.collect()} == {"exact"}
    assert found(got) == brute(far, vectors)


def test_best_over_many_blocks():
    """Vectors that come in small batches, with many equal scores, give the same as all at once."""
    import pyarrow as pa

    from codeweave.operators import vectors as V
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 8)), 1) * (rng.random((3000, 8)) < 0.4)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    ids = np.array([f"v{i}" for i in rng.permutation(3000)], dtype=object)
    q = x[:40]
    table = pa.table({"question_id": np.arange(40), "top_k": 1 + np.arange(40) % 20, "qvec": pa.array(q.tolist())})
    best, before = V._Best(table, True), V.BLOCK
    V.BLOCK = 2048
    try:
        for a in range(0, 3000, 70):
            best.add(ids[a:a + 70], x[a:a + 70])
        question, found_ids, scores = best.rows()
    finally:
        V.BLOCK = before
    want = brute([(i, "p", int(1 + i % 20), v) for i, v in enumerate(q)], [("p", i, v) for i, v in zip(ids, x)])
    assert sorted(zip(question.to_pylist(), found_ids, scores.tolist())) == [w[:3] for w in want]


def test_index_hands_a_question_few_vectors(spark):
    """A few near copies among far vectors make cells wide; they still hold a bounded number."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16))
    x[3200:] = x[:800] + 0.3 * rng.normal(size=(800, 16))
    q, v = tables(spark, [(i, "p", 1, x[3200 + i].tolist()) for i in range(100)],
                  [("p", f"v{i}", r.tolist()) for i, r in enumerate(x)])
    index = LshIndex(v)
    asked = index.codes(q.selectExpr("project_id", "question_id AS id", "qvec"), probes=True).withColumnRenamed("id", "question_id")
    pairs = asked.join(index.postings, ["project_id", "part", "code"]).select("question_id", "id").distinct().count()
    assert pairs < 0.4 * 100 * 4000
    got = {r.question_id: r.id for r in index.search(q).collect()}
    assert got == {i: f"v{3200 + i}" for i in range(100)}


def test_cells_are_narrower_where_projections_are_not_enough(spark):
    """Vectors that are all far from one another: their nearest distances alone would make cells that hold nearly all."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    vectors = [("p", f"v{i:04d}", r.tolist()) for i, r in enumerate(x)]
    questions = [(i, "p", 3, (x[i] + (0.02 if i < 20 else 2.0) * rng.normal(size=64)).tolist()) for i in range(40)]
    q, v = tables(spark, questions, vectors)
    index = LshIndex(v, candidates=100)
    asked = index.codes(q.selectExpr("project_id", "question_id AS id", "qvec"), probes=True).withColumnRenamed("id", "question_id")
    pairs = asked.join(index.postings, ["project_id", "part", "code"]).select("question_id", "id").distinct().count()
    assert pairs < 0.1 * len(questions) * len(vectors)
    assert found(index.search(q)) == brute(questions, vectors)


def test_copies_of_a_vector_do_not_narrow_the_cells_for_ever(spark):
    q, v = tables(spark, [(1, "p", 2, [1.0, 2.0])], [("p", f"v{i:02d}", [1.0, 2.0]) for i in range(50)])
    assert found(LshIndex(v, candidates=10).search(q)) == [(1, "v00", 1.0, 1), (1, "v01", 1.0, 2)]


def test_embedder_remembers_tokens_from_batch_to_batch():
    import hashlib
    import pickle

    from codeweave.operators.vectors import HashedTokenEmbedder
    e, texts = HashedTokenEmbedder(8, most=3), ["Ab a_b ab", "", None, "x y z w", "ab x"]
    for made in (e(texts), pickle.loads(pickle.dumps(e))(texts), [v for t in texts for v in e([t])]):
        for t, v in zip(texts, made, strict=True):
            want = np.zeros(8)
            for token in (t or "").lower().split():
                want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 8] += 1
            assert np.allclose(v, want / max(np.linalg.norm(want), 1e-9))
    assert "ab" in e.buckets and len(e.buckets) <= 3 + 4
