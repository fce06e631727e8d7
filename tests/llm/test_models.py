"""Operators 1, 4, 5, 6, 7 against brute force, exact counts and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeweave.llm import embed_dedup, mixing, ngram, packing, quality, tokens
from codeweave.llm.common import LOWER_TABLE, Scratch
from codeweave.llm.hnsw import Graph

from .conftest import SF_SMALL


# ------------------------------------------------------------- quality
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95


def test_quality_edge_cases(spark, make, corpus):
    docs = make(corpus)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, none).collect()
    assert len(rows) == len(corpus) and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {0}
    one = spark.createDataFrame([(20, 1), (None, 0), (21, None), (12345, 0)], "doc_id long, quality int")
    if zlib.crc32(b"20") % 4 != 2:
        assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(20, 60)], "doc_id long, quality int")
    rows = quality.score(docs, some).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.where("false"), some).count() == 0
    assert rows[0].lang == "en" and rows[0].source.startswith("src")


def test_scores_do_not_depend_on_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs.selectExpr("doc_id", "text", "'x' AS lang").repartition(3), labels).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_scores_do_not_depend_on_the_order_of_repeated_ids(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet").select(*c) for t, c in (
        ("documents", ("doc_id", "text")), ("labels", ("doc_id", "quality"))))
    twice = docs.unionAll(docs.selectExpr("doc_id", "concat(reverse(text), ' again')")).unionAll(docs.selectExpr("doc_id", "NULL"))
    a, b = (sorted((r.doc_id, r.text or "", r.score) for r in quality.score(d, labels).collect())
            for d in (twice, twice.repartition(5).sortWithinPartitions("text")))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert max(abs(x[2] - y[2]) for x, y in zip(a, b)) < 1e-9


# ------------------------------------------------------------- ngram
def brute_ngram(rows):
    tok = [(t or "").encode().translate(LOWER_TABLE).split() + [None] for _, t in rows]
    tr = [k for (d, _), k in zip(rows, tok) if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c, pairs = Counter(w for k in tr for w in k), Counter(x for k in tr for x in zip(["<s>"] + k, k))
    total, v, cont = sum(c.values()), len(c), Counter(w for _, w in pairs)

    def disc(values):
        return ngram.discounts([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    d2, d1, n, by = disc(list(pairs.values())), disc(list(cont.values())), Counter(), defaultdict(lambda: [0] * 4)
    for (x, _), k in pairs.items():
        n[x] += k
        by[x][min(k, 3)] += 1
    rest = sum(d1[min(k, 3)] for k in cont.values()) / len(pairs)

    def low(w):
        return max(cont.get(w, 0) - d1[min(cont.get(w, 0), 3)], 0) / len(pairs) + rest / (v + 1)

    def p(x, w):
        if not n[x]:
            return low(w)
        k = pairs.get((x, w), 0)
        return (max(k - d2[min(k, 3)], 0) + sum(d2[i] * by[x][i] for i in (1, 2, 3)) * low(w)) / n[x]
    assert abs(sum(p("<s>", w) for w in c) + p("<s>", b"\0") - 1) < 1e-9
    return [(d, len(k), sum(c[w] > 0 for w in k), total,
             sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in k),
             sum(math.log10(p(x, w)) for x, w in zip(["<s>"] + k, k))) for (d, _), k in zip(rows, tok)]


@pytest.mark.parametrize("hot", [ngram.HOT, 20])
def test_ngram(make, corpus, hot):
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
           for r in ngram.score(make(corpus), hot).collect()]
    key = lambda r: (repr(r[:4]), round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(brute_ngram(corpus), key=key), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9, atol=1e-9)


def test_ngram_without_training_texts(make):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ngram.score(make([(one, "a b"), (one, None)])).collect()
    assert sorted((x.n_tokens, x.n_known, x.train_tokens, x.score) for x in r) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert ngram.score(make([(1, "x")]).where("false")).count() == 0
    rows = [(1, "one two"), (2, "one"), (one, "one three")]
    got = sorted((r.doc_id, r.score) for r in ngram.score(make(rows)).collect())
    assert np.allclose(got, sorted((r[0], r[5]) for r in brute_ngram(rows)))


# ------------------------------------------------------------- packing
def test_ids_equal_those_of_tokenizers():
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    ids, whole, rng = tokens.Ids(path), Tokenizer.from_file(path), random.Random(4)
    parts = ["a", "B", " ", "  ", "\n", "'s", "don't", "é", "ß", "中", "😀", "1", "!!", "***", "\t", "\x0b", " ",
             "\u0085", "\xa0", "<|endoftext|>", "×", "º", "ǅ", " \n", "\r\n", "\x00", "word", "-", "ſ", "ı"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(ids.encode(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack_documents(make, corpus):
    from tokenizers import Tokenizer
    whole, size = Tokenizer.from_file(packing.default_tokenizer()), 256
    got = packing.pack_documents(make(corpus), size=size).collect()
    want = Counter()
    for d, t in corpus:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for i, (a, n) in enumerate(packing.pieces(len(ids), size)):
            want[d, i, a, n, zlib.crc32(ids[a:a + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // size) + 2
    assert packing.pack_documents(make([(1, "x")]).where("false")).count() == 0


def test_pieces():
    assert packing.pieces(1, 8) == [(0, 1)] and packing.pieces(8, 8) == [(0, 8)] and packing.pieces(9, 8) == [(0, 1), (1, 8)]
    assert packing.pieces(16, 8) == [(0, 8), (8, 8)]


def test_genetic_algorithm_keeps_every_document():
    rng = random.Random(2)
    lens = [rng.randint(1, 99) for _ in range(400)]
    bins = packing.evolve(lens, 100, 1, [])
    fill, plain = np.bincount(bins, weights=lens), []
    packing.best_fit(plain, [], list(range(400)), lens, 100)
    assert len(bins) == 400 and fill.max() <= 100 and -(-sum(lens) // 100) <= len(fill) <= len(plain)
    better = packing.evolve(lens, 100, 2, [bins])
    assert better.max() <= bins.max()


# ------------------------------------------------------------- vectors
def vectors_with_groups(n=700, dense=150):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 16))
    x[:dense] = x[0] + 0.05 * rng.normal(size=(dense, 16))
    for i in range(dense, n, 5):
        x[i] = x[i - 1] * 2 + 0.2 * rng.normal(size=16)
    return x


def test_graph_finds_neighbours():
    x = vectors_with_groups()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x)
    g = Graph.load(x, g.dump())
    ids, _ = g.search(x.astype(np.float32), 48)
    near = np.argsort(-(x @ x.T), axis=1)[150:, :10]
    found = [len(set(a) & set(b)) for a, b in zip(ids[150:].tolist(), near.tolist())]
    assert np.mean(found) > 9.5
    a, _ = embed_dedup.links_of(g, x, x, 8, 0.93)
    assert len(a) == (x @ x.T >= 0.93).sum(), "beams widen until they end below the threshold"


def test_embeddings(spark, monkeypatch):
    x = vectors_with_groups(400, 60)
    rows = [(i, x[i].tolist(), i % 2) for i in range(400)]
    rows += [(500, x[0].tolist(), 0), (501, x[0].tolist(), 0), (502, x[0].tolist(), None), (503, None, 0),
             (504, [0.0] * 16, 0), (505, [float("nan")] + [1.0] * 15, 0), (506, [None] + [1.0] * 15, 0), (507, [], 0),
             (508, x[0].tolist()[:8], 0), (None, x[1].tolist(), 1), (500, x[0].tolist(), 0), (509, [float("inf")] * 16, 0)]
    monkeypatch.setattr(embed_dedup, "SHARD", 1024)
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "vec_id long, embedding array<double>, label int, rid string, raw string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.embedding_dedup(df).collect()), key=repr)

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        return np.array(v) / np.linalg.norm(v)
    units, parent = [unit(r[1]) for r in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if (a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] is not None
                    and a @ b >= 0.93):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    want = sorted(((rows[i][0], links[i], min((v for v in groups[find(i)] if v is not None), default=None))
                   for i in range(len(rows))), key=repr)
    assert got == want
    assert embed_dedup.embedding_dedup(df.where("false")).count() == 0


# ------------------------------------------------------------- mixing
def test_raking_meets_all_marginals(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", rng.randint(1, 500))
                                   for i in range(5) for j in range(3) for k in range(2)],
                                  "source string, lang string, topic string, n long")
    targets = {"source": spark.createDataFrame([(f"s{i}", float(i + 1)) for i in range(6)], "source string, target double"),
               "lang": spark.createDataFrame([("l0", 1.0), ("l1", 1.0), ("l2", 2.0)], "lang string, target double"),
               "topic": spark.createDataFrame([("t0", 3.0), ("t1", 1.0)], "topic string, target double")}
    rows = mixing.rake(Scratch(spark, "t"), cells, targets).collect()
    total = sum(r.n for r in rows)
    for dim, shares in (("source", {f"s{i}": (i + 1) / 15 for i in range(5)}), ("lang", {"l0": .25, "l1": .25, "l2": .5}),
                        ("topic", {"t0": .75, "t1": .25})):
        for value, share in shares.items():
            assert abs(sum(r.w for r in rows if r[dim] == value) / total - share) < 1e-6
    fitted = spark.createDataFrame(rows)
    rates = mixing.calibrate(fitted, 0.4).collect()
    assert abs(sum(r.n * r.probability for r in rates) / total - 0.4) < 1e-9
    assert max(r.probability for r in rates) <= 1


def test_mix(spark, make, corpus):
    docs = make(corpus)
    out = mixing.mix(docs, share=0.5)
    rows = out.collect()
    assert len(rows) == len(corpus) and set(docs.columns) <= set(out.columns)
    assert all(r.kept is not None and 0 <= r.probability <= 1 for r in rows)
    assert {r.n_tokens for r in rows if not (r.text or "").strip(" \t\n")} == {0}
    assert {r.text: r.n_tokens for r in rows}["ONE two three"] == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert mixing.mix(docs.where("false")).count() == 0
    null = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source")
    assert mixing.mix(null).count() == len(corpus)


def shard_with_links(n=3000, d=32):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(n, d))
    unit[1::30] = unit[::30] + 0.25 * rng.normal(size=unit[::30].shape)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def test_walked_graph_finds_the_links_of_a_large_shard():
    unit = shard_with_links()
    graph, queries = Graph.build(unit), unit[::3]
    width = embed_dedup.audited_width(graph, unit, queries, 0.93, 0.99)
    assert width < len(unit) / 8, "a beam, not the shard"
    x, y = embed_dedup.links_of(graph, unit, queries, width, 0.93)
    want = {(i, j) for i, j in zip(*np.nonzero(queries @ unit.T >= 0.93)) if i * 3 != j}
    got = {(i, j) for i, j in zip(x, y) if i * 3 != j}
    assert len(want) > 60 and got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("missed", ["links off the spread sample", "one of fourteen nearest"])
def test_audit_widens_a_beam_that_misses(missed):
    unit = shard_with_links()

    class Narrow(Graph):
        def search(self, queries, width):
            sim = queries @ self.vectors.T
            if width < 96 and missed.startswith("links"):
                sim[(sim >= 0.92) & (sim < 0.9999)] = -1
            order = np.argsort(-sim, axis=1, kind="stable")[:, :width]
            if width < 96 and missed.startswith("one"):
                order[:, 1:10].flat[::13] = order[0, -1]
            return order, np.take_along_axis(sim, order, 1)

    sim = unit @ unit.T
    linked = ((sim >= 0.92) & (sim < 0.9999)).any(axis=1)
    queries = unit[~linked]
    if missed.startswith("links"):  # none of them where the spread sample looks
        spread = np.linspace(0, len(unit) - 1, embed_dedup.AUDIT).astype(int)
        queries, plain = np.empty_like(unit), unit[~linked]
        queries[spread] = plain[:len(spread)]
        queries[np.delete(np.arange(len(unit)), spread)] = np.concatenate([plain[len(spread):], unit[linked]])
    assert embed_dedup.audited_width(Narrow(unit.astype(np.float32)), unit, queries, 0.93, 0.99) >= 96
