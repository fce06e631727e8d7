"""Operator 12 against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from codeweave.llm import periodic_runs as pr
from codeweave.llm import queries

from .conftest import SF_SMALL


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                out.setdefault((start, i + q), q)  # smallest period first
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, n, tuple(runs), hashlib.sha256(kept).hexdigest()


def found(df):
    return sorted(((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed_sha256)
                   for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(7), []
    for i in range(150):
        words = []
        while len(words) < rng.choice([5, 30, 200, 900]):
            kind = rng.random()
            unit = [rng.choice("abcdefgh"[:rng.choice([1, 2, 8])]) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40, 70]))]
            if kind < 0.5:
                words += unit * rng.randint(1, 6) + unit[:rng.randint(0, len(unit))]
            elif kind < 0.7:
                words += (unit * 3 + [rng.choice("xyz")]) * rng.randint(1, 4)
            else:
                words += [rng.choice("ab") for _ in range(rng.randint(1, 50))]
        out.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    return out + [(200, " ".join(fibonacci[-1])), (201, " ".join(thue * 4)), (202, "a " * 3000), (203, "a b " * 1500),
                  (204, ("a " * 30 + "b ") * 60), (205, None), (206, ""), (207, " \n"), (208, "a " * 23), (209, "a " * 24),
                  (None, "a " * 30), (210, "é " * 30 + "e\x85e " * 30)]


@pytest.mark.parametrize("tile", [pr.TILE, 300])
def test_runs(make, texts, tile):
    got = pr.periodic_runs(make(texts), plant=False, tile=tile)
    assert found(got) == sorted((brute(d, t, False) for d, t in texts), key=repr)


def test_planted_repeated_rows_and_best(make, corpus):
    corpus = [(d, t) for d, t in corpus if d != 900]
    got = pr.periodic_runs(make(corpus), plant=True, tile=100)
    assert found(got) == sorted((brute(d, t, True) for d, t in corpus), key=repr)
    for r in got.collect():
        runs = [(-x.length / x.period, x.start, x.period) for x in r.runs]
        assert (r.best is None) == (not runs)
        assert not runs or (r.best.start, r.best.period) == min(runs)[1:]
    assert pr.periodic_runs(make([])).count() == 0


def test_tiles_cover_all_intervals():
    for n in (30, 100, 5000, 100_000):
        for tile in (64, 300, 8192):
            rows = pr.tiles(n, tile)
            for q in pr.octaves(n):
                mine = [(a, b) for low, high, a, b in rows if low <= q <= high]
                assert mine[0][0] == 0 and mine[-1][1] == n
                assert all(b0 - a1 >= 6 * max(q, 8) for (_, b0), (a1, _) in zip(mine, mine[1:]))


def test_hash_collisions_do_not_count(monkeypatch):
    monkeypatch.setattr(pr, "mix64", lambda x: x % np.uint64(2))  # numbers of one parity share a hash
    rng = np.random.default_rng(1)
    for _ in range(30):
        ids = rng.integers(0, 4, 200)
        ids[50:140] = np.tile(ids[50:60], 9)
        got = pr.solve(ids, np.array([0, 200]), pr.octaves(200))
        spans = {}
        for _, q, s, e in got.tolist():
            if e + q - s >= max(24, 3 * q):
                spans[s, e + q] = min(q, spans.get((s, e + q), q))
        assert sorted((s, e - s, q) for (s, e), q in spans.items()) == brute_runs(ids.tolist())


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("length(text) < 9000").collect()}
    for r in queries.op12_periodic_runs(spark, SF_SMALL).collect():
        if r.doc_id not in docs:
            continue
        _, _, runs, collapsed = brute(r.doc_id, docs[r.doc_id], True)
        assert r.collapsed_sha256 == collapsed and r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        if runs:
            assert r.exponent_milli == 1000 * r.length // r.period
