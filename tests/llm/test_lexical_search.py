"""Operator 11 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codeweave.llm import lexical_search as ls
from codeweave.llm import queries

from .conftest import SF_SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    total, df = sum(n for _, _, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, n in bags:
            m = 25 + 75 * n * len(bags) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def asked(corpus, words):
    rng = random.Random(1)
    pool = " ".join(t or "" for _, t in corpus).split()
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for i in range(30)]
    return items + [(100, None), (101, ""), (102, "no-such-term-anywhere"), (103, items[3][1]), (103, items[3][1]),
                    (None, "one Two two"), (104, "a " * 50 + "é")]


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in items],
                                 "item_id long, text string, qid string, rank string, score string")


@pytest.mark.parametrize("segment,block", [(1 << 25, 4096), (2000, 5)])
def test_search(spark, make, corpus, asked, segment, block):
    got = ls.search(make(corpus), items_table(spark, asked), 10, segment, block)
    assert found(got) == brute(corpus, asked)


def test_few_documents_ties_and_nothing(spark, make, asked):
    rows = [(i, "same words here") for i in range(20)] + [(None, "same words here"), (5, "same words here"), (50, "other")]
    items = [(1, "same"), (2, "OTHER, other"), (3, "none")]
    assert found(ls.search(make(rows), items_table(spark, items))) == brute(rows, items)
    assert ls.search(make([]), items_table(spark, asked)).count() == 0
    assert ls.search(make(rows), items_table(spark, [])).count() == 0
    assert ls.search(make([(1, None), (2, " .. ")]), items_table(spark, asked)).count() == 0


def test_reading_stops_early_and_finds_the_best():
    rng = np.random.default_rng(2)
    n, read = 5000, []
    for trial in range(20):
        lists, total = [], np.zeros(n, dtype=np.int64)
        for _ in range(rng.integers(1, 6)):
            docs = np.sort(rng.choice(n, rng.integers(1, n), replace=False))
            impact = np.sort(rng.zipf(1.5, len(docs)).clip(max=10**6))[rng.permutation(len(docs))]
            order, weight = np.argsort(-impact, kind="stable"), int(rng.integers(1, 9))
            total[docs] += weight * impact
            lists.append((docs, impact, docs[order], impact[order], weight))
        seen = np.zeros(n, dtype=bool)
        docs, scores = ls.best_positions(lists, seen, 10)
        assert not seen.any() and (scores == total[docs]).all() and len(set(docs.tolist())) == len(docs)
        kth = np.sort(total)[-10]
        assert set(np.flatnonzero(total >= max(kth, 1)).tolist()) <= set(docs.tolist()), "all documents at the k-th score"
        read.append(len(docs) / max(1, (total > 0).sum()))
    assert np.median(read) < 0.8, "thresholds stop reading"


def test_query_is_the_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = con.execute(queries.OP11_SQL).fetchall()
    assert found(queries.op11_lexical_search(spark, SF_SMALL)) == sorted(want, key=repr)
