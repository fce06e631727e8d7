"""Operators 2, 3, 8 and 9 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeweave.llm import exact_dedup, near_dedup, substring_dedup, suffix_dedup
from codeweave.llm import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_positions_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 10_000), (3000, 3_000_000), (1000, 1000)):
        pos = np.sort(rng.choice(top, n, replace=False)).astype(np.int64)
        assert (common.unpack_positions(common.pack_positions(pos)) == pos).all()


def test_word_hashes_follow_words():
    texts = [b"Ab ab\tab\x0bAb \n", b"", b"ab", "é ab é".encode()]
    w = common.Words(texts, lower=False)
    found = [w.data[a:b] for a, b in zip(w.start, w.end)]
    assert found == [x for t in texts for x in WORD.findall(t)]
    assert len(set(w.hash.tolist())) == len(set(found))
    assert w.count.tolist() == [4, 0, 1, 3]


def test_exact(make, corpus):
    norm = [(d, re.sub("[\x20\x09-\x0D]+", " ", t or "")) for d, t in corpus]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    got = exact_dedup.exact_dedup(make(corpus))
    least = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = sorted(((d, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm), key=repr)
    assert by_row(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_chunks_make_up_the_text(words):
    text = " ".join(words(20_000, 3)).encode()
    parts = exact_dedup.cut(text)
    assert b"".join(parts) == text and len(parts) > 3
    assert all(exact_dedup.MIN_CHUNK <= len(p) <= exact_dedup.MAX_CHUNK for p in parts[:-1])
    assert set(parts[3:]) & set(exact_dedup.cut(b"changed " + text)), "cuts follow the content"


def shingles(text, n):
    w = WORD.findall((text or "").encode().translate(common.LOWER_TABLE))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [near_dedup.TILE, 3])
def test_near(make, corpus, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    got = near_dedup.near_dedup(make(corpus), shingle=4, percent=80)
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_components(corpus, 4, 80)


def test_near_finds_links_that_the_smallest_member_does_not_have(make, words):
    """A group around a base text whose copies differ more from each other."""
    base = words(120, "base")
    rows = []
    for i in range(40):
        text = list(base)
        for k in range(i % 5):
            text[(7 * i + 23 * k) % len(text)] = f"new{i}x{k}"
        rows.append((i, " ".join(text)))
    rows = rows[::-1]
    got = near_dedup.near_dedup(make(rows), shingle=5, percent=80)
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, 5, 80)


def test_drop_stages_keep_one_row_of_each_group(make, corpus):
    rows = make(corpus)
    exact = exact_dedup.drop_exact(rows)
    assert exact.columns == [c for c in rows.columns if c != "_rid"]
    assert exact.count() == len({re.sub("[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus})
    components = {(c, n > 0) for _, n, c in brute_components(corpus, 5, 80)}
    near = near_dedup.drop_near(rows)
    empty = sum(not WORD.findall((t or "").encode()) for _, t in corpus)
    assert near.count() == sum(full for _, full in components) + empty


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    near, far = np.r_[a[:900], a[:1] + np.arange(1, 101, dtype=np.uint64)], rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    sketch = [near_dedup.odd_sketch(near_dedup.minhash(x)) for x in (a, near, far)]
    count = [int(np.bitwise_count(sketch[0] ^ s).sum()) for s in sketch]
    assert count[0] == 0 and count[1] < near_dedup.sketch_limit(0.8) < count[2]


def brute_substring(rows, size):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g),
                    sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [35, 5])
def test_substring(make, corpus, size):
    got = substring_dedup.substring_dedup(make(corpus), size)
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text), len(r.spans)) for r in got.collect()), key=repr)
    assert rows == brute_substring(corpus, size)


def brute_suffix(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - size + 1):
            if count[t[i:i + size]] > 1:
                gone[i:i + size] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,step", [(400, suffix_dedup.STEP), (383, 700)])
def test_suffix(make, corpus, monkeypatch, size, step):
    """Also with long texts in many pieces, in this process: tasks import their own."""
    rows = [(d, t if t is None or len(t) < 20_000 else t[:20_000]) for d, t in corpus]
    got = suffix_dedup.suffix_dedup(make(rows), size)
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got.collect()), key=repr)
    assert out == brute_suffix(rows, size)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    text = b"".join(bytes([97 + i % 7 + i // 900]) for i in range(5000))
    places = np.concatenate([p.valid + p.shift[np.searchsorted(p.begin, p.valid, side="right") - 1]
                             for p in suffix_dedup.pieces([text], size)])
    assert (np.sort(places) == np.arange(len(text) - size + 1)).all()


def test_empty_tables(make, spark):
    none = make([(1, "x")]).where("false")
    for run in (exact_dedup.exact_dedup, near_dedup.near_dedup, substring_dedup.substring_dedup,
                suffix_dedup.suffix_dedup):
        assert run(none).count() == 0


def test_components(spark):
    from codeweave.llm.common import Scratch, components
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60), (7, 3)] + [(100, 101 + i) for i in range(50)]
    got = {r.node: r.comp for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert all(got[i] == 0 for i in range(31)) and got[50] == got[41] == 40 and all(got[101 + i] == 100 for i in range(50))
