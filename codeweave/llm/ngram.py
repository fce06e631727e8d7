"""Operator 4: interpolated modified Kneser-Ney bigram model.

Counting is three exchanges of packed arrays, each pre-aggregated per batch:

1. words (64-bit hashes) with their counts; the buckets are ranges of the hash,
   so the sorted arrays of all buckets are one sorted vocabulary and a word's
   place in it is its number;
2. pairs (context, word) of word numbers with their counts; the buckets are
   ranges of contexts, and a context more frequent than ``HOT`` tokens is dealt
   over all buckets by pair;
3. the number of distinct contexts of each word.

Every bucket is stored once as a file of sorted arrays in the shared folder:
hashes and counts of words, per context the place of its sorted followers and
the sums that discounting needs, and the continuation counts.  Scoring tasks map
these files into memory and look up whole batches by binary search; only the
numbers of words per bucket and the counts of counts pass through the driver.

Model: P(w | c) = max(n(c,w) - D(n), 0) / n(c) + g(c) P1(w), where P1 discounts
continuation counts in the same way and interpolates with the uniform
distribution over the vocabulary and one unknown word; D1, D2, D3+ are the
modified Kneser-Ney discounts of each order.  A context without followers in
the training texts leaves P1.  A text starts in a context of its own and ends
with a token that is predicted.  The order is two: the arrays of a trigram model
of this input do not fit the disk that the task allows (README).

Cases: null and empty texts are the end token alone; without training texts all
probabilities are 1 over the number of words, one; a null doc_id is not held
out; repeated rows count and are scored each; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, Scratch, SharedFiles, Words, buckets_for, mix64, pack_positions, text_batches, text_bytes,
                     unpack_positions)

END = U64(0x2545F4914F6CDD1D)
HOT = 2_000_000
BATCH = 1 << 22


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text; first token of each text."""
    words = Words(texts, lower=True)
    count = words.count
    first = np.cumsum(count + 1) - (count + 1)
    out = np.full(int(count.sum()) + len(texts), END, dtype=U64)
    inside = np.ones(len(out), dtype=bool)
    inside[first + count] = False
    out[inside] = words.hash
    return out, first


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a hash: equal ranges of its high 32 bits."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


class Model:
    """Places and totals of the stored model; arrays are mapped when used."""

    def __init__(self, files: SharedFiles, n_buckets: int, hot_limit: int = HOT):
        self.files, self.n, self.hot_limit = files, n_buckets, hot_limit
        self.base = np.zeros(n_buckets + 1, dtype=np.int64)
        self.size = self.total = self.pairs = 0
        self.hot = np.zeros(0, dtype=np.int64)
        self.hot_stats = np.zeros((0, 4))
        self.discount, self.discount1, self.rest1 = (np.zeros(4), np.zeros(4), 1.0)

    # -------------------------------------------------------- vocabulary
    def vocabulary(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(self.base[b + 1] - self.base[b])
        raw = self.files.array(f"words-{b}", np.uint8)
        return raw[:8 * n].view(U64), raw[8 * n:16 * n].view(np.int64)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (-1: unknown) and training counts."""
        some, inverse = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(some), -1, dtype=np.int64), np.zeros(len(some), dtype=np.int64)
        cut = np.searchsorted(ranges(some, self.n), np.arange(self.n + 1))
        for b in np.flatnonzero(np.diff(cut)):
            if self.base[b] == self.base[b + 1]:
                continue
            keys, counts = self.vocabulary(b)
            part = some[cut[b]:cut[b + 1]]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            number[cut[b]:cut[b + 1]][hit] = self.base[b] + at[hit]
            count[cut[b]:cut[b + 1]][hit] = counts[at[hit]]
        return number[inverse], count[inverse]

    # -------------------------------------------------------- pairs
    def edges(self) -> np.ndarray:
        """First context number of each bucket (the start context is ``size``)."""
        return -(-np.arange(self.n + 1) * (self.size + 1) // self.n)

    def pair_bucket(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = context * self.n // (self.size + 1)
        if len(self.hot):
            hot = self.is_hot(context)
            out[hot] = (mix64((context[hot] << 32 | word[hot]).astype(U64)) % U64(self.n)).astype(np.int64)
        return out

    def is_hot(self, context: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, context)
        return (at < len(self.hot)) & (np.append(self.hot, -1)[np.minimum(at, len(self.hot))] == context)

    def pair_file(self, b: int):
        """Sorted contexts, place of their first follower (one more), followers,
        counts, and sums per context (n, and followers with count 1, 2, 3+)."""
        raw = self.files.array(f"pairs-{b}", np.uint8, bytes(24) + bytes(8))  # no file: no pairs
        n_ctx, n_pair, width = (int(x) or d for x, d in zip(raw[:24].view(np.int64), (0, 0, 1)))
        at, out = 24, []
        for kind, n in ((np.int64, n_ctx), (np.int64, n_ctx + 1), (np.int64, 4 * n_ctx), (np.uint32, n_pair),
                        (np.dtype(f"u{width}"), n_pair)):
            size = np.dtype(kind).itemsize * n
            out.append(raw[at:at + size].view(kind))
            at += size + -size % 8
        return out[0], out[1], out[3], out[4], out[2].reshape(-1, 4)

    def probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(word | context); -1 is an unknown context or word."""
        if not self.size:
            return np.ones(len(word))
        cont = np.zeros(len(word), dtype=np.int64)
        known = np.flatnonzero(word >= 0)
        edges = self.edges()
        order = known[np.argsort(word[known], kind="stable")]
        cut = np.searchsorted(word[order], edges)
        for b in np.flatnonzero(np.diff(cut)):
            part = order[cut[b]:cut[b + 1]]
            cont[part] = self.files.array(f"cont-{b}", np.uint32, bytes(4 * int(edges[b + 1] - edges[b])))[word[part] - edges[b]]
        low = np.maximum(cont - self.discount1[np.minimum(cont, 3)], 0) / max(self.pairs, 1) \
            + self.rest1 / (self.size + 1)
        number, stats = np.zeros(len(word), dtype=np.int64), np.zeros((len(word), 4))
        ask = np.flatnonzero(context >= 0)
        bucket = np.full(len(word), -1)
        # followers of unknown words are not stored, but the context's sums are needed for them, too
        bucket[ask] = self.pair_bucket(context[ask], np.maximum(word[ask], 0))
        order = ask[np.lexsort((word[ask], context[ask], bucket[ask]))]
        cut = np.searchsorted(bucket[order], np.arange(self.n + 1))
        for b in np.flatnonzero(np.diff(cut)):
            part = order[cut[b]:cut[b + 1]]
            ctx, first, follower, count, sums = self.pair_file(b)
            if not len(ctx):
                continue
            at = np.minimum(np.searchsorted(ctx, context[part]), len(ctx) - 1)
            hit = ctx[at] == context[part]
            part, at = part[hit], at[hit]
            stats[part] = sums[at]
            lo, hi, w = first[at].copy(), first[at + 1].copy(), word[part]
            end = hi.copy()
            while (lo < hi).any():  # binary search of all followers at once
                mid = (lo + hi) >> 1
                less = (follower[np.minimum(mid, len(follower) - 1)] < w) & (lo < hi)
                hi = np.where(less | (lo >= hi), hi, mid)
                lo = np.where(less, mid + 1, lo)
            found = (lo < end) & (w >= 0)
            found[found] = follower[lo[found]] == w[found]
            number[part[found]] = count[lo[found]]
        if len(self.hot):
            hot = np.flatnonzero(self.is_hot(context))
            stats[hot] = self.hot_stats[np.searchsorted(self.hot, context[hot])]
        n = stats[:, 0]
        rest = stats[:, 1:] @ self.discount[1:]
        high = np.maximum(number - self.discount[np.minimum(number, 3)], 0)
        return np.where(n > 0, (high + rest * low) / np.maximum(n, 1), low)


def discounts(t: np.ndarray) -> np.ndarray:
    """D0 to D3+ from the numbers of entries with count 1, 2, 3 and 4."""
    t = np.asarray(t, dtype=float)
    if not t[0] or not t[1]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y, out = t[0] / (t[0] + 2 * t[1]), [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else float(k) / 2
        out.append(min(max(d, 0.05), float(k)))
    return np.array(out)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=int)
    return keys[start], np.add.reduceat(counts[order].astype(np.int64), start) if len(keys) else counts


def count_words(texts: DataFrame, model: Model) -> DataFrame:
    """Stores the vocabulary; ``bucket, n, total``."""
    def count(batches):
        for _, raw in text_batches(batches, 0, BATCH):
            keys, counts = np.unique(token_hashes(raw)[0], return_counts=True)
            cut = np.searchsorted(ranges(keys, model.n), np.arange(model.n + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()),
                 pa.array([keys[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
                 pa.array([counts[cut[b]:cut[b + 1]].astype(np.uint32).tobytes() for b in some], pa.binary())],
                names=["bucket", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _merge([np.frombuffer(x, dtype=U64) for x in table.column("keys").to_pylist()],
                              [np.frombuffer(x, dtype=np.uint32) for x in table.column("counts").to_pylist()])
        b = table.column("bucket")[0].as_py()
        model.files.put(f"words-{b}", [keys.tobytes(), counts.tobytes()])
        hot = np.flatnonzero(counts >= model.hot_limit)
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(keys)], pa.int64()),
                         "total": pa.array([int(counts.sum())], pa.int64()),
                         "hot": pa.array([hot.tolist()], pa.list_(pa.int64()))})

    return (texts.mapInArrow(count, "bucket int, keys binary, counts binary")
            .groupBy("bucket").applyInArrow(merge, "bucket int, n long, total long, hot array<long>"))


def contexts_of(number: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    out = np.empty(len(number), dtype=np.int64)
    out[1:] = number[:-1]
    out[first] = start
    return out


def count_pairs(texts: DataFrame, model: Model) -> DataFrame:
    """Stores the followers of contexts; rows ``kind, bucket, ids, counts``:
    continuation counts by bucket of the word (kind 0), counts of counts
    (kind 1) and sums of hot contexts (kind 2)."""
    edges = model.edges()

    def count(batches):
        for _, raw in text_batches(batches, 0, BATCH):
            hashes, first = token_hashes(raw)
            word, _ = model.numbers(hashes)
            pair, counts = np.unique(contexts_of(word, first, model.size) << 32 | word, return_counts=True)
            ctx, word = pair >> 32, pair & 0xFFFFFFFF
            hot = model.is_hot(ctx)
            slot = model.pair_bucket(ctx, word) * 2 + hot
            order = np.argsort(slot, kind="stable")
            cut = np.searchsorted(slot[order], np.arange(2 * model.n + 1))
            parts = [(k, order[cut[k]:cut[k + 1]]) for k in np.flatnonzero(np.diff(cut)).tolist()]
            # contexts of a bucket are close together; hot ones are not, and few
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // 2 for k, _ in parts], pa.int32()), pa.array([k % 2 == 1 for k, _ in parts]),
                 pa.array([ctx[p].tobytes() if k % 2 else pack_positions(ctx[p] - edges[k // 2] + np.arange(len(p)))
                           for k, p in parts], pa.binary()),
                 pa.array([word[p].astype(np.uint32).tobytes() for _, p in parts], pa.binary()),
                 pa.array([counts[p].astype(np.uint32).tobytes() for _, p in parts], pa.binary())],
                names=["bucket", "hot", "ctx", "word", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        b, keys, counts = table.column("bucket")[0].as_py(), [], []
        for hot, c, w, n in zip(*(table.column(x).to_pylist() for x in ("hot", "ctx", "word", "counts"))):
            w = np.frombuffer(w, dtype=np.uint32).astype(np.int64)
            c = np.frombuffer(c, dtype=np.int64) if hot else unpack_positions(c) - np.arange(len(w)) + edges[b]
            keys.append(c << 32 | w)
            counts.append(np.frombuffer(n, dtype=np.uint32))
        keys, counts = _merge(keys, counts)
        ctx, word = keys >> 32, keys & 0xFFFFFFFF
        start = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        sums = np.stack([np.add.reduceat(x.astype(np.int64), start) for x in
                         (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
        width = 1 if counts.max() < 256 else 2 if counts.max() < 65536 else 4
        parts = [ctx[start].tobytes(), np.r_[start, len(ctx)].astype(np.int64).tobytes(), sums.tobytes(),
                 word.astype(np.uint32).tobytes(), counts.astype(f"u{width}").tobytes()]
        model.files.put(f"pairs-{b}", [np.array([len(start), len(ctx), width], dtype=np.int64).tobytes(),
                                       *(p + bytes(-len(p) % 8) for p in parts)])
        word, cont = np.unique(word, return_counts=True)
        cut = np.searchsorted(word, edges)
        rows = [(0, i, pack_positions(word[cut[i]:cut[i + 1]] - edges[i]),
                 cont[cut[i]:cut[i + 1]].astype(np.uint32).tobytes()) for i in np.flatnonzero(np.diff(cut)).tolist()]
        rows.append((1, b, None, np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), len(ctx)], np.int64).tobytes()))
        hot = model.is_hot(ctx[start])
        if hot.any():
            rows.append((2, b, ctx[start][hot].tobytes(), sums[hot].tobytes()))
        cols = list(zip(*rows))
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()),
                         "ids": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})

    return (texts.mapInArrow(count, "bucket int, hot boolean, ctx binary, word binary, counts binary")
            .groupBy("bucket").applyInArrow(merge, "kind int, bucket int, ids binary, counts binary"))


def count_contexts(found: DataFrame, model: Model) -> DataFrame:
    """Stores the continuation counts; counts of counts per bucket."""
    edges = model.edges()

    def merge(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        out = np.zeros(int(edges[b + 1] - edges[b]), dtype=np.uint32)
        for ids, counts in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist()):
            out[unpack_positions(ids)] += np.frombuffer(counts, dtype=np.uint32)
        model.files.put(f"cont-{b}", [out.tobytes()])
        return pa.table({f"t{k}": pa.array([int((out == k).sum() if k < 5 else (out > 2).sum())], pa.int64())
                         for k in range(1, 6)})

    return found.where("kind = 0").groupBy("bucket").applyInArrow(
        merge, ", ".join(f"t{k} long" for k in range(1, 6)))


def train(scratch: Scratch, texts: DataFrame, n_bytes: int, hot_limit: int = HOT) -> Model:
    """Model of ``texts (text)``."""
    model = Model(scratch.files("model"), buckets_for(n_bytes // 6), hot_limit)
    words = scratch.store(count_words(texts, model), "words").toArrow()  # one row per bucket
    sizes = np.zeros(model.n, dtype=np.int64)
    sizes[words.column("bucket").to_numpy()] = words.column("n").to_numpy()
    model.base = np.r_[0, np.cumsum(sizes)]
    model.size, model.total = int(model.base[-1]), int(words.column("total").to_numpy().sum())
    if not model.size:
        return model
    if model.size >= 1 << 31:  # a pair is one number of twice 32 bits
        raise ValueError(f"{model.size} distinct words: word numbers are 32 bits wide")
    hot = [model.base[b] + i for b, h in zip(words.column("bucket").to_pylist(), words.column("hot").to_pylist())
           for i in h]
    n_texts = texts.count()
    model.hot = np.array(sorted(hot) + ([model.size] if n_texts >= hot_limit else []), dtype=np.int64)
    pairs = scratch.store(count_pairs(texts, model), "pairs")
    t = np.sum([np.frombuffer(r[0], dtype=np.int64) for r in pairs.where("kind = 1").select("counts").collect()], axis=0)
    sums: dict[int, np.ndarray] = {}
    for r in pairs.where("kind = 2").select("ids", "counts").collect():  # hot contexts: total / hot_limit at most
        for c, s in zip(np.frombuffer(r[0], dtype=np.int64).tolist(), np.frombuffer(r[1], dtype=np.int64).reshape(-1, 4)):
            sums[c] = sums.get(c, 0) + s
    model.hot_stats = np.array([sums.get(c, np.zeros(4)) for c in model.hot.tolist()], dtype=float).reshape(-1, 4)
    model.pairs, model.discount = int(t[4]), discounts(t[:4])
    u = scratch.store(count_contexts(pairs, model), "contexts").agg(*(F.sum(f"t{k}") for k in range(1, 6))).first()
    model.discount1 = discounts(u[:4])
    model.rest1 = float((model.discount1[1:] * np.array([u[0], u[1], u[4]])).sum() / model.pairs)
    return model


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, hot_limit: int = HOT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity``, one row per row of ``docs (doc_id, text)``; texts whose
    crc32(doc_id) modulo 5 is not 1 train the model."""
    scratch = Scratch(docs.sparkSession, "ngram")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("binary").alias("text"))
    model = train(scratch, rows.where("not held_out").select("text"), text_bytes(rows), hot_limit)

    def run(batches):
        for batch, raw in text_batches(batches, 2, BATCH):
            hashes, first = token_hashes(raw)
            word, count = model.numbers(hashes)
            p = model.probabilities(contexts_of(word, first, model.size), word)
            size = np.diff(np.r_[first, len(hashes)])
            base = np.log10((count + 0.5) / (model.total + 0.5 * (model.size + 1)))
            total = np.add.reduceat(np.log10(p), first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()),
                 pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                 pa.array(np.full(len(first), model.total), pa.int64()), pa.array(np.add.reduceat(base, first)),
                 pa.array(total), pa.array(10 ** np.minimum(-total / size, 300))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double, perplexity double")
