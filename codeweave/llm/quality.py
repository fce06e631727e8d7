"""Operator 1: quality classifier on random-indexing word vectors.

Every word has a ternary index vector drawn from a hash of the word and of its
shape (runs of upper case, lower case, digits and other characters).  The
vector of a word is the sum of the index vectors of its neighbours, learned from
a bounded sample of labelled texts; words the sample does not hold take the
vector of their shape.  A document is pooled to the mean of its word vectors and
the mean products of the index vectors of words one and two apart (repetition
shows there).  A two-layer network (numpy) gives a logit, and a temperature
fitted on rows that the network did not learn from calibrates it to a
probability.

The sample is bounded by ``max_train`` labelled documents (smallest hashes of
their ids, so the same ones however the table is stored); only it meets the
driver, as pooled vectors and as the vectors of words that occur ``min_count``
times in it.  Scoring reads every text once, without a shuffle.

Cases: null and empty texts pool to zeros and get the score of that vector;
labels that are null or whose document is missing are not learned from; of
several labels of one document the smallest counts; without any label, or with
one class only, every score is the share of label 1 (0.5 without labels);
repeated rows are scored one by one, and of several texts of one id the
smallest is learned from; a null doc_id is scored and is never held
out; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import BYTE_POWERS, U64, Scratch, Words, mix64, prefix_sums, span_hashes, text_batches, trim

DIM = 32
BATCH = 1 << 19
#: Classes of bytes in a word's shape: A, a (with all bytes of other letters), 0, others as they are.
_CLASS = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
                   for b in range(256)], dtype=np.uint8)


def shapes(words: Words) -> np.ndarray:
    """Hash of every word's shape: its byte classes with runs squeezed."""
    raw = _CLASS[np.frombuffer(words.data, dtype=np.uint8)]
    new = np.r_[True, raw[1:] != raw[:-1]]
    new[words.start] = True
    place = np.cumsum(new) - 1
    prefix, down = prefix_sums(raw[new], BYTE_POWERS)
    first, last = place[words.start], place[words.end - 1]
    return mix64(mix64(span_hashes(prefix, down, first, last + 1)) + (last - first).astype(U64) + U64(1))


def ternary(hashes: np.ndarray) -> np.ndarray:
    """Index vectors: each of ``DIM`` components is a difference of two bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits[:, :DIM].astype(np.int8) - bits[:, DIM:].astype(np.int8)


def _apart(words: Words, k: int) -> np.ndarray:
    """Words whose k-th predecessor is in the same text."""
    text = np.repeat(np.arange(len(words.count)), words.count)
    return np.flatnonzero(text[k:] == text[:-k]) + k


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of word or shape, count, sum of neighbours' index vectors)."""
    words = Words(texts)
    if not len(words.start):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros((0, DIM))
    name, form = words.hash, shapes(words)
    v = (ternary(name) + ternary(form)).astype(np.float64)
    near = np.zeros_like(v)
    for k in (1, 2):
        at = _apart(words, k)
        near[at] += v[at - k]
        near[at - k] += v[at]
    keys = np.r_[name, form]
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    sums = np.add.reduceat(near[order % len(name)], start, axis=0)
    return keys[order][start], np.diff(np.r_[start, len(keys)]), sums


class Pooler:
    """Pools texts with the learned vectors: ``known`` sorted hashes of words
    and shapes, ``vectors`` one row each and a last row of zeros."""

    width = 3 * DIM + 1

    def __init__(self, known: np.ndarray, vectors: np.ndarray):
        self.known, self.vectors = known, vectors

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at, len(self.known)) if len(self.known) else at

    def pool(self, texts: list[bytes]) -> np.ndarray:
        out, words = np.zeros((len(texts), self.width)), Words(texts)
        count = words.count
        some = np.flatnonzero(count)
        if not len(some):
            return out
        row = self._find(words.hash)
        miss = np.flatnonzero(row == len(self.known))
        row[miss] = self._find(shapes(words)[miss])
        begin = words.first[:-1][some]
        out[some, :DIM] = np.add.reduceat(self.vectors[row], begin, axis=0)
        v = ternary(words.hash)
        for k in (1, 2):
            at, product = _apart(words, k), np.zeros(v.shape, dtype=np.float32)
            product[at] = v[at] * v[at - k]
            out[some, k * DIM:(k + 1) * DIM] = np.add.reduceat(product, begin, axis=0)
        out[some, :-1] /= count[some, None]
        out[:, -1] = np.log1p(count) / 10
        return out


class Network:
    """Two layers, tanh and a logit; ``fit`` with Adam on standardised inputs."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = [rng.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden),
                  rng.normal(0, hidden ** -0.5, (hidden, 1)), np.zeros(1)]
        self.temperature, self.constant = 1.0, None

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1])
        return (h @ self.w[2] + self.w[3]).ravel()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3,
            decay: float = 1e-4, seed: int = 2) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, rng = (x - self.mean) / self.scale, np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            step = rate * (1 - epoch / epochs)
            for i in range(0, len(z), batch):
                part = order[i:i + batch]
                h = np.tanh(z[part] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -60, 60)))
                g = (p - y[part, None]) / len(part)
                gh = (g @ self.w[2].T) * (1 - h * h)
                grads = [z[part].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.w[k] -= step * (m[k] / (1 - 0.9 ** t) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
                                         + decay * self.w[k])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss."""
        if len(x):
            z, grid = self.logit(x), np.exp(np.linspace(-1.5, 2.0, 71))
            loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, min_count: int = 5):
    """(broadcast Pooler, Network) from labels that are not held out."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("id").isNotNull() & F.col("quality").isin(0, 1)).where(~held_out("id"))
             .groupBy("id").agg(F.min("quality").alias("quality"))
             .orderBy(F.xxhash64("id"), "id").limit(max_train))
    sample = scratch.store(
        docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(known), "id")  # max_train ids at most; of the texts of one id the smallest is learned
        .groupBy("id", "quality").agg(F.min("text").alias("text")), "sample")

    def learn(batches):
        for _, texts in text_batches(batches, 0, BATCH):
            keys, counts, sums = contexts(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64()),
                                              *(pa.array(sums[:, k]) for k in range(DIM))],
                                             names=["word", "n", *(f"v{k}" for k in range(DIM))])

    schema = "word long, n long, " + ", ".join(f"v{k} double" for k in range(DIM))
    words = (sample.select("text").mapInArrow(learn, schema).groupBy("word")
             .agg(F.sum("n").alias("n"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)))
             .where(F.col("n") >= min_count)).toArrow()
    raw = np.stack([words.column(f"v{k}").to_numpy() for k in range(DIM)], axis=1)
    raw = np.concatenate([raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9), np.zeros((1, DIM))])
    known = words.column("word").to_numpy().view(U64)
    order = np.argsort(known)
    # sums of whole numbers, so the vectors do not depend on the order of rows;
    # words of max_train texts that occur min_count times
    pooler = Pooler(known[order], raw[np.r_[order, len(order)]].astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(pooler)
    rows = sample.select("id", "quality", "text").mapInArrow(
        _pool_rows(shared), "id long, quality int, x array<double>").toArrow()
    network = Network(Pooler.width)
    if not rows.num_rows:
        network.constant = 0.5
        return shared, network
    rows = rows.sort_by("id")
    ids, y = rows.column("id").to_numpy(), rows.column("quality").to_numpy().astype(np.float64)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    if y.min() == y.max():
        network.constant = float(y[0])
        return shared, network
    check = (ids * 0x9E3779B1 >> 7) % 5 == 0
    if check.sum() < 20 or y[~check].min() == y[~check].max():
        check[:] = False
    network.fit(x[~check], y[~check])
    network.calibrate(x[check], y[check])
    scratch.drop("sample")
    del rows, words, x
    trim()
    return shared, network


def _pool_rows(shared):
    def run(batches):
        for batch, texts in text_batches(batches, 2, BATCH):
            x = shared.value.pool(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["id", "quality", "x"])
    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 12_000) -> DataFrame:
    """All rows and columns of ``docs`` with ``held_out, score, predicted``
    (columns of those names in ``docs`` are replaced)."""
    shared, network = fit(docs, labels, max_train)
    new = ("held_out", "score", "predicted")
    keep = [c for c in docs.columns if c not in new]
    src = docs.select(F.col("text").cast("binary").alias("t"), F.struct(*keep).alias("row"))
    schema = StructType().add("row", src.schema["row"].dataType).add("score", DoubleType())

    def run(batches):
        for batch, texts in text_batches(batches, 0, BATCH):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(network.score(shared.value.pool(texts)))], names=["row", "score"])

    return (src.mapInArrow(run, schema).select("row.*", "score")
            .withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int")))
