"""Vector operators: K1-K7, D14, D15, B8, B9, B13, I10.

Embedding (K1/K2) is an inference stage: a user function from a batch of
texts to a batch of vectors, applied with ``mapInPandas`` on Arrow batches
(the remote model of the original).  The built-in offline default hashes
lower-cased word tokens into ``dim`` buckets (md5 prefix modulo dim) and L2
normalises the counts; a JVM-only Spark ML variant (HashingTF) is provided
for LSH.

Search (D15 + K4 + K5 + G2): vectors stay in their stored partitions; tasks map the
matrix of a project's questions into memory, one numpy product per batch, and only a
question's top-k of a task leaves it; the final top-k is a ``row_number`` filter over
these few rows.  ``LshIndex`` (K6) is the approximate form, with exact search for
questions that it is not sure of.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import (EMBEDDING_BATCH_SIZE, EMBEDDING_DIM, TOP_K_DEFAULT, TOP_K_MAX,
                                   TOP_K_MIN)
from ..functions.text import py_strip
from ..sources.store import SharedTables, materialize, scratch_path, spread

_TOKEN = re.compile(r"[a-z0-9_]+")

# questions in one pass over the vectors
QUESTIONS = 65_536
# values of a project's vectors that are scored together
BLOCK = 1 << 21


class _Buckets(dict):
    """Bucket of each token met so far."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        b = self[token] = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % self.dim
        return b

    def __reduce__(self):
        return _Buckets, (self.dim,)


class HashedTokenEmbedder:
    """Deterministic offline embedder: token -> md5 prefix -> bucket.  A task remembers up
    to ``most`` tokens from batch to batch."""

    def __init__(self, dim: int = EMBEDDING_DIM, most: int = 200_000):
        self.dim = dim
        self.most = most
        self.buckets = _Buckets(dim)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.buckets) > self.most:
            self.buckets.clear()
        bucket = self.buckets.__getitem__
        out = []
        for t in texts:
            v = np.bincount([*map(bucket, _TOKEN.findall((t or "").lower()))], minlength=self.dim).astype(np.float64)
            n = np.sqrt((v * v).sum())
            out.append(v / n if n > 0 else v)
        return out


def embed(df: DataFrame, text_col: str, fn: Callable[[list[str]], list] | None = None,
          dim: int = EMBEDDING_DIM, batch_size: int = EMBEDDING_BATCH_SIZE,
          out_col: str = "embedding", by: tuple[str, ...] = (), text=None) -> DataFrame:
    """K1/K2: add ``embedding ARRAY<DOUBLE>`` computed by ``fn`` over batches
    of ``batch_size`` texts (order inside a batch kept); a task holds the vectors of
    one such batch.  Only ``text_col`` and the other columns of ``df`` cross into
    Python; select narrowly before calling.  ``by``: rows near in this order are kept
    together.  ``text``: a text that other columns make is put together where it is read,
    after the rows are dealt, and does not come back."""
    fn = fn or HashedTokenEmbedder(dim)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    kept = len(df.columns)
    at = df.columns.index(text_col) if text is None else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, batch_size):
                part = batch.slice(i, batch_size)
                vecs = [np.asarray(v, dtype=np.float64) for v in fn(part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(vecs, pa.list_(pa.float64()))], names=schema.names)

    dealt = spread(df, *by)
    return (dealt if text is None else dealt.withColumn(text_col, text)).mapInArrow(run, schema)


def embed_hashing_tf(df: DataFrame, text_col: str, dim: int = EMBEDDING_DIM,
                     out_col: str = "embedding") -> DataFrame:
    """K1 on the JVM (Spark ML): RegexTokenizer -> HashingTF -> Normalizer,
    map-only; ``features`` kept as an ML vector for LSH."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[a-z0-9_]+", gaps=False)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    nm = Normalizer(inputCol="_tf", outputCol="features", p=2.0)
    out = nm.transform(tf.transform(tok.transform(df)))
    return out.withColumn(out_col, vector_to_array("features")).drop("_tok", "_tf")


def dimension_violations(vectors: DataFrame, dim: int, id_col: str = "id",
                         vec_col: str = "embedding") -> DataFrame:
    """K3: rows whose vector does not have ``dim`` entries."""
    return vectors.where(F.coalesce(F.size(vec_col), F.lit(-1)) != dim).select(
        id_col, F.size(vec_col).alias("actual_dim"), F.lit(dim).alias("expected_dim"))


def cosine(a, b) -> F.Column:
    """K4: cosine similarity of two arrays, in DOUBLE."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def score(sim) -> F.Column:
    """K5: round(max(0, similarity), 4)."""
    return F.round(F.greatest(F.lit(0.0), sim), 4)


def clamp_top_k(k) -> F.Column:
    """top_k defaults to 5 and is clamped to 1..20."""
    return F.greatest(F.lit(TOP_K_MIN), F.least(F.coalesce(k, F.lit(TOP_K_DEFAULT)), F.lit(TOP_K_MAX)))


def prepare_questions(questions: DataFrame) -> DataFrame:
    """Drop blank questions (they get zero results), strip, clamp top_k."""
    return (questions.withColumn("query", py_strip(F.col("question")))
            .where(F.col("query") != "")
            .withColumn("top_k", clamp_top_k(F.col("top_k"))))


def store_id(project_col, chunk_col) -> F.Column:
    """``project_id::chunk_id`` unless the chunk id already starts with
    the project id."""
    return F.when(chunk_col.startswith(project_col), chunk_col).otherwise(
        F.concat(project_col, F.lit("::"), chunk_col))


def vector_records(chunks: DataFrame) -> DataFrame:
    """A5 input + B8: flat records with defaults (NULL -> '' / 0)."""
    s = F.col
    return chunks.select(
        store_id(s("project_id"), s("chunk_id")).alias("id"), "project_id",
        s("content").alias("document"), "embedding",
        F.coalesce(s("file_path"), F.lit("")).alias("file_path"),
        F.coalesce(s("language"), F.lit("")).alias("language"),
        F.coalesce(s("chunk_type"), F.lit("function")).alias("chunk_type"),
        F.coalesce(s("name"), F.lit("")).alias("name"),
        F.coalesce(s("line"), F.lit(0)).cast("int").alias("line"),
        F.coalesce(s("end_line"), F.lit(0)).cast("int").alias("end_line"),
        F.coalesce(s("code"), F.lit("")).alias("code"),
        F.coalesce(s("summary"), F.lit("")).alias("summary"))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have ``dim`` values: their places and a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    good = np.flatnonzero(size == dim)
    values = column.take(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return good, values.reshape(len(good), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Best:
    """The best vectors of a project's questions so far, ``top_k`` of each."""

    def __init__(self, table: pa.Table, unit: bool):
        self.question = table.column("question_id")
        self.dim = len(table.column("qvec")[0])
        good, q = _matrix(table.column("qvec"), self.dim)
        self.at = good  # questions of another length match nothing
        self.q = q if unit else _unit(q)
        self.q32 = self.q.astype(np.float32)
        self.length = np.linalg.norm(self.q, axis=1)
        self.top_k = table.column("top_k").to_numpy()[good]
        self.k = max(1, int(self.top_k.max())) if len(good) else 1
        self.score = np.full((len(good), self.k), -1.0)  # best first; no vector has a negative score
        self.id = np.full((len(good), self.k), None, dtype=object)
        self.waiting: list[tuple] = []

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None = None) -> None:
        """Vectors wait until a block is full: small batches of many projects cost as little as large ones."""
        self.waiting.append((ids, x, codes))
        if sum(w[1].size for w in self.waiting) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.waiting or not len(self.at):
            self.waiting = []
            return
        ids, x, codes = (None if w[0] is None else np.concatenate(w) for w in zip(*self.waiting, strict=True))
        self.waiting = []
        order = np.argsort(ids, kind="stable")
        self.block(ids[order], x[order], None if codes is None else codes[order])

    def block(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None) -> None:
        """Rows in the order of their ids."""
        x32, longest = x.astype(np.float32), np.nan_to_num(np.linalg.norm(x, axis=1)).max(initial=0.0)
        rows, step = max(64, min(len(x), 4096)), max(1, (1 << 22) // max(64, min(len(x), 4096)))
        for a in range(0, len(x), rows):
            part, part32 = x[a:a + rows], x32[a:a + rows]
            for c in range(0, len(self.q), step):
                some = np.arange(c, min(c + step, len(self.q)))
                # a pass in single precision leaves what may be among the best, which is scored in double
                last = self.score[some, self.top_k[some] - 1]
                slack = 1e-4 + 2e-7 * self.dim * longest * self.length[some]  # rounding of scores and of single precision
                near = ~((part32 @ self.q32[some].T) < (last - slack).astype(np.float32))
                much = np.count_nonzero(near, axis=0) > 4 * self.k
                if much.any():
                    self.whole(ids[a:a + rows], part, some[much])
                    near[:, much] = False
                row, col = np.nonzero(near)
                self.pairs(ids[a:a + rows], part, some[col], row)

    def whole(self, ids: np.ndarray, x: np.ndarray, some: np.ndarray) -> None:
        """All rows for the questions ``some``."""
        n, k = len(x), min(self.k, len(x))
        # one number orders by score, then by id: equal scores keep the smaller ids
        score = np.floor(np.maximum(x @ self.q[some].T, 0.0) * 10_000 + 0.5)
        score = np.where(np.isfinite(score), score, -1).astype(np.int64)
        key = score * n + (n - 1 - np.arange(n))[:, None]
        key = np.partition(key, n - k, axis=0)[n - k:]
        col = np.broadcast_to(some, key.shape)
        self.merge(ids, col.ravel(), (n - 1 - key % n).ravel(), (key // n / 10_000).ravel())

    def pairs(self, ids: np.ndarray, x: np.ndarray, col: np.ndarray, row: np.ndarray) -> None:
        """Questions ``col`` with rows ``row``."""
        step = max(1024, (1 << 22) // self.dim)
        score = np.zeros(len(col))
        for a in range(0, len(col), step):
            some = slice(a, a + step)
            score[some] = np.einsum("ij,ij->i", x[row[some]], self.q[col[some]])
        score = np.floor(np.maximum(score, 0.0) * 10_000 + 0.5) / 10_000
        self.merge(ids, col, row, np.where(np.isfinite(score), score, -1.0))

    def merge(self, ids: np.ndarray, col: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        place = self.top_k[col] - 1
        last = self.score[col, place]
        keep = score > last
        tie = np.flatnonzero(score == last)
        keep[tie] = ids[row[tie]] < self.id[col[tie], place[tie]]
        col, row, score = col[keep], row[keep], score[keep]
        if not len(col):
            return
        hit = np.unique(col)
        old = self.score[hit] >= 0
        q = np.concatenate([np.repeat(hit, self.k)[old.ravel()], col])
        s = np.concatenate([self.score[hit][old], score])
        i = np.concatenate([self.id[hit][old], ids[row]])
        order = np.lexsort((pd.factorize(i, sort=True)[0], -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < self.top_k[q]
        self.score[hit], self.id[hit] = -1.0, None
        self.score[q[keep], place[keep]], self.id[q[keep], place[keep]] = s[keep], i[keep]

    def rows(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        self.flush()
        q, place = np.nonzero(self.score >= 0)
        return self.question.take(pa.array(self.at[q])), self.id[q, place], self.score[q, place]


class _BestInCells(_Best):
    """The best of the vectors that share a cell with a question."""

    def __init__(self, table: pa.Table, unit: bool, cells: Callable[[np.ndarray, bool], np.ndarray]):
        super().__init__(table, unit)
        probes = cells(self.q, True)  # question, table of the index, probe
        self.probes = []
        for part in range(probes.shape[1]):
            code = probes[:, part].ravel()
            order = np.argsort(code, kind="stable")
            self.probes.append((code[order], order // probes.shape[2]))

    def block(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        rows = max(16, min(1024, (1 << 24) // max(1, len(self.q))))
        for a in range(0, len(x), rows):
            # a table of the block tells which pairs share a cell in any part: no list of pairs is sorted
            near = np.zeros((len(x[a:a + rows]), len(self.q)), dtype=bool)
            for part, (code, question) in enumerate(self.probes):
                mine = codes[a:a + rows, part]
                low, high = np.searchsorted(code, mine, "left"), np.searchsorted(code, mine, "right")
                n = high - low
                row = np.repeat(np.arange(len(mine)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                near[row, question[at]] = True
            row, col = np.nonzero(near)
            self.pairs(ids[a:a + rows], x[a:a + rows], col, row)


def _score_in_place(questions: DataFrame, vectors: DataFrame, qvec_col: str, vec_col: str, id_col: str,
                    unit_vectors: bool, most: int, code_col: str | None = None,
                    cells: Callable[[np.ndarray, bool], np.ndarray] | None = None) -> DataFrame:
    """(question_id, id, score): each question's best ``top_k`` of every task's vectors,
    with ``cells`` of those that share a cell (``code_col``) with it.

    The vectors stay where they are stored.  Questions are one Arrow file per project in the
    shared folder, ``most`` questions in a pass over the vectors; a task maps the files of
    the projects it meets and keeps top_k vectors per question, which is all that leaves it."""
    q = questions.select("question_id", "project_id", "top_k", F.col(qvec_col).cast("array<double>").alias("qvec"))
    passes = max(1, -(-q.count() // most))
    folder = SharedTables(scratch_path(q, "questions"))

    def name(project, turn) -> str:
        return f"{turn}-{hashlib.md5(repr(project).encode()).hexdigest()}.arrow"

    def put(table: pa.Table) -> pa.Table:
        folder.put(name(table.column("project_id")[0].as_py(), table.column("turn")[0].as_py()),
                   table.select(["question_id", "top_k", "qvec"]), "zstd")
        return pa.table({"n": pa.array([len(table)], pa.int64())})

    materialize(q.withColumn("turn", F.pmod(F.xxhash64("question_id"), F.lit(passes)))
                .groupBy("turn", "project_id").applyInArrow(put, "n long"), "questions-stored")
    schema = T.StructType([q.schema["question_id"], T.StructField(id_col, vectors.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType())])
    found = None
    for turn in range(passes):
        def best(batches, turn=turn):
            asked: dict = {}
            kinds = None
            for batch in batches:
                kinds = batch.schema.field(1).type
                projects = batch.column(0).to_pandas().to_numpy()
                ids = batch.column(1).to_pandas().to_numpy()
                for project in pd.unique(projects):
                    if project not in asked:
                        table = folder.get(name(project, turn))
                        asked[project] = (None if table is None else _Best(table, unit_vectors) if cells is None
                                          else _BestInCells(table, unit_vectors, cells))
                    if asked[project] is None:
                        continue
                    mine = np.flatnonzero(projects == project)
                    good, x = _matrix(batch.column(2).take(pa.array(mine)), asked[project].dim)
                    codes = None
                    if cells is not None:
                        codes = batch.column(3).take(pa.array(mine[good]))
                        codes = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(good), -1)
                    asked[project].add(ids[mine[good]], x if unit_vectors else _unit(x), codes)
            for b in asked.values():
                if b is not None:
                    question, found_ids, score = b.rows()
                    for part in pa.table({"question_id": question, id_col: pa.array(found_ids, kinds),
                                          "score": pa.array(score)}).to_batches():
                        yield part

        part = vectors.select("project_id", id_col, vec_col, *([code_col] if code_col else [])).mapInArrow(best, schema)
        found = part if found is None else found.unionAll(part)
    return found


def search(questions: DataFrame, vectors: DataFrame, qvec_col: str = "qvec",
           vec_col: str = "embedding", id_col: str = "id", unit_vectors: bool = True,
           extra_cols: list[str] | None = None, most: int = QUESTIONS) -> DataFrame:
    """K7 core: top-k vectors of the question's project for every question.

    questions: (question_id, project_id, top_k, qvec); vectors: (project_id,
    id, embedding, ...).  Returns question_id, rank, id, score (+ extra, fetched
    for the winners only).  The questions are read twice: store them first if
    a model makes their vectors.  Vectors that are null or of another length than a
    project's questions match nothing."""
    scored = _score_in_place(questions, vectors, qvec_col, vec_col, id_col, unit_vectors, most)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.col(id_col))
    ranked = (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_K_MAX)
              .join(questions.select("question_id", "project_id", F.col("top_k").alias("_k")), "question_id")
              .where(F.col("rank") <= F.col("_k")).drop("_k"))
    if extra_cols:
        ranked = ranked.join(vectors.select("project_id", id_col, *(c for c in extra_cols if c != "project_id")), ["project_id", id_col])
    return ranked.select("question_id", id_col, *(extra_cols or []), "score", "rank")


def search_results(hits: DataFrame) -> DataFrame:
    """Result projection; '' / 0 metadata become NULL."""
    return hits.select(
        "question_id", "rank", F.col("id").alias("chunk_id"), "file_path", "chunk_type", "name", "code",
        F.nullif(F.col("summary"), F.lit("")).alias("summary"),
        F.nullif(F.col("line"), F.lit(0)).alias("line"),
        F.nullif(F.col("end_line"), F.lit(0)).alias("end_line"), "score")


class LshIndex:
    """K6: a stored index of unit vectors, random projections cut into buckets.

    A table of the index has ``hashes`` projections; the code of a vector is the list of
    its cells ``floor((v . a + b) / width)``, and the project is part of the key.  The
    width is ``wide`` times a low quantile of the distances to the nearest other vector in
    a bounded sample (``sample`` vectors), so that cells stay small and a question with
    near neighbours finds them; questions without are searched exactly.  Where the cells of
    so few projections would hand a question more than ``candidates`` vectors (judged on the
    sample), a table has more projections, up to 16, and where these are not enough the cells
    are narrower: questions times vectors are never met in pairs.  ``cells``: (project_id, id,
    v, codes), stored; ``postings``: the same by cell, (project_id, part, code, id)."""

    def __init__(self, vectors: DataFrame, tables: int = 16, hashes: int = 4, wide: float = 5.0, quantile: float = 0.1,
                 sample: int = 2000, seed: int = 7, vec_col: str = "embedding", id_col: str = "id", candidates: int = 1000):
        self.vectors = vectors.select("project_id", F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        given = self.vectors.where("v IS NOT NULL AND size(v) > 0")
        some = given.orderBy(F.xxhash64("project_id", "id")).limit(sample).toArrow()
        dim = len(some.column("v")[0]) if len(some) else 1
        x = _unit(_matrix(some.column("v"), dim)[1]) if len(some) else np.zeros((0, 1))
        near = np.sqrt(np.maximum(2 - 2 * (x @ x.T - 3 * np.eye(len(x))).max(axis=1), 0)) if len(x) > 1 else np.ones(1)
        near = near[near > 1e-3] if (near > 1e-3).any() else np.ones(1)
        self.dim, self.tables, self.hashes, self.width = dim, tables, hashes, wide * float(np.quantile(near, quantile))
        largest = given.groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
        least = self.width / 16  # copies of one vector share every cell, however narrow
        while True:
            rng = np.random.default_rng(seed)
            self.axes = rng.normal(size=(dim, tables * self.hashes))
            self.shift = rng.random(tables * self.hashes) * self.width
            if len(x) < 2 or self._met(x[:400]) * largest <= candidates or self.width <= least:
                break
            if self.hashes < 16:
                self.hashes += 1
            else:
                self.width *= 0.8
        kind = self.vectors.schema
        self.cells = materialize(self._coded(T.StructType([kind["project_id"], kind["id"], kind["v"], T.StructField(
            "codes", T.ArrayType(T.LongType()))])), "lsh")
        self.postings = self.cells.select("project_id", F.posexplode("codes").alias("part", "code"), "id")

    def _met(self, x: np.ndarray) -> float:
        """Share of the other vectors of a sample that a vector's probes meet."""
        own, probes = self.code(x, False)[:, :, 0], self.code(x, True)
        met = np.zeros((len(x), len(x)), dtype=bool)
        for part in range(self.tables):
            for probe in range(probes.shape[2]):
                met |= probes[:, part, probe, None] == own[None, :, part]
        np.fill_diagonal(met, False)
        return met.sum() / (len(x) * (len(x) - 1))

    def code(self, x: np.ndarray, probes: bool) -> np.ndarray:
        """Codes of unit vectors by table; with ``probes`` also of the neighbouring cells,
        one step along each projection."""
        hashes = self.hashes
        steps = np.concatenate([np.zeros((1, hashes)), np.eye(hashes), -np.eye(hashes)]) if probes else np.zeros((1, hashes))
        if x.shape[1] != self.dim:  # no vector of the index has this length
            return np.zeros((len(x), self.tables, len(steps)), dtype=np.int64)
        out = []
        for a in range(0, len(x), 1024):
            cells = np.floor((x[a:a + 1024] @ self.axes + self.shift) / self.width).reshape(-1, self.tables, 1, hashes) + steps
            code = np.zeros(cells.shape[:3], dtype=np.uint64)
            for h in range(hashes):
                code = (code ^ cells[..., h].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            out.append(code.view(np.int64))
        return np.concatenate(out) if out else np.zeros((0, self.tables, len(steps)), dtype=np.int64)

    def _cutter(self) -> Callable[[np.ndarray, bool], np.ndarray]:
        """``code`` for tasks, without the tables of this session."""
        alone = object.__new__(LshIndex)
        for name in ("dim", "tables", "hashes", "width", "axes", "shift"):
            setattr(alone, name, getattr(self, name))
        return alone.code

    def _coded(self, schema: T.StructType) -> DataFrame:
        dim, tables, cut = self.dim, self.tables, self._cutter()

        def run(batches):
            for batch in batches:
                good, x = _matrix(batch.column(2), dim)
                code, at = cut(_unit(x), False).reshape(-1), pa.array(good)
                ends = pa.array(np.arange(len(good) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(3)] + [
                    pa.ListArray.from_arrays(ends, pa.array(code))], names=schema.names)

        return self.vectors.mapInArrow(run, schema)

    def codes(self, rows: DataFrame, probes: bool) -> DataFrame:
        """(project_id, part, code, id) of ``rows (project_id, id, v)``; with ``probes`` also
        the neighbouring cells, one step along each projection."""
        schema = T.StructType([rows.schema["project_id"], T.StructField("part", T.IntegerType()),
                               T.StructField("code", T.LongType()), rows.schema["id"]])
        dim, tables, cut = self.dim, self.tables, self._cutter()

        def run(batches):
            for batch in batches:
                good, x = _matrix(batch.column(2), dim)
                code = cut(_unit(x), probes)
                n, steps = len(x), code.shape[2]
                at = pa.array(np.repeat(good, tables * steps))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), steps), n)),
                     pa.array(code.reshape(-1)), batch.column(1).take(at)],
                    names=["project_id", "part", "code", "id"])

        return rows.mapInArrow(run, schema)

    def miss(self, distance: float) -> float:
        """Chance that no table holds a vector at this distance in the question's own cell."""
        r = self.width / max(distance, 1e-9)
        same = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
        return (1 - max(same, 0.0) ** self.hashes) ** self.tables

    def sure_distance(self, recall: float) -> float:
        """Up to this distance a vector is missed with a chance of 1 - ``recall`` at most."""
        low, high = 0.0, 2.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if self.miss(mid) <= 1 - recall else (low, mid)
        return low

    def search(self, questions: DataFrame, recall: float = 0.95, qvec_col: str = "qvec") -> DataFrame:
        """(question_id, id, score, rank, way): rank <= top_k.  A question whose k-th candidate
        is so far that a nearer vector may be missed with a chance above 1 - ``recall``, or that
        has fewer than top_k candidates, is searched exactly (``way``)."""
        q = questions.select("question_id", "project_id", "top_k", F.col(qvec_col).cast("array<double>").alias("qvec"))
        scored = _score_in_place(q, self.cells, "qvec", "v", "id", False, QUESTIONS, "codes", self._cutter()).join(
            q.select("question_id", "top_k").distinct(), "question_id")
        w = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
        ranked = materialize(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("top_k")), "lsh-found")
        # scores have four digits: the farthest that a score stands for
        kth = ranked.groupBy("question_id").agg((F.min("score") - 0.00005).alias("cos"), F.count(F.lit(1)).alias("n"))
        far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cos")))
        sure = kth.join(q.select("question_id", "top_k"), "question_id").where(
            (F.col("n") == F.col("top_k")) & (far <= self.sure_distance(recall))).select("question_id")
        rest = materialize(q.join(sure, "question_id", "left_anti"), "lsh-rest")
        exact = search(rest, self.vectors, vec_col="v", unit_vectors=False)
        near = ranked.join(sure, "question_id", "left_semi").select("question_id", "id", "score", "rank")
        return near.withColumn("way", F.lit("index")).unionByName(exact.withColumn("way", F.lit("exact")))


def embedding_mismatches(chunks: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunks without a vector and vectors without a chunk (the original
    zips the two lists and silently drops the tail); two anti joins on the
    chunk key, reported as rows (side, project_id, id)."""
    key = ["project_id", id_col]
    c = chunks.select(*key)
    v = vectors.select(*key)
    return (c.join(v, key, "left_anti").withColumn("side", F.lit("chunk_without_vector"))
            .unionByName(v.join(c, key, "left_anti").withColumn("side", F.lit("vector_without_chunk")))
            .select("side", "project_id", F.col(id_col).alias("id")))


def dedupe_records(records: DataFrame, order_cols: tuple[str, ...] = ("file_path", "line", "name")) -> tuple[DataFrame, DataFrame]:
    """Store records keyed by (project, id): equal ids (same name and line in
    one file, or two paths with the same slug) keep exactly one record, the
    first in (file, line, name) order; the others are returned as a violations
    table instead of reaching the store.

    A partial aggregate yields the duplicated ids (normally few); only their
    records are ranked.  The ids are stored: few, as their size then shows, they are sent
    to the records, and no vector is shuffled to leave nothing out."""
    key = ["project_id", "id"]
    dup = materialize(records.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*key),
                      "duplicate-ids")
    first = Window.partitionBy(*key).orderBy(*order_cols, F.xxhash64(*records.columns))
    marked = records.join(dup, key, "left_semi").withColumn("_rn", F.row_number().over(first))
    kept = records.join(dup, key, "left_anti").unionByName(marked.where("_rn = 1").drop("_rn").select(records.columns))
    dups = marked.where("_rn > 1").select("project_id", "id", *order_cols)
    return kept, dups
