"""Operator 11: ranked lexical search by the Best Position Algorithm.

The index is a table of segments: a task reads its texts, and about ``SEGMENT``
bytes of them become one row with the distinct terms, the postings of each term
(document in the segment, occurrences) and the documents' lengths.  No posting
is shuffled, so a frequent term, a hot source or a group of copies is only a
longer list in every segment.

The distinct query texts are searched in blocks of some ``BLOCK``.  A block's
terms lie in one shared file; a first pass over the segments' terms counts in how many
documents each occurs, and the weights that follow lie in a second file.  In
each segment a term's postings become an impact list, highest first, for sorted
access, beside the same postings by document for direct access.  For every query:

* its lists are read side by side, in growing strides;
* each document that turns up is looked up in all lists, which gives its score and
  marks its places in the other lists as seen;
* the best position of a list is the end of the unbroken stretch of seen places
  from its top; the impacts there sum to the threshold, the most that a document
  not yet seen can score (an ended list adds nothing);
* reading stops when the threshold is strictly below the score of the k-th
  document (an equal one could still be a tie of a smaller doc_id).

The k best of earlier segments of the task count as well, so thresholds are met
sooner in later ones.  Each task gives k rows per query, which two rankings join.

Terms and scores are exact (bytes and 64-bit numbers).

Cases: null and empty texts have no term and are not counted; items without a
known term have no rows; equal item texts are searched once and each row of items
gets the result; documents that repeat are ranked each, null doc_ids last; fewer
than k documents above 0 are all given; empty tables give an empty result; further
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, SharedFiles, text_batches

#: A-Z to a-z; bytes that belong to no term to a blank.
TERM_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or 48 <= i <= 57 or 97 <= i <= 122 else 32
                   for i in range(256))
SEGMENT = 1 << 25
MOST_DOCS = 65_535
BLOCK = 4096
STRIDE = 8
SALTS = 32

_SEGMENT = ("docs binary, known binary, lengths binary, terms binary, first binary, places binary, times binary, "
            "width int, n_docs long, n_terms long")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_TABLE).split()


# ---------------------------------------------------------------- index
class Builder:
    """Postings of the texts of one segment."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)
        self.docs, self.lengths, self.term, self.times, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.size += len(text)
        found = terms_of(text)
        if not found:
            return
        times = Counter(found)
        self.docs.append(doc_id)
        self.lengths.append(len(found))
        self.term.append(np.fromiter(map(self.ids.__getitem__, times), np.int32, len(times)))
        self.times.append(np.fromiter(times.values(), np.uint32, len(times)))

    def row(self) -> pa.RecordBatch:
        n = np.fromiter(map(len, self.term), np.int64, len(self.term))
        term = np.concatenate(self.term)
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(self.ids) + 1))
        places = np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
        times = np.concatenate(self.times)[order]
        width = 1 if times.max() < 256 else 2 if times.max() < 65536 else 4
        known = np.array([d is not None for d in self.docs])
        cells = [np.array([d or 0 for d in self.docs], dtype=np.int64), known, np.array(self.lengths, dtype=np.int64),
                 b"\n".join(self.ids), first.astype(np.int64), places, times.astype(f"u{width}")]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in cells),
             pa.array([width], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([sum(self.lengths)], pa.int64())],
            names=[c.split()[0] for c in _SEGMENT.split(", ")])


def index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments of ``docs (doc_id, text)``."""
    def run(batches):
        built = Builder()
        for batch, texts in text_batches(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                built.add(doc_id, text)
                if built.size >= segment or len(built.docs) == MOST_DOCS:
                    if built.docs:
                        yield built.row()
                    built = Builder()
        if built.docs:
            yield built.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(run, _SEGMENT)


class Segment:
    """A stored segment, with the terms of a block of queries looked up."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        self.docs, self.lengths = (np.frombuffer(row[c], dtype=np.int64) for c in ("docs", "lengths"))
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.first = np.frombuffer(row["first"], dtype=np.int64)
        self.places = np.frombuffer(row["places"], dtype=np.uint16)
        self.times = np.frombuffer(row["times"], dtype=f"u{row['width']}")
        #: number of the block's term: its number here
        self.here = {wanted[t]: i for i, t in enumerate(row["terms"].split(b"\n")) if t in wanted}
        self.seen = np.zeros(len(self.docs), dtype=bool)
        self.lists: dict[int, tuple] = {}

    def impact_list(self, term: int, dampened: np.ndarray):
        """Documents ascending and their impacts (direct access); documents and
        impacts by falling impact (sorted access)."""
        if term not in self.lists:
            part = slice(self.first[self.here[term]], self.first[self.here[term] + 1])
            docs, tf = self.places[part].astype(np.int64), self.times[part].astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * dampened[docs])
            order = np.argsort(-impact, kind="stable")
            self.lists[term] = docs, impact, docs[order], impact[order]
        return self.lists[term]


# --------------------------------------------------------------- search
def best_positions(lists: list[tuple], seen: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores that may be among the ``k`` best of all documents,
    of which ``least`` is known to be reached by k documents elsewhere.

    ``lists``: (documents ascending, impacts, documents by falling impact,
    impacts falling, weight); ``seen``: False for every document, and again
    when the function returns."""
    at, stride, found, scores = 0, STRIDE, [], []
    best = [0] * len(lists)
    while True:
        turned_up = np.unique(np.concatenate([ranked[at:at + stride] for _, _, ranked, _, _ in lists]))
        new = turned_up[~seen[turned_up]]
        if len(new):
            seen[new] = True
            total = np.zeros(len(new), dtype=np.int64)
            for docs, impact, _, _, weight in lists:  # direct accesses
                place = np.minimum(np.searchsorted(docs, new), len(docs) - 1)
                total += np.where(docs[place] == new, weight * impact[place], 0)
            found.append(new)
            scores.append(total)
        threshold, open_lists = 0, False
        for i, (_, _, ranked, falling, weight) in enumerate(lists):
            p = best[i]
            while p < len(ranked):
                part = seen[ranked[p:p + 4 * stride]]
                gap = int(part.argmin())
                if not part[gap]:
                    p += gap
                    break
                p += len(part)
            best[i] = p
            if p < len(ranked):
                open_lists = True
                threshold += weight * int(falling[p - 1])
        at += stride
        stride *= 2
        if open_lists:
            every = np.concatenate(scores)
            kth = int(np.partition(every, len(every) - k)[len(every) - k]) if len(every) >= k else 0
            if max(kth, least) <= threshold:
                continue
        docs = np.concatenate(found)
        seen[docs] = False
        return docs, np.concatenate(scores)


def _wanted(files: SharedFiles, block: int) -> dict[bytes, int]:
    raw = files.array(f"terms-{block}", np.uint8).tobytes()
    return {t: i for i, t in enumerate(raw.split(b"\n"))} if raw else {}


def _queries(files: SharedFiles, block: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number, terms, repeats) of the queries of a block."""
    raw, at, out = files.array(f"queries-{block}", np.int64), 0, []
    while at < len(raw):
        n = int(raw[at + 1])
        out.append((int(raw[at]), raw[at + 2:at + 2 + n], raw[at + 2 + n:at + 2 + 2 * n]))
        at += 2 + 2 * n
    return out


def store_block(table: pa.Table, files: SharedFiles) -> pa.Table:
    """A block's distinct terms, and its queries as numbers of terms with repeats."""
    block, ids, parts = table.column("block")[0].as_py(), defaultdict(count().__next__), []
    for qid, text in sorted(zip(table.column("qid").to_pylist(), table.column("text").to_pylist())):
        times = Counter(terms_of(text))
        parts += [[qid, len(times)], [ids[t] for t in times], list(times.values())]
    files.put(f"terms-{block}", [b"\n".join(ids)])
    files.put(f"queries-{block}", [np.array(p, dtype=np.int64).tobytes() for p in parts])
    return pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([len(ids)], pa.int64())})


def document_counts(segments: DataFrame, files: SharedFiles, block: int) -> DataFrame:
    """``term, df`` of the block's terms, summed per task before they are shuffled."""
    def run(batches):
        wanted = _wanted(files, block)
        df = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for terms, first in zip(*(batch.column(c).to_pylist() for c in ("terms", "first"))):
                size = np.diff(np.frombuffer(first, dtype=np.int64))
                for i, t in enumerate(terms.split(b"\n")):
                    if t in wanted:
                        df[wanted[t]] += size[i]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())],
                                         names=["term", "df"])

    return segments.select("terms", "first").mapInArrow(run, "term long, df long") \
        .groupBy("term").agg(F.sum("df").alias("df"))


def store_weights(df: DataFrame, files: SharedFiles, block: int, n_docs: int) -> DataFrame:
    """A block's weights, by number of the term."""
    def put(table: pa.Table) -> pa.Table:
        weights = np.zeros(len(_wanted(files, block)), dtype=np.int64)
        for term, n in zip(table.column("term").to_pylist(), table.column("df").to_pylist()):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        files.put(f"weights-{block}", [weights.tobytes()])
        return pa.table({"n": pa.array([len(table)], pa.int64())})

    return df.withColumn("block", F.lit(block)).groupBy("block").applyInArrow(put, "n long")


def search_block(segments: DataFrame, files: SharedFiles, block: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``qid, doc_id, score``: the k best of each task for each query."""
    def run(batches):
        wanted, queries = _wanted(files, block), _queries(files, block)
        weights = files.array(f"weights-{block}", np.int64)
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row, wanted)
                dampened = 25 + (75 * seg.lengths * n_docs) // n_terms
                for qid, terms, repeats in queries:
                    lists = [(*seg.impact_list(t, dampened), int(r * weights[t]))
                             for t, r in zip(terms.tolist(), repeats.tolist()) if t in seg.here]
                    if not lists:
                        continue
                    mine = best.get(qid, [])
                    docs, scores = best_positions(lists, seg.seen, k, -mine[-1][0] if len(mine) == k else 0)
                    if len(docs) > k:
                        some = scores >= max(1, np.partition(scores, len(scores) - k)[len(scores) - k])
                        docs, scores = docs[some], scores[some]
                    best[qid] = sorted(mine + [
                        (-s, not known, d) for s, known, d in zip(scores.tolist(), seg.known[docs].tolist(),
                                                                  seg.docs[docs].tolist()) if s > 0])[:k]
        rows = [(q, None if gone else d, -s) for q, found in best.items() for s, gone, d in found]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["qid", "doc_id", "score"])

    return segments.mapInArrow(run, "qid long, doc_id long, score long")


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items (item_id,
    text)`` its ``k`` best of ``docs (doc_id, text)``."""
    scratch = Scratch(docs.sparkSession, "search")
    segments = scratch.store(index(docs.select("doc_id", "text"), segment), "segments")
    n_docs, n_terms = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked = items.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    texts = scratch.store(asked.select("text").distinct().withColumn("qid", F.monotonically_increasing_id()), "texts")
    n_blocks = -(-texts.count() // block) if n_docs else 0
    files, results = scratch.files("blocks"), None
    numbered = texts.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(n_blocks, 1))))
    if n_blocks:
        scratch.store(numbered.groupBy("block").applyInArrow(lambda t: store_block(t, files), "block long, n long"),
                      "stored")
    for b in range(n_blocks):
        if not files.exists(f"terms-{b}"):
            continue
        scratch.store(store_weights(document_counts(segments, files, b), files, b, n_docs), f"weights-{b}")
        if not files.exists(f"weights-{b}"):  # no document holds a term of this block
            continue
        found = search_block(segments, files, b, n_docs, n_terms, k)
        salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
        part = scratch.store(ranked(ranked(salted, k, "qid", "salt"), k, "qid").select("qid", "rank", "doc_id", "score"),
                             f"found-{b}")
        results = part if results is None else results.unionAll(part)
    if results is None:
        results = docs.sparkSession.createDataFrame([], "qid long, rank int, doc_id long, score long")
    return asked.join(texts.join(results, "qid"), "text").select("item_id", "rank", "doc_id", "score")
