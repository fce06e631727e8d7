"""Operator 12: runs of repeated words, and texts without the repetitions.

A run is a maximal stretch of words with smallest period q and length of at
least max(``LEAST``, 3 q).  Where words q apart are equal, ``w[i] == w[i + q]``
for all i of an interval; a run of period q is such a maximal interval and the q
words after it.

Periods are cut into octaves [Q, 2Q) (the first holds 1 to 7), and each octave
has tiles of its own, max(``TILE``, 32 Q) words that overlap by 6 Q, so that no
tile grows with the text unless its periods do.  Octaves whose tiles are alike
share them; a text of one tile is solved where it is read, and the tiles of
longer texts become rows that are dealt over all tasks.

A tile is solved on its own.  Boundaries stand every Q words; an interval of a run
holds a whole block [c, c + Q) behind one of them, so c + q must begin with the
same block.  Blocks are compared by hash, for all boundaries and periods of the
tile at once.  Where they agree, the Z-function of the boundary says how far the
words behind c and c + q agree to the right, and that of the reversed words
how far to the left (binary search on hashes, all pairs at once).  The interval
fragments that result are held against the words themselves, so no hash
decides on equality, and periods that a shorter one explains are dropped.

Fragments are shuffled by document and period, where those that overlap or touch
are stitched; of equal stretches the smallest period stays.  Texts without any
fragment, most of them, are finished where they are read; the texts of the others
meet their runs in a join.

Cases: null and empty texts have no words and no runs; repeated rows are rows like
others; a null doc_id is never replanted; ties of the greatest exponent go to the
smallest start, then period; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WORD_POWERS, Scratch, mix64, numbered, prefix_sums, text_batches, texts_of

LEAST = 24
TILE = 8192
RUNS = "array<struct<start:long,length:long,period:long>>"


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) where the words of a document are replaced by a
    repetition of its own words; a tenth of the documents by their number."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def words_of(doc_id: int | None, text: bytes, plant: bool) -> list[bytes]:
    words = text.split()
    where = planted(doc_id, len(words)) if plant else None
    if where:
        a, p = where
        tail = words[a:a + p]
        words[a:] = (tail * (-(-(len(words) - a) // p)))[:len(words) - a]
    return words


# ---------------------------------------------------------------- tiles
def octaves(n: int) -> list[int]:
    """Q of the octaves that ``n`` words have room for; 0 is the first, of
    periods 1 to 7."""
    out, q = ([0] if n >= LEAST else []), 8
    while 3 * q <= n:
        out.append(q)
        q *= 2
    return out


def tiles(n: int, tile: int = TILE) -> list[tuple[int, int, int, int]]:
    """(smallest and largest octave, first word, one past the last) of the tiles
    of ``n`` words."""
    by_size: dict[int, list[int]] = {}
    for q in octaves(n):
        by_size.setdefault(max(tile, 32 * q), []).append(q)
    out = []
    for size, some in by_size.items():
        step, at = size - 6 * max(some[-1], 8), 0
        while True:
            out.append((some[0], some[-1], at, min(at + size, n)))
            if at + size >= n:
                break
            at += step
    return out


def agreement(prefix: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray,
              step: int) -> np.ndarray:
    """For each pair (a, b): how many words agree from there on, to the right
    (step 1) or to the left of them (step -1), ``most`` at most."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        x, y = (a, b) if step > 0 else (a - mid, b - mid)
        same = (prefix[x + mid] - prefix[x]) * down[x] == (prefix[y + mid] - prefix[y]) * down[y]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def solve(ids: np.ndarray, first: np.ndarray, some: list[int], cut: bool = False) -> np.ndarray:
    """Interval fragments, long enough for a run or (``cut``) up to an end of the tile, of the octaves ``some`` in words ``ids`` (numbers; equal
    words, equal numbers) of texts that begin at ``first`` (one more entry):
    rows (text, period, start, end), positions within ``ids``.  Longest texts
    come first, so that an octave looks only at those that have room for it."""
    value = mix64(ids.astype(U64) + U64(1))
    prefix, down = prefix_sums(value, WORD_POWERS)
    length, out = np.diff(first), []
    for q in some:
        room = int(np.searchsorted(-length, -max(LEAST, 3 * q), side="right"))
        n = int(first[room])
        block = max(q, 8)
        if n < 2 * block:
            continue
        behind = (prefix[block:n + 1] - prefix[:n + 1 - block]) * down[:n + 1 - block]
        begin = np.append(behind, np.zeros(-len(behind) % block, dtype=U64)).reshape(-1, block)
        if q:  # c + period begins within the next block
            c, period = np.nonzero(begin[1:] == begin[:-1, :1])
            c, period = c * block, period + block
        else:
            c, period = np.nonzero(begin[:, 1:] == begin[:, :1])
            c, period = c * block, period + 1
        text = np.searchsorted(first, c, side="right") - 1
        inside = c + period + block <= first[text + 1]
        c, period, text = c[inside], period[inside], text[inside]
        if not len(c):
            continue
        right = c + agreement(prefix, down, c, c + period, first[text + 1] - c - period, 1)
        left = c - agreement(prefix, down, c, c + period, c - first[text], -1)
        good = right + period - left >= np.maximum(LEAST, 3 * period)
        if cut:
            good |= (left == first[text]) | (right + period == first[text + 1])
        text, period, left, right = text[good], period[good], left[good], right[good]
        out.append(np.unique(np.stack([text, period, left, right], axis=1), axis=0))
    if not out:
        return np.zeros((0, 4), dtype=np.int64)
    return proven(ids, np.concatenate(out))


def proven(ids: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Fragments that the words confirm.  Of the periods of one stretch the
    smallest stays, and its multiples go; a period that is itself a repetition
    goes as well: the shorter one has the same stretch, in this tile or in the
    tiles of its own octave."""
    found = found[np.lexsort((found[:, 1], found[:, 3] + found[:, 1], found[:, 2]))]
    out, before, kept = [], None, []
    for text, q, start, end in found.tolist():
        if before != (start, end + q):
            before, kept = (start, end + q), []
        if any(q % p == 0 for p in kept):
            continue
        if not (ids[start:end] == ids[start + q:end + q]).all():
            # two blocks of one hash: the stretch around is taken as the words have it
            good = np.flatnonzero(np.diff(np.r_[False, ids[start:end] == ids[start + q:end + q], False].astype(np.int8)))
            out += [(text, q, start + a, start + b) for a, b in good.reshape(-1, 2).tolist()]
            continue
        kept.append(root(ids[start:start + q]))
        if kept[-1] == q:
            out.append((text, q, start, end))
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def root(word: np.ndarray) -> int:
    """Length of the shortest word of which ``word`` is a whole number of copies."""
    n, rest, p = len(word), len(word), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        while rest % p == 0:
            rest //= p
            if (word[:n - n // p] == word[n // p:n]).all():
                n //= p
        p += 1
    return n


# ---------------------------------------------------------------- Spark
def _packed(rows: np.ndarray) -> bytes:
    return rows.astype(np.int64).tobytes()


def read_texts(texts: DataFrame, plant: bool, tile: int) -> DataFrame:
    """``rid, doc_id, n, words, fragments, collapsed``: short texts are solved;
    ``words`` (joined by blanks) of texts that have fragments or are long,
    ``collapsed`` (sha256 of all words) of the others."""
    def run(batches):
        for batch, raw in text_batches(batches, 2):
            number = defaultdict(count().__next__)
            words = [words_of(d, t, plant) for d, t in zip(batch.column(1).to_pylist(), raw, strict=True)]
            short = sorted((k for k, w in enumerate(words) if LEAST <= len(w) <= tile), key=lambda k: -len(words[k]))
            fragments: dict[int, list] = {}
            if short:
                sizes = np.array([len(words[k]) for k in short])
                first = np.r_[0, np.cumsum(sizes)]
                ids = np.concatenate([np.fromiter(map(number.__getitem__, words[k]), np.int64, len(words[k])) for k in short])
                for text, q, start, end in solve(ids, first, octaves(int(sizes[0]))).tolist():
                    fragments.setdefault(short[text], []).append((q, start - int(first[text]), end - int(first[text])))
            joined = [b" ".join(w) for w in words]
            open_ = [k in fragments or len(w) > tile for k, w in enumerate(words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([j if o else None for j, o in zip(joined, open_)], pa.binary()),
                 pa.array([_packed(np.array(fragments[k])) if k in fragments else None for k in range(len(words))],
                          pa.binary()),
                 pa.array([None if o else hashlib.sha256(j).hexdigest() for j, o in zip(joined, open_)], pa.string())],
                names=["rid", "doc_id", "n", "words", "fragments", "collapsed"])

    return texts.mapInArrow(run, "rid long, doc_id long, n long, words binary, fragments binary, collapsed string")


def tile_rows(long_texts: DataFrame, tile: int) -> DataFrame:
    """``rid, low, high, at, ids``: the tiles of texts ``(rid, words)``."""
    def run(batches):
        for batch, raw in text_batches(batches, 1):
            for rid, text in zip(batch.column(0).to_pylist(), raw, strict=True):
                number = defaultdict(count().__next__)
                ids = np.fromiter(map(number.__getitem__, text.split()), np.int32)
                for low, high, at, to in tiles(len(ids), tile):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rid], pa.int64()), pa.array([low], pa.int64()), pa.array([high], pa.int64()),
                         pa.array([at], pa.int64()), pa.array([ids[at:to].tobytes()], pa.binary())],
                        names=["rid", "low", "high", "at", "ids"])

    return long_texts.select("rid", "words").mapInArrow(run, "rid long, low long, high long, at long, ids binary")


def solve_tiles(rows: DataFrame) -> DataFrame:
    """``rid, period, start, end`` of the fragments of tiles."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=np.int32).astype(np.int64)
                some = [q for q in octaves(len(ids)) if row["low"] <= q <= row["high"]]
                out += [(row["rid"], q, start + row["at"], end + row["at"])
                        for _, q, start, end in solve(ids, np.array([0, len(ids)]), some, True).tolist()]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["rid", "period", "start", "end"])

    return rows.mapInArrow(run, "rid long, period long, start long, end long")


def packed_fragments(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rids, cells = [], []
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells.append(np.frombuffer(raw, dtype=np.int64).reshape(-1, 3))
                rids += [rid] * len(cells[-1])
            cells = np.concatenate(cells) if cells else np.zeros((0, 3), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), *(pa.array(cells[:, i]) for i in range(3))],
                                             names=["rid", "period", "start", "end"])

    return rows.select("rid", "fragments").mapInArrow(run, "rid long, period long, start long, end long")


def stitch(fragments: DataFrame) -> DataFrame:
    """``rid, runs``: fragments of a document and period that overlap or touch
    are one interval; the intervals long enough for a run are runs."""
    order = Window.partitionBy("rid", "period").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    islands = (fragments.withColumn("open", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)))
               .withColumn("island", F.sum(F.col("open").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    whole = (islands.groupBy("rid", "period", "island")
             .agg(F.min("start").alias("start"), (F.max("end") + F.col("period")).alias("stop"))
             .where(F.col("stop") - F.col("start") >= F.greatest(F.lit(LEAST), 3 * F.col("period"))))
    runs = whole.groupBy("rid", "start", "stop").agg(F.min("period").alias("period"))
    return runs.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        "start", (F.col("stop") - F.col("start")).alias("length"), "period"))).alias("runs"))


def best_of(runs: list[dict]) -> dict | None:
    """The run of greatest length / period; ties by start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r["start"], r["period"])):
        if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    return best


def periodic_runs(docs: DataFrame, plant: bool = False, tile: int = TILE) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed_sha256, collapsed``, one row per
    row of ``docs (doc_id, text)``; ``runs``: all runs by start, then period;
    ``best``: the one of greatest exponent; ``collapsed``: the words that stay
    (null where none goes).  ``plant`` first replaces words of a tenth of the
    documents by repetitions (``planted``)."""
    scratch = Scratch(docs.sparkSession, "runs")
    rows = scratch.store(read_texts(texts_of(numbered(scratch, docs.select("doc_id", "text"))), plant, tile), "read")
    tiled = solve_tiles(tile_rows(rows.where(F.col("n") > tile), tile).repartition("rid", "low", "at"))
    fragments = packed_fragments(rows.where("fragments IS NOT NULL")).unionAll(tiled)
    runs = scratch.store(stitch(fragments), "runs")

    def collapse(batches):
        for batch, raw in text_batches(batches, 2):
            out = []
            for text, runs in zip(raw, batch.column(3).to_pylist(), strict=True):
                words = text.split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for r in runs or []:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((runs or [], best_of(runs or []), hashlib.sha256(kept).hexdigest(),
                            kept if gone.any() else None))
            one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            kinds = [pa.list_(one), one, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))],
                names=["doc_id", "n_words", "runs", "best", "collapsed_sha256", "collapsed"])

    one = RUNS[6:-1]
    joined = (rows.where("words IS NOT NULL").join(runs.hint("merge"), "rid", "left")
              .select("doc_id", "n", "words", "runs")
              .mapInArrow(collapse, f"doc_id long, n_words long, runs {RUNS}, best {one}, collapsed_sha256 string, "
                                    "collapsed binary"))
    done = rows.where("words IS NULL").select(
        "doc_id", F.col("n").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.lit(None).cast(one).alias("best"),
        F.col("collapsed").alias("collapsed_sha256"), F.lit(None).cast("binary").alias("collapsed"))
    return done.unionAll(joined.withColumn("collapsed", F.col("collapsed").cast("binary")))
