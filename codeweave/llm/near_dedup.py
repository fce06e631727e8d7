"""Operator 8: MinHash near-duplicates with odd sketches.

Every document becomes its set of distinct word shingles.  ``SAMPLES`` MinHash
values per set are used twice: in bands of ``ROWS`` they name buckets that
propose candidates, and folded into a parity bitmap (odd sketch) they give a
precise estimate of high similarities: the population count of two XORed
bitmaps.  Candidates that pass the sketch are confirmed on the full sets, and
confirmed links are united.

Bucket sizes are not bounded and no pair list of a bucket is made:

1. documents with equal sets are one class, represented by one of them;
2. in each bucket all members are compared with the bucket's smallest member
   (one row per member), which joins most of a group of near copies;
3. buckets whose members are still in different components are searched for
   every remaining link between components, in tiles of bounded size: sketches
   first, full sets where the sketch passes; pairs already in one component
   are skipped, since a link between them changes nothing.

So every pair of different components that shares a band and is similar enough
is found; a pair with similarity 0.8 shares no band with probability 1e-7 and
fails the sketch with a few in a million.

Cases: null texts, empty texts and texts without words have the empty set and
link with nothing; texts of fewer words than a shingle are one shingle of the
whole sequence; a null doc_id is a row that links by its text, its component
is named by the smallest doc_id that is not null; repeated rows are equal sets;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, WORD_POWERS, Scratch, SharedFiles, Words, components, keep_rows, mix64, numbered,
                     prefix_sums, span_hashes, text_batches, texts_of)

SAMPLES, ROWS, BITS = 200, 5, 512
BANDS = SAMPLES // ROWS
LANES = BITS // 64
TILE = 2048
_MULT = np.random.default_rng(8).integers(0, 1 << 63, SAMPLES, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle values of each text."""
    words = Words(texts, lower=True)
    prefix, down = prefix_sums(words.hash, WORD_POWERS)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = b - a
        if n == 0:
            out.append(np.zeros(0, dtype=U64))
            continue
        start = np.arange(a, b - size + 1) if n >= size else np.array([a])
        values = span_hashes(prefix, down, start, start + min(n, size))
        out.append(np.unique(mix64(values + U64(min(n, size)))))
    return out


def minhash(values: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, ~U64(0), dtype=U64)
    for i in range(0, len(values), 2048):
        np.minimum(low, np.multiply.outer(_MULT, values[i:i + 2048]).min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One bucket name per band."""
    h = np.arange(1, BANDS + 1, dtype=U64)
    for r in range(ROWS):
        h = mix64(h + low[r::ROWS])
    return h


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each (sample number, value) flips one bit."""
    bit = (mix64(low ^ mix64(np.arange(SAMPLES, dtype=U64))) % U64(BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64)


def sketch_limit(similarity: float, sigmas: float = 4.5) -> int:
    """Largest population count of two XORed sketches that is not yet
    ``sigmas`` deviations above its mean at the given similarity."""
    differing = 2 * SAMPLES * (1 - similarity)
    shrink = math.exp(-2 * differing / BITS)
    mean = BITS / 2 * (1 - shrink)
    spread = math.sqrt(SAMPLES * similarity * (1 - similarity)) * 2 * shrink
    noise = math.sqrt(BITS / 4 * (1 - shrink ** 2))
    return int(mean + sigmas * math.hypot(spread, noise))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of sorted distinct values."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


SIGNED = ("rid long, doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def signed(texts: DataFrame, size: int) -> DataFrame:
    """Signature row of every ``rid, doc_id, text``."""
    def run(batches):
        for batch, texts in text_batches(batches, 2):
            sets = shingle_sets(texts, size)
            lows = [minhash(s) if len(s) else None for s in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([None if x is None else bands(x).view(np.int64) for x in lows], longs),
                pa.array([None if x is None else odd_sketch(x).view(np.int64) for x in lows], longs),
            ], names=["rid", "doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return texts.mapInArrow(run, SIGNED)


def full_sets(texts: DataFrame, size: int, files: SharedFiles) -> DataFrame:
    """Writes the sets of ``rid, text`` to shared files; ``rid, file, at, n``."""
    def run(batches):
        name, at, out = f"{uuid.uuid4().hex}.u64", 0, None
        for batch, raw in text_batches(batches, 1):
            out = out or files.writer(name)
            sets = shingle_sets(raw, size)
            out.write(b"".join(s.tobytes() for s in sets))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([name] * len(n), pa.string()), pa.array(at + np.cumsum(n) - n), pa.array(n)],
                names=["rid", "file", "at", "n"])
            at += int(n.sum())
        if out:
            out.close()

    return texts.mapInArrow(run, "rid long, file string, at long, n long")


def _sketch_distance(a: str, b: str):
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, LANES)),
               F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def confirm(pairs: DataFrame, sets: DataFrame, files: SharedFiles, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            a, b, *places = (batch.column(i).to_pylist() for i in range(8))
            hit = [similar(files.array(fa)[oa:oa + na], files.array(fb)[ob:ob + nb], percent)
                   for fa, oa, na, fb, ob, nb in zip(*places, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(hit, pa.bool_()))

    def side(x):
        return sets.select(F.col("rid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("file", "at", "n")))

    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .select("a", "b", "file_a", "at_a", "n_a", "file_b", "at_b", "n_b").mapInArrow(run, "a long, b long"))


def tile_links(table: pa.Table, files: SharedFiles, limit: int, percent: int) -> pa.Table:
    """Confirmed links between different components among the members of one
    tile of a bucket.  A pair that shares several bands is looked at in its
    first one only; pairs that the links found so far have joined are skipped."""
    rid, label, part = (table.column(c).to_numpy() for c in ("rid", "comp", "part"))
    label = np.unique(label, return_inverse=True)[1]
    sketch, band = (np.stack(table.column(c).combine_chunks().flatten().to_numpy().reshape(len(rid), -1))
                    for c in ("sketch", "bands"))
    sketch, bucket = sketch.view(U64), table.column("bucket")[0].as_py()
    cross = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    file, at, n = (table.column(c).to_pylist() for c in ("file", "at", "n"))

    def full(i):
        return files.array(file[i])[at[i]:at[i] + n[i]]

    out = []
    for u in range(len(rid) - 1):
        if (label == label[0]).all():
            break
        other = label[u + 1:] != label[u]
        if cross:
            other &= part[u + 1:] != part[u]
        v = np.flatnonzero(other) + u + 1
        if not len(v):
            continue
        far = np.bitwise_count(sketch[v] ^ sketch[u]).sum(axis=1)
        v, far = v[far <= limit], far[far <= limit]
        if not len(v):
            continue
        same = band[v] == band[u]
        v, far = (x[band[u][same.argmax(axis=1)] == bucket] for x in (v, far))
        mine = full(u) if len(v) else None
        for w in v[np.argsort(far, kind="stable")]:
            if label[w] != label[u] and similar(mine, full(w), percent):
                out.append((rid[u], rid[w]))
                label[label == label[w]] = label[u]
    return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()),
                     "b": pa.array([int(y) for _, y in out], pa.int64())})


def _between_components(multi, reps, sets, files, comp, limit, percent):
    """Links in buckets whose members are still in different components."""
    member = multi.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select(
        "bucket", "rid", F.coalesce("comp", "rid").alias("comp"))
    mixed = (member.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"))
             .where("x < y").select("bucket", F.ceil(F.col("m") / TILE).cast("int").alias("parts")))
    tiles = (member.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .join(reps.select("rid", "bands", "sketch"), "rid").join(sets, "rid")
             .select("bucket", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"),
                     "rid", "comp", "part", "bands", "sketch", "file", "at", "n"))

    def find(table: pa.Table) -> pa.Table:
        return tile_links(table, files, limit, percent)

    return tiles.groupBy("bucket", "lo", "hi").applyInArrow(find, "a long, b long")


def _grouped(scratch: Scratch, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``rid, doc_id, n_shingles, root``: ``root`` is the same in a component."""
    limit = sketch_limit(percent / 100)
    rows = scratch.store(signed(texts, shingle), "signed")
    reps = scratch.store(rows.where("n_shingles > 0").groupBy("set_key")
                         .agg(F.min(F.struct("rid", "bands", "sketch")).alias("x")).select("set_key", "x.*"), "reps")
    buckets = reps.select("rid", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("rid").alias("hub"), F.count("*").alias("n")).where("n > 1")
    multi = scratch.store(buckets.join(hubs, "bucket").select("bucket", "rid", "hub"), "multi")
    ends = [reps.select(F.col("rid").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    passed = scratch.store(
        multi.where("rid > hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()
        .join(ends[0], "a").join(ends[1], "b")
        .where(_sketch_distance("sketch_a", "sketch_b") <= limit).select("a", "b"), "passed")
    files = scratch.files("sets")
    sets = scratch.store(full_sets(texts.select("rid", "text").join(multi.select("rid").distinct(), "rid"),
                                   shingle, files), "places")
    links = scratch.store(confirm(passed, sets, files, percent), "hub-links")
    comp = scratch.store(components(scratch, links, "hub"), "hub-comp")
    more = scratch.store(_between_components(multi, reps, sets, files, comp, limit, percent), "more-links")
    scratch.drop("multi", "places", "sets", "passed")
    comp = components(scratch, links.unionAll(more), "all")
    root = reps.select("set_key", "rid").join(comp, F.col("rid") == F.col("node"), "left").select(
        "set_key", F.coalesce("comp", "rid").alias("root"))
    return rows.select("rid", "doc_id", "n_shingles", "set_key").join(root, "set_key", "left").select(
        "rid", "doc_id", "n_shingles", F.coalesce("root", "rid").alias("root"))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of
    ``docs (doc_id, text)``; documents are linked when their sets of ``shingle``
    words have a Jaccard similarity of ``percent`` / 100 or more."""
    scratch = Scratch(docs.sparkSession, "near")
    told = _grouped(scratch, texts_of(numbered(scratch, docs.select("doc_id", "text"))), shingle, percent)
    names = told.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return told.join(names, "root").select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component (the smallest
    doc_id), with all their columns."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = numbered(scratch, docs)
    told = _grouped(scratch, texts_of(rows), shingle, percent)
    first = told.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("x")).select("x.rid")
    return keep_rows(rows, first)
