"""Operator 3: exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its bytes says so; every chunk content
gets one identifier, verified by comparing the contents themselves; a document is
then the ordered list of its chunk identifiers, and equal lists are equal texts.
A long document moves once, as chunks, and each task sends a chunk content it
holds several times only once; after that only short identifier lists move.

Cases: null and empty texts are one group (the empty text); a null doc_id is
kept as a row and loses to any other doc_id; rows that repeat a doc_id are
separate members of the group, and exactly one of the rows with the smallest
doc_id has ``kept``; an empty table gives an empty result; further columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_TABLE, Scratch, keep_rows, numbered, text_batches, texts_of

MIN_CHUNK, MEAN_BITS, MAX_CHUNK, KEY_SIZE = 1024, 12, 16384, 16
_SPACES = re.compile(rb"  +")
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalise(text: bytes) -> bytes:
    """Every run of ``[\\x20\\x09-\\x0D]`` becomes one space."""
    text = text.translate(WS_TABLE)
    return _SPACES.sub(b" ", text) if b"  " in text else text


def cut(text: bytes) -> list[bytes]:
    """Content-defined chunks: a cut follows a byte where the gear hash of the
    last 32 bytes has ``MEAN_BITS`` zero bits, at least ``MIN_CHUNK`` and at
    most ``MAX_CHUNK`` bytes after the last cut."""
    n = len(text)
    if n <= 2 * MIN_CHUNK:
        return [text]
    h = _GEAR[np.frombuffer(text, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):
        g = h.copy()
        g[s:] += h[:-s] << np.uint32(s)
        h = g
    marks = np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    out, start, at = [], 0, 0
    while n - start > MIN_CHUNK:
        at = int(np.searchsorted(marks, start + MIN_CHUNK))
        end = min(int(marks[at]) if at < len(marks) else n, start + MAX_CHUNK, n)
        out.append(text[start:end])
        start = end
    if start < n:
        out.append(text[start:])
    return out


def chunk_rows(texts: DataFrame) -> DataFrame:
    """One row per chunk content and batch: ``(key, content, uses)``, ``uses``
    the places ``(rid, pos)``; and one row per document with a null key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 2, 1 << 23):
            uses: dict[bytes, list] = {}
            rows = []
            for rid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts,
                                         strict=True):
                text = normalise(text)
                parts = cut(text)
                rows.append((rid, doc_id, hashlib.sha256(text).hexdigest(), len(parts)))
                for i, part in enumerate(parts):
                    uses.setdefault(part, []).append({"rid": rid, "pos": i})
            n, m = len(uses), len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.blake2b(c, digest_size=KEY_SIZE).digest() for c in uses] + [None] * m, pa.binary()),
                pa.array([*uses, *[None] * m], pa.binary()),
                pa.array([*uses.values(), *[None] * m],
                         pa.list_(pa.struct([("rid", pa.int64()), ("pos", pa.int32())]))),
                pa.array([None] * n + [r[0] for r in rows], pa.int64()),
                pa.array([None] * n + [r[1] for r in rows], pa.int64()),
                pa.array([None] * n + [r[2] for r in rows], pa.string()),
                pa.array([None] * n + [r[3] for r in rows], pa.int32()),
            ], names=["key", "content", "uses", "rid", "doc_id", "text_sha256", "n_chunks"])

    return texts.mapInArrow(run, "key binary, content binary, uses array<struct<rid:long,pos:int>>, "
                               "rid long, doc_id long, text_sha256 string, n_chunks int")


def _grouped(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Result rows of numbered rows, with ``rid``."""
    rows = chunk_rows(texts_of(rows))
    chunks = rows.where("key is not null")
    # an identifier is its key where all chunks of the key have one content, else the key and a digest
    unsure = (chunks.select("key", "content").distinct().groupBy("key").count().where("count > 1")
              .select("key", F.lit(True).alias("unsure")))
    uses = chunks.select("key", F.sha2("content", 256).alias("digest"), F.explode("uses").alias("use"))
    named = uses.join(unsure, "key", "left").select(
        "use.rid", "use.pos", F.struct("key", F.when(F.col("unsure"), F.col("digest")).alias("variant")).alias("id"))
    lists = named.groupBy("rid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("recipe"))
    info = rows.where("key is null").select("rid", "doc_id", "text_sha256", "n_chunks")
    told = scratch.store(info.join(lists, "rid"), "told")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    groups = told.groupBy("recipe").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    return (told.join(groups, "recipe")
            .select("rid", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256", "n_chunks"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``, one row per
    row of ``docs (doc_id, text)``."""
    scratch = Scratch(docs.sparkSession, "exact")
    return _grouped(scratch, numbered(scratch, docs.select("doc_id", "text"))).drop("rid")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = numbered(scratch, docs)
    return keep_rows(rows, _grouped(scratch, rows).where("kept"))
