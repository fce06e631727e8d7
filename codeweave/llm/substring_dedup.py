"""Operator 2: removal of repeated token windows.

Every window of ``size`` consecutive words gets a Rabin-Karp hash of its words.
The hashes are counted in Spark: a task cuts its hashes into buckets, packs each
bucket with the window positions into one binary row, and a bucket's rows meet
in one group, where the hashes that occur twice are found by sorting.  Windows
that occur anywhere else, in the same text or another, mark the words they
cover; marks merge into maximal removal intervals per document.

The windows of a hot passage are as many different hashes and spread over all
buckets; one hash that fills a third of all windows is a packed array, never
rows.  Bucket numbers follow the size of the input, so a group stays bounded.

Cases: null and empty texts have no words and keep the empty string; texts
shorter than a window lose nothing; a text that occurs twice loses all its
words (of ``size`` or more) in both rows; a null doc_id is a row like another;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ENTRY, Scratch, Words, bucket_rows, buckets_for, directory_bucket, entry_batch,
                     numbered, repeated_entries, text_batches, text_bytes, texts_of, unpack_positions,
                     window_hashes)

def window_entries(rows: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """Per batch of texts: one row per bucket with the packed window positions
    and hashes, and one directory row (no hashes) with the texts' row numbers
    and first words.  A batch is named by its first row."""
    def run(batches):
        for batch, texts in text_batches(batches, 1, 1 << 22):
            words = Words(texts)
            hashes = window_hashes(words.hash, size)
            # a window must not cross the end of its text
            start = np.arange(len(hashes))
            inside = start + size <= words.first[np.searchsorted(words.first, start, side="right")] \
                if len(hashes) else np.zeros(0, dtype=bool)
            keys, pos = hashes[inside], start[inside]
            rids = batch.column(0).to_numpy()
            name = int(rids[0])
            yield entry_batch([*bucket_rows(keys, pos, n_buckets),
                               (directory_bucket(name, n_buckets), None, None,
                                np.r_[rids, words.first].astype(np.int64).tobytes())], name)

    return rows.select("rid", "text").mapInArrow(run, ENTRY)


def intervals(hits: DataFrame, size: int) -> DataFrame:
    """``rid, spans``: maximal intervals [from, to) of removed words, as packed
    64-bit numbers, of every document that has one."""
    def merge(table: pa.Table) -> pa.Table:
        rids = firsts = None
        marked = []
        for pos, extra in zip(table.column("pos"), table.column("extra")):
            if extra.is_valid:
                both = np.frombuffer(extra.as_py(), dtype=np.int64)
                rids, firsts = both[:len(both) // 2], both[len(both) // 2:]
            else:
                marked.append(unpack_positions(pos.as_py()))
        out_rid, out = [], []
        if marked:
            change = np.zeros(int(firsts[-1]) + 1, dtype=np.int32)
            at = np.concatenate(marked)
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.r_[False, gone, False].astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            # texts are neighbours in a batch: cut intervals where a text begins
            inner = firsts[1:-1]
            cuts = np.unique(inner[(inner < len(gone))])
            cuts = cuts[(cuts > 0) & gone[cuts] & gone[cuts - 1]] if len(cuts) else cuts
            begin, end = np.sort(np.r_[begin, cuts]), np.sort(np.r_[end, cuts])
            doc = np.searchsorted(firsts, begin, side="right") - 1
            for d in np.unique(doc):
                mine = doc == d
                out_rid.append(int(rids[d]))
                out.append((np.stack([begin[mine], end[mine]], axis=1) - firsts[d]).astype(np.int64).tobytes())
        return pa.table({"rid": pa.array(out_rid, pa.int64()), "spans": pa.array(out, pa.binary())})

    return hits.groupBy("batch").applyInArrow(merge, "rid long, spans binary")


def removal_spans(scratch: Scratch, rows: DataFrame, size: int) -> DataFrame:
    n_bytes = text_bytes(rows)
    entries = window_entries(rows, size, buckets_for(n_bytes // 6))
    return scratch.store(intervals(repeated_entries(entries), size), "spans")


def substring_dedup(docs: DataFrame, size: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_text``, one row per row of
    ``docs (doc_id, text)``; ``spans``: removed intervals [from, to) of words."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = texts_of(numbered(scratch, docs.select("doc_id", "text")))
    spans = removal_spans(scratch, rows, size)

    def keep(batches):
        for batch, texts in text_batches(batches, 1):
            out = []
            for text, raw in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = text.split()
                cut = np.frombuffer(raw or b"", dtype=np.int64).reshape(-1, 2).tolist()
                left, at = [], 0
                for a, b in cut:
                    left += words[at:a]
                    at = b
                left += words[at:]
                out.append((len(words), len(words) - len(left), [{"start": a, "end": b} for a, b in cut],
                            b" ".join(left)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(cols[3], pa.binary())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return (rows.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "spans")
            .mapInArrow(keep, "doc_id long, n_words long, n_removed long, "
                              "spans array<struct<start:long,end:long>>, kept_text binary"))
