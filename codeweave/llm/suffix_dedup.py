"""Operator 9: repeated byte strings by window-minimum fingerprints.

This is not prefix doubling with ranks that Spark sorts anew at growing offsets.
Two positions have the same name exactly when the strings of that length at them
are equal (64-bit hash names).  Names are folded to longer ones where the text
lies, from 16 up to 256 bytes, the name of 2h bytes made of the pair of names at
offsets 0 and h; a length that is no power is covered by two overlapping names.
Spark groups twice, by the name of 256 bytes of a window minimum and by the name
of ``size`` bytes, and drops positions whose name is unique.

Positions are thinned before the first exchange: each position p looks at the
names of 16 bytes in [p, p + 128) and picks the smallest, the last of equals.
Equal strings of ``size`` bytes pick the same place, and the 256 bytes from there
lie in the string, so a position can only repeat if its pick does.  The rounds:

1. picks are grouped by their name of 256 bytes; unique ones end here with all
   positions that picked them;
2. in the same group, the whole stretch from the first to the last string of a
   pick is compared; if it occurs twice, all its positions are settled;
3. positions of stretches that are not settled, and one witness of each settled
   stretch that shares their pick's name, are grouped by the name of ``size``
   bytes: those found twice are repeats.

Everything that moves is packed arrays of names and positions, a bounded number
per group; a passage that a third of all rows share costs 16 bytes per row and
pick.  Repeats cover bytes, covers merge into maximal runs, and runs are cut out.

Cases: null and empty texts have no bytes; texts shorter than the threshold lose
nothing; equal texts of that length lose everything in every row; overlapping
occurrences in one text count; a null doc_id is a row like another; an empty
table gives an empty result; further columns are not read.  Long texts are
worked on in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BYTE_POWERS, ENTRY, U64, Scratch, bucket_rows, buckets_for, directory_bucket,
                     entry_batch, mix64, numbered, pack_positions, prefix_sums, repeated_entries, span_hashes, text_batches,
                     text_bytes, texts_of, unpack_keys, unpack_positions)

GRAM, WINDOW, CORE, STEP = 16, 128, 256, 1 << 20
_PAIR = U64(0xA24BAED4963EE407)
_LOW = U64(0xFFFFFFFF)


def doubled(gram: np.ndarray, at: np.ndarray, length: int = CORE) -> np.ndarray:
    """Names of ``length`` bytes (a power of two times 16) at ``at``: pairs of
    names at growing offsets."""
    name = gram[at[:, None] + np.arange(0, length, GRAM)]
    while name.shape[1] > 1:
        name = mix64(name[:, 0::2] * _PAIR + name[:, 1::2])
    return name[:, 0]


class Piece:
    """Some stretches of texts, every position of which starts a string of
    ``size`` bytes inside its text."""

    def __init__(self, parts: list[tuple[int, int, bytes]], size: int):
        data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        length = np.array([len(p[2]) for p in parts])
        self.doc = np.array([p[0] for p in parts])
        self.begin = np.cumsum(length) - length
        self.shift = np.array([p[1] for p in parts]) - self.begin
        self.size, self.prefix_down = size, prefix_sums(data, BYTE_POWERS)
        i = np.arange(len(data) - GRAM + 1)
        self.gram = mix64(span_hashes(*self.prefix_down, i, i + GRAM))
        key = (self.gram & ~_LOW) | (_LOW - i.astype(U64))
        step = 1
        while step < WINDOW:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        self.valid = np.concatenate([np.arange(b, b + n - size + 1) for b, n in zip(self.begin, length)])
        pick = (_LOW - (key[self.valid] & _LOW)).astype(np.int64)
        edge = np.flatnonzero(np.diff(pick)) + 1
        first, last = np.r_[0, edge], np.r_[edge - 1, len(pick) - 1]
        self.lo, self.hi, self.pick = self.valid[first], self.valid[last], pick[first]
        self.part = np.searchsorted(self.begin, self.lo, side="right") - 1

    def stretches(self) -> np.ndarray:
        """Names of the whole stretch of each pick."""
        name = span_hashes(*self.prefix_down, self.lo, self.hi + self.size)
        return mix64(name + mix64(((self.hi - self.lo) * 1024 + self.pick - self.lo).astype(U64)))

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Names of ``size`` bytes: two overlapping names of 256."""
        return mix64(doubled(self.gram, at) * _PAIR + doubled(self.gram, at + self.size - CORE))


def pieces(texts: list[bytes], size: int) -> Iterator[Piece]:
    parts, total = [], 0
    for d, text in enumerate(texts):
        for at in range(0, len(text) - size + 1, STEP):
            part = text[at:at + STEP + size - 1]
            if total and total + len(part) > STEP:
                yield Piece(parts, size)
                parts, total = [], 0
            parts.append((d, at, part))
            total += len(part)
    if parts:
        yield Piece(parts, size)


def pick_entries(rows: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """Per batch: the picks, numbered through, by bucket of their name, with
    the names of their stretches; and the number of each text's first pick."""
    def run(batches):
        for batch, texts in text_batches(batches, 1, 1 << 23):
            rids = batch.column(0).to_numpy()
            keys, spans, docs = [], [], []
            for piece in pieces(texts, size):
                keys.append(doubled(piece.gram, piece.pick))
                spans.append(piece.stretches())
                docs.append(piece.doc[piece.part])
            name, out = int(rids[0]), []
            if keys:
                keys, spans, docs = (np.concatenate(x) for x in (keys, spans, docs))
                out = list(bucket_rows(keys, np.arange(len(keys)), n_buckets, spans))
            first = np.searchsorted(docs, np.arange(len(texts) + 1)) if len(docs) else np.zeros(len(texts) + 1)
            out.append((directory_bucket(name, n_buckets), None, None, np.r_[rids, first].astype(np.int64).tobytes()))
            yield entry_batch(out, name)

    return rows.select("rid", "text").mapInArrow(run, ENTRY)


def sort_picks(entries: DataFrame) -> DataFrame:
    """``batch, pos, probe, extra``: settled picks in ``pos``, picks to look
    into in ``probe``; directory rows pass through in ``extra``."""
    def find(table: pa.Table) -> pa.Table:
        n = table.num_rows
        if not table.column("keys")[0].is_valid:
            return pa.table({"batch": table.column("batch"), "pos": table.column("pos"),
                             "probe": pa.nulls(n, pa.binary()), "extra": table.column("extra")})
        pos = [unpack_positions(b) for b in table.column("pos").to_pylist()]
        key = unpack_keys(table.column("keys").to_pylist())
        span = np.frombuffer(b"".join(table.column("extra").to_pylist()), dtype=U64)
        order = np.lexsort((span, key))
        k, s = key[order], span[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_span = new_key | np.r_[True, s[1:] != s[:-1]]
        key_no, span_no = np.cumsum(new_key) - 1, np.cumsum(new_span) - 1
        key_size, span_size = np.bincount(key_no), np.bincount(span_no)
        single = span_size[span_no] == 1
        open_ = single & (key_size[key_no] > 1)
        has_open = np.bincount(key_no, weights=open_) > 0
        settled, probe = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
        settled[order] = ~single
        probe[order] = open_ | (~single & new_span & has_open[key_no])
        out, at = [], 0
        for b, p in zip(table.column("batch").to_pylist(), pos, strict=True):
            x, y = p[settled[at:at + len(p)]], p[probe[at:at + len(p)]]
            at += len(p)
            if len(x) or len(y):
                out.append((b, pack_positions(x), pack_positions(y)))
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"batch": pa.array(cols[0], pa.int64()), "pos": pa.array(cols[1], pa.binary()),
                         "probe": pa.array(cols[2], pa.binary()), "extra": pa.nulls(len(out), pa.binary())})

    return entries.groupBy("bucket").applyInArrow(find, "batch long, pos binary, probe binary, extra binary")


def by_document(found: DataFrame) -> DataFrame:
    """``rid, settled, probe``: numbers of a text's picks, ascending."""
    def deal(table: pa.Table) -> pa.Table:
        rids = first = None
        lists: tuple[list, list] = ([], [])
        for pos, probe, extra in zip(*(table.column(c) for c in ("pos", "probe", "extra"))):
            if extra.is_valid:
                both = np.frombuffer(extra.as_py(), dtype=np.int64)
                rids, first = both[:len(both) // 2], both[len(both) // 2:]
            else:
                lists[0].append(unpack_positions(pos.as_py()))
                lists[1].append(unpack_positions(probe.as_py()))
        rows = []
        if lists[0]:
            settled, probe = (np.sort(np.concatenate(x)) for x in lists)
            a, b = np.searchsorted(settled, first), np.searchsorted(probe, first)
            for d in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)):
                rows.append((int(rids[d]), pack_positions(settled[a[d]:a[d + 1]] - first[d]),
                             pack_positions(probe[b[d]:b[d + 1]] - first[d])))
        cols = list(zip(*rows)) or [[], [], []]
        return pa.table({"rid": pa.array(cols[0], pa.int64()), "settled": pa.array(cols[1], pa.binary()),
                         "probe": pa.array(cols[2], pa.binary())})

    return found.groupBy("batch").applyInArrow(deal, "rid long, settled binary, probe binary")


def string_entries(texts: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """Of ``rid, text, settled, probe``: positions to look into by bucket of
    their name, and a directory of the texts with their settled covers.
    Positions count through the texts of a batch, one apart."""
    def run(batches):
        for batch, raw in text_batches(batches, 1, 1 << 23):
            rids, settled, probe = (batch.column(i) for i in (0, 2, 3))
            base = np.cumsum([0] + [len(t) + 1 for t in raw])
            seen = np.zeros(len(raw), dtype=np.int64)
            keys, at, covers = [], [], []
            for piece in pieces(raw, size):
                for d in np.unique(piece.doc):
                    mine = np.flatnonzero(piece.doc[piece.part] == d)
                    go = base[d] + piece.shift[piece.part[mine]]
                    lo, hi = piece.lo[mine], piece.hi[mine]
                    one, two = (unpack_positions(x[int(d)].as_py()) - seen[d] for x in (settled, probe))
                    one, two = (x[(x >= 0) & (x < len(mine))] for x in (one, two))
                    covers.append(np.stack([lo[one] + go[one], hi[one] + go[one] + size], axis=1))
                    if len(two):
                        n = hi[two] - lo[two] + 1
                        p = np.repeat(lo[two] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        keys.append(piece.strings(p))
                        at.append(p + np.repeat(go[two], n))
                    seen[d] += len(mine)
            name, out = rids[0].as_py(), []
            if keys:
                out = list(bucket_rows(np.concatenate(keys), np.concatenate(at), n_buckets))
            cover = np.concatenate(covers) if covers else np.zeros((0, 2), dtype=np.int64)
            out.append((directory_bucket(name, n_buckets), None, None,
                        np.r_[len(raw), rids.to_numpy(), base, cover.ravel()].astype(np.int64).tobytes()))
            yield entry_batch(out, name)

    return texts.select("rid", "text", "settled", "probe").mapInArrow(run, ENTRY)


def merge_spans(hits: DataFrame, size: int) -> DataFrame:
    """``rid, spans``: maximal removed runs [from, to) of bytes, packed."""
    def merge(table: pa.Table) -> pa.Table:
        begin, end = [], []
        for pos, extra in zip(table.column("pos"), table.column("extra")):
            if extra.is_valid:
                told = np.frombuffer(extra.as_py(), dtype=np.int64)
                n = int(told[0])
                rids, base, cover = told[1:n + 1], told[n + 1:2 * n + 2], told[2 * n + 2:].reshape(-1, 2)
                begin.append(cover[:, 0])
                end.append(cover[:, 1])
            else:
                p = unpack_positions(pos.as_py())
                begin.append(p)
                end.append(p + size)
        begin, end = np.concatenate(begin), np.concatenate(end)
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        new = np.r_[True, begin[1:] > end[:-1]] if len(begin) else np.zeros(0, dtype=bool)
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1] if len(begin) else np.zeros(0, dtype=int)
        run = np.stack([begin[new], end[last]], axis=1)
        doc = np.searchsorted(base, run[:, 0], side="right") - 1
        cut = np.searchsorted(doc, np.arange(len(rids) + 1))
        hit = np.flatnonzero(np.diff(cut))
        return pa.table({"rid": pa.array([int(rids[d]) for d in hit], pa.int64()),
                         "spans": pa.array([(run[cut[d]:cut[d + 1]] - base[d]).tobytes() for d in hit], pa.binary())})

    return hits.groupBy("batch").applyInArrow(merge, "rid long, spans binary")


def suffix_dedup(docs: DataFrame, size: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``, one row per row of
    ``docs (doc_id, text)``; ``spans``: removed runs [from, to) of bytes, ``kept``
    the bytes that stay.  ``size``: at least 383 (255 bytes after a pick)."""
    if size < WINDOW - 1 + CORE:
        raise ValueError(f"size must be at least {WINDOW - 1 + CORE}")
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = texts_of(numbered(scratch, docs.select("doc_id", "text")))
    n_bytes = text_bytes(rows)
    picked = scratch.store(by_document(sort_picks(pick_entries(rows, size, buckets_for(n_bytes // 50)))), "picks")
    # merge joins at every size, so that cost and disk follow the input
    texts = rows.select("rid", "text").join(picked.hint("merge"), "rid").sortWithinPartitions("rid")
    spans = scratch.store(merge_spans(repeated_entries(
        string_entries(texts, size, buckets_for(n_bytes // 10))), size), "spans")

    def keep(batches):
        for batch, raw in text_batches(batches, 1):
            out = []
            for text, blob in zip(raw, batch.column(2).to_pylist(), strict=True):
                cut = np.frombuffer(blob or b"", dtype=np.int64).reshape(-1, 2).tolist()
                left, at = [], 0
                for a, b in cut:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                kept = b"".join(left)
                out.append((len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in cut], kept))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return (rows.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "spans")
            .mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, "
                              "spans array<struct<start:long,end:long>>, kept binary"))
