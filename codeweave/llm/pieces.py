"""Operator 13: encoding and decoding with a merge-type SentencePiece vocabulary.

A text gets its dummy prefix, blanks become the meta symbol, and its characters
are merged by an agenda: adjacent symbol pairs whose concatenation is a piece
wait in a heap ordered by score, then by position; the best pair is merged while
both of its symbols are as they were when it was put there, and the pairs with
the new neighbours follow.  Symbols that are no piece become byte pieces.

No merge crosses two adjacent characters that no piece holds side by side, so
a text is first cut where the vocabulary proves that: between characters of
different classes (say letters and punctuation), around characters that occur in
no longer piece, and before the meta symbol if no piece has it after another
character.  The segments repeat, and each worker keeps the ids of those
it has met (at most ``KNOWN``).  Every new segment of an Arrow batch is also
encoded by the sentencepiece library and compared; a difference is an error.

Decoding joins the pieces' bytes, turns meta symbols into blanks, drops the
dummy prefix, and reads byte pieces as UTF-8 (a byte that is none gives U+FFFD).

Only vocabularies of merge type with byte fallback, dummy prefix and identity
normalisation, without user-defined or unused pieces, are accepted.

Nothing is shuffled: a hot source or text is only rows of more batches, and long
texts are cut into blocks at proven places, so that a task's memory does not
depend on the length of merges.

Cases: null and empty texts are the end id alone and decode to the empty string;
repeated rows and null doc_ids are rows like others; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import codecs
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_batches

META = "▁"
KNOWN = 800_000
SHORT = 32
BLOCK = 1 << 20

codecs.register_error("codeweave-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        kind, norm = type(spec.pieces.add()), spec.normalizer_spec
        del spec.pieces[-1]
        if (spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback
                or spec.trainer_spec.treat_whitespace_as_suffix or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or spec.denormalizer_spec.precompiled_charsmap
                or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces)):
            raise ValueError(f"{path}: not a merge-type vocabulary with byte fallback and identity normalisation")
        self.ids, self.bytes = {}, [0] * 256
        self.shown: list[bytes] = []
        for i, p in enumerate(spec.pieces):
            if p.type == kind.NORMAL:
                self.ids[p.piece] = i
                self.shown.append(p.piece.replace(META, " ").encode())
            elif p.type == kind.BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
                self.shown.append(bytes([int(p.piece[3:-1], 16)]))
            else:  # control pieces are not shown, the unknown piece is shown as its surface
                self.shown.append(b"" if p.type == kind.CONTROL else spec.trainer_spec.unk_surface.encode())
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kind.CONTROL}
        self.pieces = [p.piece for p in spec.pieces]
        if len(self.pieces) > 1 << 20:
            raise ValueError(f"{path}: over a million pieces")
        place = {x: k for k, x in enumerate(sorted({-spec.pieces[i].score for i in self.ids.values()}))}
        #: piece: place of its score (equal scores share it) and id
        self.order = {p: (place[-spec.pieces[i].score], i) for p, i in self.ids.items()}
        pairs = sorted((self.ids[p[:k]] * (2 * len(self.pieces)) + self.ids[p[k:]], self.order[p][0], i)
                       for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        #: pairs of pieces that make a piece: key, place of its score, its id
        self.pair_keys, self.pair_place, self.pair_piece = np.array(pairs or [(-1, 0, 0)], dtype=np.int64).T.copy()
        self.byte_ids, self.end = set(self.bytes), self.library.eos_id()
        longer = [p for p in self.ids if len(p) > 1]
        inner = set().union(*longer) if longer else set()
        self.split = not any(b == META != a for p in longer for a, b in zip(p, p[1:]))
        self.segments = self._pattern(longer, inner)
        self.alone = next(c for c in map(chr, chain((10,), range(0xE000, 0xF8FF))) if c not in inner)
        self.known: dict[str, bytes] = {}

    def _pattern(self, longer: list[str], inner: set[str]) -> re.Pattern:
        """Segments: characters that pieces hold side by side form classes; a
        segment is a run of one class with the meta symbols before it, or a
        run of characters that occur in no longer piece."""
        group = {c: c for c in inner}

        def root(c):
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c
        for p in longer:
            for a, b in zip(p, p[1:]):
                if META not in (a, b) or not self.split:
                    group[root(a)] = root(b)
        classes: dict[str, list[str]] = {}
        for c in sorted(inner - {META}):
            classes.setdefault(root(c), []).append(re.escape(c))
        sets = ["".join(cs) for cs in sorted(classes.values(), key=len, reverse=True)]
        if not self.split:  # a piece holds a blank after another character: blanks part nothing
            meta = root(META) if META in inner else None
            sets = [f"{cs}{META}" if root(cs[-1]) == meta else cs for cs in sets]
            return re.compile("|".join([*(f"[{cs}]+" for cs in sets), f"{META}+", f"[^{''.join(sets)}{META}]+"]))
        return re.compile("|".join([*(f"{META}*[{cs}]+" for cs in sets), f"{META}+", f"[^{''.join(sets)}{META}]+"]))

    # ---------------------------------------------------------- encoding
    def merged(self, text: str) -> list[int]:
        """Ids of a segment by the agenda of adjacent pairs, a heap."""
        symbols: list[str] = list(text)
        n = len(symbols)
        if n > 1:
            order, shown = self.order.get, self.pieces
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            agenda = []  # numbers: place of the score, position of the pair, piece
            for i in range(n - 1):
                k = order(text[i:i + 2])
                if k:
                    agenda.append((k[0] * n + i) << 20 | k[1])
            heapify(agenda)
            while agenda:
                key = heappop(agenda)
                a, piece = (key >> 20) % n, shown[key & 0xFFFFF]
                b = right[a]
                if b == n or not symbols[a] or symbols[a] + symbols[b] != piece:
                    continue  # one of the two has been merged since
                symbols[a], symbols[b] = piece, ""
                after, before = right[b], left[a]
                right[a] = after
                if after < n:
                    left[after] = a
                    k = order(piece + symbols[after])
                    if k:
                        heappush(agenda, (k[0] * n + a) << 20 | k[1])
                if before >= 0:
                    k = order(symbols[before] + piece)
                    if k:
                        heappush(agenda, (k[0] * n + before) << 20 | k[1])
        return [i for s in symbols if s for i in self.plain(s)]

    def plain(self, symbol: str) -> list[int]:
        """Ids of a symbol that stays: its piece, or the bytes of a character."""
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.bytes[b] for b in symbol.encode()]

    def merged_together(self, segments: list[str]) -> list[bytes]:
        """Packed ids of segments of one length: the agendas of all of them are
        the rows of a matrix, with the place of each adjacent pair's score; a
        step takes the best pair of every row, the first of equal ones."""
        size, far = len(self.pieces), np.iinfo(np.int64).max
        signs = sorted(set("".join(segments)))
        # characters that are no piece get numbers beyond the pieces'
        number = {c: self.ids.get(c, size + k) for k, c in enumerate(signs)}
        symbol = np.array([[number[c] for c in s] for s in segments], dtype=np.int64)
        row, out = np.arange(len(segments)), [b""] * len(segments)

        def places(x, y):
            pair = x * (2 * size) + y
            at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == pair
            return np.where(hit, self.pair_place[at], far), self.pair_piece[at]

        place = places(symbol[:, :-1], symbol[:, 1:])[0]
        while True:
            width = symbol.shape[1]
            best = place.argmin(axis=1) if width > 1 else np.zeros(len(row), dtype=np.int64)
            going = place[np.arange(len(row)), best] < far if width > 1 else np.zeros(len(row), dtype=bool)
            done = symbol[~going]
            raw, odd = done.astype(np.int32).tobytes(), (done >= size).any(axis=1).tolist()
            for k, r in enumerate(row[~going].tolist()):
                out[r] = raw[4 * width * k:4 * width * (k + 1)] if not odd[k] else np.array(
                    [j for i in done[k].tolist() for j in ([i] if i < size else self.plain(signs[i - size]))],
                    dtype=np.int32).tobytes()
            if not going.any():
                return out
            row, symbol, place, best = row[going], symbol[going], place[going], best[going]
            every = np.arange(len(row))
            piece = places(symbol[every, best], symbol[every, best + 1])[1]
            keep = np.arange(width - 1)[None, :]
            symbol = np.take_along_axis(symbol, keep + (keep > best[:, None]), axis=1)
            symbol[every, best] = piece
            if width > 2:
                keep = keep[:, :-1]
                place = np.take_along_axis(place, keep + (keep >= best[:, None]), axis=1)
                for side in (-1, 0):  # the pairs with the new neighbours
                    some = np.flatnonzero((best + side >= 0) & (best + side < width - 2))
                    at = best[some] + side
                    place[some, at] = places(symbol[some, at], symbol[some, at + 1])[0]

    def cut(self, text: str) -> list[str]:
        """Segments of a text with its dummy prefix."""
        return self.segments.findall(META + text.replace(" ", META)) if text else []

    def blocks(self, text: str):
        """Segments in lists of bounded length: long texts are cut before a
        blank that follows another character, where segments end anyway."""
        text = META + text.replace(" ", META) if text else ""
        at = 0
        while at < len(text):
            to = text.find(META, at + BLOCK)
            while to > 0 and text[to - 1] == META:
                to = text.find(META, to + 1)
            to = to if to > 0 and self.split else len(text)
            yield self.segments.findall(text, at, to)
            at = to

    def learn(self, segments: set[str], checked: bool = True) -> None:
        """Ids of segments that were not met before, compared with the library's."""
        fresh, by_length = {}, {}
        for s in segments:
            by_length.setdefault(len(s), []).append(s)
        for n, some in by_length.items():
            fresh.update(zip(some, self.merged_together(some) if n <= SHORT else
                             [np.array(self.merged(s), dtype=np.int32).tobytes() for s in some], strict=True))
        if checked:
            self.compare(fresh)
        self.known.update(fresh)

    def compare(self, fresh: dict[str, bytes]) -> None:
        """Encode segments by the library, many as one text with a character
        between that merges with none."""
        first, between = (np.array(self.merged(x), dtype=np.int32).tobytes() for x in (META, self.alone))
        asked = list(fresh)
        for at in range(0, len(asked), 1024):
            some = asked[at:at + 1024]
            text, want = self.alone + self.alone.join(some), first + between + between.join(fresh[s] for s in some)
            if np.array(self.library.encode(text, num_threads=1), dtype=np.int32).tobytes() != want:
                raise RuntimeError("ids differ from the library's: " + repr(next((s for s in some if np.array(
                    self.library.encode(self.alone + s), dtype=np.int32).tobytes() != first + between + fresh[s]), text)))

    def encode(self, texts: list[str], checked: bool = True) -> list[np.ndarray]:
        """Ids of whole texts, each with the end id."""
        out = [[] for _ in texts]
        blocks = [(k, segments) for k, text in enumerate(texts) for segments in self.blocks(text)]
        new = set().union(*(s for _, s in blocks)).difference(self.known)
        if len(self.known) + len(new) > KNOWN:  # keep the table small
            self.known.clear()
            new = set().union(*(s for _, s in blocks))
        self.learn(new, checked)
        for k, segments in blocks:
            out[k].append(b"".join(map(self.known.__getitem__, segments)))
        for s in new:
            if len(s) > SHORT:
                del self.known[s]
        end = np.array([self.end], dtype=np.int32).tobytes()
        return [np.frombuffer(b"".join([*parts, end]), dtype=np.int32) for parts in out]

    # ---------------------------------------------------------- decoding
    def decode(self, ids) -> str:
        """Text of ids; a control piece is not shown and ends a run of bytes."""
        cuts = [k for k, i in enumerate(ids) if i in self.control]
        parts = [ids[a + 1:b] for a, b in zip([-1, *cuts], [*cuts, len(ids)]) if b > a + 1]
        raw = [b"".join(map(self.shown.__getitem__, p)) for p in parts]
        if raw and raw[0][:1] == b" " and parts[0][0] not in self.byte_ids:
            raw[0] = raw[0][1:]
        return "".join(r.decode("utf-8", "codeweave-each-byte") for r in raw)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, checked: bool = True) -> DataFrame:
    """``doc_id, ids array<int>, decoded``: ids of every whole text with an end
    id, and the text that they decode to; one row per row of ``docs (doc_id,
    text)``.  ``path``: a model file that every executor has."""
    path = path or default_model()
    Scratch(docs.sparkSession, "pieces")  # ships the code, bounds Arrow batches

    def run(batches):
        v = vocabulary(path)
        for batch, raw in text_batches(batches, 1):
            ids = v.encode([t.decode("utf-8", "replace") for t in raw], checked)
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids)
            decoded = [v.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                 pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of a column of id lists (null: empty)."""
    path = path or default_model()
    Scratch(rows.sparkSession, "pieces")

    @F.pandas_udf("string")
    def text_of(ids):
        v = vocabulary(path)
        return ids.map(lambda i: v.decode([] if i is None else i.tolist()))

    return rows.withColumn("decoded", text_of(F.col(column)))
