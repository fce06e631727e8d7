"""Operator 5: packing documents into sequences by a grouping genetic algorithm.

A document is its token ids and one end id.  One longer than a sequence is cut
into whole sequences, its first piece taking the rest; pieces that fill a
sequence are one, all others are packed.  The pieces are dealt at random into
groups of bounded size; each group is solved on several islands.  A solution is
a set of bins.  Crossover injects whole well-filled bins of one parent into the
other, drops the bins that now hold a document twice and best-fits the displaced
documents; mutation empties the worst bins and best-fits their documents.  After
each epoch an island receives the elite of its neighbour.  The documents of
bins that a group could not fill are dealt again over new groups, so that only
one or two bins per many thousand documents stay open.

Cases: null and empty texts are one end id; rows that repeat are packed one by
one; a null doc_id is kept; ties break by the row number; an empty table gives
an empty result; further columns are not read.  Very long texts become many
pieces.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trim
from .tokens import ids_for

END = b"\0\0\0\0"
GROUP = 2048


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    if n <= size:
        return [(0, n)]
    first = n % size
    cuts = ([0] if first else []) + list(range(first, n + 1, size))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def tokenised(docs: DataFrame, path: str, size: int) -> DataFrame:
    """``rid, doc_id, pieces array<struct<start,length,crc>>``."""
    def run(batches):
        ids = ids_for(path)
        for batch in batches:
            rid, doc_id = batch.column(0), batch.column(1)
            column, out = batch.column(2), []
            for i in range(len(column)):
                blob = ids.encode(column[i].as_py() or "") + END
                out.append([{"start": a, "length": m, "crc": zlib.crc32(blob[4 * a:4 * (a + m)])}
                            for a, m in pieces(len(blob) // 4, size)])
            yield pa.RecordBatch.from_arrays(
                [rid, doc_id, pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                                                ("crc", pa.int64())])))],
                names=["rid", "doc_id", "pieces"])
        trim()

    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "rid long, doc_id long, pieces array<struct<start:long,length:long,crc:long>>")


# ------------------------------------------------------ genetic algorithm
def best_fit(bins: list[list[int]], room: list[int], items: list[int], lens: list[int], size: int) -> None:
    """Put ``items``, longest first, into the fullest bin that has room."""
    free = sorted((r, i) for i, r in enumerate(room) if r)
    for x in sorted(items, key=lambda i: -lens[i]):
        n = lens[x]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = size, len(bins)
            bins.append([])
            room.append(size)
        bins[b].append(x)
        room[b] = r - n
        if r > n:
            insort(free, (r - n, b))


def fitness(room: list[int], size: int) -> float:
    """Mean square fill: at equal numbers of bins, full and empty beats half."""
    return sum((1 - r / size) ** 2 for r in room) / max(1, len(room))


def crossover(a, b, lens, size, rng):
    """Inject a random half of ``b``'s well-filled bins into ``a``."""
    bins_b, room_b = b
    limit = sorted(room_b)[len(room_b) // 2]
    taken = [i for i, r in enumerate(room_b) if r <= limit and rng.random() < 0.5]
    inside = {x for i in taken for x in bins_b[i]}
    bins, room, loose = [bins_b[i] for i in taken], [room_b[i] for i in taken], []
    for one, r in zip(*a):
        if inside.isdisjoint(one):
            bins.append(one)
            room.append(r)
        else:
            loose += [x for x in one if x not in inside]
    return place([list(x) for x in bins], room, loose, lens, size)


def mutate(a, lens, size, rng):
    """Empty the worst bins and a few others."""
    bins, room = a
    order = sorted(range(len(bins)), key=lambda i: -room[i])
    gone = set(order[:max(2, len(order) // 50)]) | {rng.randrange(len(bins)) for _ in range(3)}
    loose = [x for i in gone for x in bins[i]]
    left = [i for i in range(len(bins)) if i not in gone]
    return place([list(bins[i]) for i in left], [room[i] for i in left], loose, lens, size)


def place(bins, room, loose, lens, size):
    best_fit(bins, room, loose, lens, size)
    return bins, room


def evolve(lens: list[int], size: int, seed: int, elites: list[np.ndarray], population: int = 4,
           generations: int = 6) -> np.ndarray:
    """Bin number of every item, by the fittest solution found."""
    rng = random.Random(seed)
    pool = [from_numbers(e, lens, size) for e in elites]
    while len(pool) < population:
        some = [i for i in range(len(lens)) if pool and rng.random() < 0.1]
        first, rest = set(some), [i for i in range(len(lens))]
        bins, room = [], []
        best_fit(bins, room, some, lens, size)
        best_fit(bins, room, [i for i in rest if i not in first], lens, size)
        pool.append((bins, room))
    least = -(-sum(lens) // size)
    score = lambda s: (-len(s[0]), fitness(s[1], size))
    for _ in range(generations):
        pool.sort(key=score, reverse=True)
        if len(pool[0][0]) <= least:
            break
        children = [mutate(crossover(*rng.sample(pool, 2), lens, size, rng), lens, size, rng)
                    for _ in range(population // 2)]
        pool = sorted(pool + children, key=score, reverse=True)[:population]
    out = np.zeros(len(lens), dtype=np.int32)
    for b, one in enumerate(max(pool, key=score)[0]):
        out[one] = b
    return out


def from_numbers(numbers: np.ndarray, lens: list[int], size: int):
    n = int(numbers.max()) + 1 if len(numbers) else 0
    bins, room = [[] for _ in range(n)], [size] * n
    for i, b in enumerate(numbers.tolist()):
        bins[b].append(i)
        room[b] -= lens[i]
    return bins, room


# ------------------------------------------------------------- on Spark
STATE = "grp long, island int, rids binary, lens binary, elite binary, migrant binary"


def _islands(items: DataFrame, n_groups: int, islands: int) -> DataFrame:
    """One row per group and island with the group's items packed."""
    def gather(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_numpy()
        order = np.argsort(rid, kind="stable")
        rids, lens = rid[order].tobytes(), table.column("length").to_numpy()[order].astype(np.int32).tobytes()
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * islands, pa.int64()),
                         "island": pa.array(range(islands), pa.int32()),
                         "rids": pa.array([rids] * islands, pa.binary()),
                         "lens": pa.array([lens] * islands, pa.binary()),
                         "elite": pa.array([None] * islands, pa.binary()),
                         "migrant": pa.array([None] * islands, pa.binary())})

    return (items.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(n_groups)))
            .groupBy("grp").applyInArrow(gather, STATE))


def _epoch(state: DataFrame, size: int, epoch: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                lens = np.frombuffer(r.lens, dtype=np.int32).tolist()
                elites = [np.frombuffer(e, dtype=np.int32) for e in (r.elite, r.migrant) if e is not None]
                out.append(evolve(lens, size, hash((r.grp, r.island, epoch)), elites).tobytes())
            yield frame.assign(elite=out, migrant=None)

    return state.repartition("grp", "island").mapInPandas(run, STATE)


def pack(scratch: Scratch, items: DataFrame, size: int, name: str, islands: int = 2, epochs: int = 2) -> DataFrame:
    """``items (rid, length)`` to ``rid, grp, bin, offset, fill``."""
    n = items.count()
    n_groups = max(1, -(-n // GROUP))
    state = scratch.store(_islands(items, n_groups, islands), f"{name}-islands")
    for e in range(epochs):
        if e:
            moved = state.select("grp", ((F.col("island") + 1) % islands).alias("island"),
                                 F.col("elite").alias("guest"))
            state = state.join(moved, ["grp", "island"]).select(
                "grp", "island", "rids", "lens", "elite", F.col("guest").alias("migrant"))
        state = scratch.store(_epoch(state, size, e), f"{name}-epoch{e}")
        scratch.drop(f"{name}-islands" if not e else f"{name}-epoch{e - 1}")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        best = None
        for r in frame.sort_values("island").itertuples():
            lens = np.frombuffer(r.lens, dtype=np.int32).astype(np.int64)
            bins = np.frombuffer(r.elite, dtype=np.int32)
            fill = np.bincount(bins, weights=lens).astype(np.int64)
            score = (len(fill), -float((fill * fill).sum()))
            if best is None or score < best[0]:
                best = score, r, lens, bins, fill
        _, r, lens, bins, fill = best
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(lens[order]) - lens[order]
        first = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1]
        offset = run - np.repeat(run[first], np.diff(np.r_[first, len(order)]))
        return pd.DataFrame({"rid": np.frombuffer(r.rids, dtype=np.int64)[order], "length": lens[order],
                             "grp": r.grp, "bin": bins[order].astype(np.int64), "offset": offset,
                             "fill": fill[bins[order]]})

    return state.groupBy("grp").applyInPandas(
        choose, "rid long, length long, grp long, bin long, offset long, fill long")


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, tight: float = 0.995
                   ) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per
    piece of ``docs (doc_id, text)``; ``tight``: bins of a group filled less
    than this are dealt again."""
    scratch = Scratch(docs.sparkSession, "pack")
    docs = scratch.store(tokenised(docs, tokenizer or default_tokenizer(), size), "ids")
    flat = docs.select("rid", "doc_id", F.posexplode("pieces").alias("piece", "p")).select(
        "rid", "doc_id", F.col("piece").cast("int").alias("piece"), "p.start", "p.length", F.col("p.crc").alias("ids_crc32"))
    # at most one piece of a document is shorter than a sequence, so rid names it
    short, full = flat.where(F.col("length") < size), flat.where(F.col("length") == size)
    one = scratch.store(pack(scratch, short.select("rid", "length"), size, "a"), "first")
    open_ = F.col("fill") < F.lit(int(tight * size))
    two = pack(scratch, one.where(open_).select("rid", "length"), size, "b")
    placed = one.where(~open_).withColumn("round", F.lit(0)).unionAll(two.withColumn("round", F.lit(1)))
    places = placed.select("rid", ((F.col("grp") * 2 + F.col("round")) * F.lit(2 * GROUP * 4) + F.col("bin"))
                           .alias("sequence_id"), "offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return (short.join(places, "rid").select(columns).unionAll(
        full.select("doc_id", "piece", "start", "length", "ids_crc32",
                    (-F.monotonically_increasing_id() - 1).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"))))
