"""Operator 6: near-duplicate vectors by navigable small-world graphs per shard.

Vectors are compared only within a label.  Equal vectors are one class; the
classes of a label are dealt over shards, whose number grows as the root of the
label's size (a shard is bounded by ``LARGEST`` classes), each shard gets a
graph, stored once as a file in the shared folder, and every class queries every
shard of its label, in blocks.  When a graph is built, a fixed number of its own
classes, with those of them that have links, is compared with brute force, and the
beam is widened until their recall passes; the width is stored with the shard.  A
beam that holds only links is widened until it ends below the threshold, so the
number of partners has no cap.  Links are verified by cosine in double
precision.  A block hands out the number of links of each vector and edges that
connect what it linked, not the pairs; components come from these edges.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors with a null label, have no link and are their own
component; vectors of different lengths are never linked; repeated rows are
equal vectors; a null vec_id is a row, its component is named by the smallest
vec_id that is not null; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SharedFiles, components
from .hnsw import Graph

SHARD, LARGEST, BLOCK, BEAM, AUDIT = 8192, 1 << 18, 512, 48, 48
ASKED = 256  # classes of a shard that its audit compares with all of it
NEAREST = 0.95  # share of the ten nearest that an audited beam finds
SAME = 1 - 1e-9  # from here on it is the queried vector itself, which every beam finds


def checked(vectors: DataFrame) -> DataFrame:
    """``rid, vec_id, grp, cls, raw``: ``grp`` (label and length) is null where
    a vector links with nothing; ``raw`` are its doubles."""
    def run(batches):
        for batch in batches:
            grp, cls, raw = [], [], []
            labels, column = batch.column(3).to_pylist(), batch.column(2)
            for i, label in enumerate(labels):
                values = column[i].as_py()
                ok = label is not None and values and None not in values
                x = np.array(values if ok else [], dtype=np.float64) + 0.0
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                grp.append(f"{label}/{len(x)}" if ok else None)
                raw.append(x.tobytes() if ok else None)
                cls.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(grp, pa.string()), pa.array(cls, pa.binary()),
                 pa.array(raw, pa.binary())], names=["rid", "vec_id", "grp", "cls", "raw"])

    return vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label")
    ).mapInArrow(run, "rid long, vec_id long, grp string, cls binary, raw binary")


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_shards(reps: DataFrame, files: SharedFiles, limit: float, recall: float) -> DataFrame:
    """``grp, shard, size``: one stored graph per group, with its audited width."""
    def build(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_numpy()
        order = np.argsort(rid, kind="stable")
        unit = unit_rows([table.column("raw")[int(i)].as_py() for i in order])
        graph = Graph.build(unit, seed=int(table.column("shard")[0].as_py()))
        blob, width = graph.dump(), audited_width(graph, unit, unit, limit, recall)
        head = np.array([len(unit), unit.shape[1], len(blob), width], dtype=np.int64)
        files.put(shard_name(table.column("grp")[0].as_py(), table.column("shard")[0].as_py()),
                  [head.tobytes(), rid[order].tobytes(), table.column("n").to_numpy()[order].astype(np.int64).tobytes(),
                   unit.tobytes(), blob])
        return pa.table({"grp": table.column("grp")[:1], "shard": table.column("shard")[:1],
                         "size": pa.array([len(unit)], pa.int64())})

    return reps.groupBy("grp", "shard").applyInArrow(build, "grp string, shard int, size long")


def shard_name(grp: str, shard: int) -> str:
    return f"{grp.replace('/', 'd')}-{shard}.graph"


def open_shard(files: SharedFiles, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph, int]:
    """rids, class sizes, unit vectors, graph and audited width of a stored shard."""
    raw = files.array(name, np.uint8)
    n, d, size, width = (int(x) for x in raw[:32].view(np.int64))
    rid, count = (raw[32 + 8 * n * i:32 + 8 * n * (i + 1)].view(np.int64) for i in (0, 1))
    at = 32 + 16 * n
    unit = raw[at:at + 8 * n * d].view(np.float64).reshape(n, d)
    at += 8 * n * d
    return rid, count, unit, Graph.load(unit, raw[at:at + size].tobytes()), width


def links_of(graph: Graph, unit: np.ndarray, queries: np.ndarray, width: int, limit: float, first=None):
    """(query, place) of all links found, beams widened until they end below the
    limit; ``first`` is the result of the first search where it is known."""
    rows, found, todo, q32 = [], [], np.arange(len(queries)), queries.astype(np.float32)
    while len(todo):
        (ids, sim), first = first or graph.search(q32[todo], width), None
        hit = (ids >= 0) & (sim >= limit - 1e-4)
        wide = hit.all(axis=1) & (ids.shape[1] < len(unit))
        a, b = np.nonzero(hit & ~wide[:, None])
        rows.append(todo[a])
        found.append(ids[a, b])
        todo, width = todo[wide], width * 4
    a, b = np.concatenate(rows), np.concatenate(found)
    exact = np.concatenate([np.einsum("ed,ed->e", queries[a[i:i + 65536]], unit[b[i:i + 65536]])
                            for i in range(0, len(a), 65536)] or [np.zeros(0)])
    return a[exact >= limit], b[exact >= limit]


def audited_width(graph: Graph, unit: np.ndarray, queries: np.ndarray, limit: float, recall: float) -> int:
    """The beam at which audited classes find at least ``recall`` of the links to other
    vectors, and of the ten nearest, that brute force finds: of ``ASKED`` queries in a fixed
    shuffle, the first ``AUDIT`` and those that have links."""
    order = np.random.default_rng(0).permutation(len(queries))[:ASKED]
    sim = queries[order] @ unit.T
    linked = np.flatnonzero(((sim >= limit) & (sim < SAME)).any(axis=1))[:AUDIT]
    chosen = np.union1d(np.arange(min(AUDIT, len(order))), linked)
    some, sim = queries[order[chosen]], sim[chosen]
    near = np.argsort(-sim, axis=1, kind="stable")[:, :min(10, len(unit))]
    links, width = int(((sim >= limit) & (sim < SAME)).sum()), BEAM
    while width < len(unit):
        ids, best = graph.search(some.astype(np.float32), width)
        got = np.zeros(sim.shape, dtype=bool)
        a, b = np.nonzero(ids >= 0)
        got[a, ids[a, b]] = True
        x, y = links_of(graph, unit, some, width, limit, (ids, best))
        if ((sim[x, y] < SAME).sum() >= recall * links
                and np.take_along_axis(got, near, 1).mean() >= min(recall, NEAREST)):
            break
        width *= 2
    return width


def search_blocks(reps: DataFrame, files: SharedFiles, limit: float) -> DataFrame:
    """``rid, n, a, b``: rows (rid, links in one shard) and edges (a, b)."""
    def find(table: pa.Table) -> pa.Table:
        qid = table.column("rid").to_numpy()
        order = np.argsort(qid, kind="stable")
        qid = qid[order]
        queries = unit_rows([table.column("raw")[int(i)].as_py() for i in order])
        number, edges = np.zeros(len(qid), dtype=np.int64), []
        grp = table.column("grp")[0].as_py()
        for shard in range(table.column("parts")[0].as_py()):
            name = shard_name(grp, shard)
            if not files.exists(name):  # no class fell into this shard
                continue
            rid, count, unit, graph, width = open_shard(files, name)
            for at in range(0, len(queries), BLOCK):
                part = queries[at:at + BLOCK]
                a, b = links_of(graph, unit, part, width, limit)
                a = a + at
                other = qid[a] != rid[b]
                a, b = a[other], b[other]
                np.add.at(number, a, count[b])
                if not len(a):
                    continue
                # place b is joined to its first query; other queries of b are joined to that one
                first = np.full(len(unit), len(qid))
                np.minimum.at(first, b, a)
                places = np.unique(b)
                pair = np.unique(a * len(qid) + first[b])
                x, y = pair // len(qid), pair % len(qid)
                edges += [(rid[places], qid[first[places]]), (qid[x[x != y]], qid[y[x != y]])]
        a = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
        b = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"rid": pa.concat_arrays([pa.array(qid), none]),
                         "n": pa.concat_arrays([pa.array(number), none]),
                         "a": pa.concat_arrays([pa.nulls(len(qid), pa.int64()), pa.array(a)]),
                         "b": pa.concat_arrays([pa.nulls(len(qid), pa.int64()), pa.array(b)])})

    return reps.groupBy("grp", "block").applyInArrow(find, "rid long, n long, a long, b long")


def embedding_dedup(vectors: DataFrame, limit: float = 0.93, recall: float = 0.99) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of
    ``vectors (vec_id, embedding, label)``."""
    scratch = Scratch(vectors.sparkSession, "embed")
    rows = scratch.store(checked(vectors), "rows")
    live = rows.where("grp is not null")
    classes = live.groupBy("grp", "cls").agg(F.min(F.struct("rid", "raw")).alias("x"), F.count("*").alias("n"))
    n = F.count("*")
    sizes = classes.groupBy("grp").agg(
        F.greatest(F.ceil(F.sqrt(n / SHARD)), F.ceil(n / LARGEST)).cast("int").alias("parts"),
        F.ceil(n / (2 * BLOCK)).cast("int").alias("blocks"))
    reps = scratch.store(
        classes.join(sizes, "grp").select("grp", "cls", "x.*", "n", "parts", "blocks")
        .withColumn("shard", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), "blocks").cast("int")),
        "reps")
    files = scratch.files("graphs")
    scratch.store(build_shards(reps.select("grp", "shard", "rid", "n", "raw"), files, limit, recall), "shards")
    found = scratch.store(search_blocks(reps.select("grp", "block", "parts", "rid", "raw"), files, limit), "found")
    comp = components(scratch, found.where("a is not null").select("a", "b"), "links")
    linked = found.where("rid is not null").groupBy("rid").agg(F.sum("n").alias("links"))
    told = (reps.select("grp", "cls", "rid", "n").join(linked, "rid")
            .join(comp.withColumnRenamed("node", "rid"), "rid", "left")
            .select("grp", "cls", (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "rid").alias("root")))
    out = rows.select("rid", "vec_id", "grp", "cls").join(told, ["grp", "cls"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rid").alias("root"))
    names = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return out.join(names, "root").select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
