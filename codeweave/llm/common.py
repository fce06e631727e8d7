"""Helpers shared by the training-data operators.

* ``Scratch``: intermediate tables and plain files in the folder the session
  names in ``spark.checkpoint.dir``.
* ``text_batches``: Arrow batches cut to pieces of bounded bytes, so that the
  numpy work of a task needs the same memory however long the texts are
  (a single text is never cut).
* ``HashIndex`` jobs (``repeated_entries``): find the keys that occur more than
  once among hashed positions, with the positions packed into binary blobs
  instead of one row per position.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_code

U64 = np.uint64
WS_TABLE = bytes(32 if 9 <= i <= 13 else i for i in range(256))
LOWER_TABLE = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


#: Largest batches between the JVM and Python workers (a longer text is a batch of its own).
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 24}


class Scratch:
    """Tables stored under ``<spark.checkpoint.dir>/codeweave-llm/<id>/``.

    ``store`` writes and reads back (lineage is cut: a lost executor recomputes
    nothing upstream); ``drop`` removes a table no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        for key, most in ARROW.items():  # whole texts travel: bound a batch by bytes, too
            now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
            if not now or int(now[1]) > most:
                spark.conf.set(key, str(most))
        root = ensure_checkpoint_dir(spark).rstrip("/")
        self.root = f"{root}/codeweave-llm/{name}-{uuid.uuid4().hex[:12]}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def files(self, name: str) -> SharedFiles:
        return SharedFiles(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_rid`` that names a row in every later scan: its
    ``doc_id`` where all are different and not null; else row numbers, stored
    with the rows (a second scan may be split differently, e.g. after executors
    were lost, and would number them anew)."""
    docs = docs.drop("_rid")
    key = F.col("doc_id").cast("long")
    odd = docs.groupBy(key.alias("k")).count().where("k IS NULL OR count > 1").limit(1).count()
    if not odd:
        return docs.withColumn("_rid", key)
    return scratch.store(docs.withColumn("_rid", F.monotonically_increasing_id()), "rows")


def texts_of(rows: DataFrame) -> DataFrame:
    """``rid, doc_id, text`` (bytes) of numbered rows."""
    return rows.select(F.col("_rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text"))


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Numbered rows whose number is in ``kept (rid)``, without the number."""
    return rows.join(kept.select(F.col("rid").alias("_rid")), "_rid", "left_semi").drop("_rid")


class SharedFiles:
    """Plain files in a shared folder that tasks write and other tasks map into
    memory.  A task writes under a name of its own attempt and reports it in its
    rows, so a repeated task leaves an unread file at worst.  Folders that are
    paths on every machine are mapped; files of another store are read through
    ``pyarrow.fs``."""

    def __init__(self, uri: str):
        self.uri = uri
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.uri

    def __setstate__(self, uri):
        self.__init__(uri)

    def _fs(self):
        from pyarrow import fs
        if self.uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.uri[5:].lstrip("/")
        return fs.FileSystem.from_uri(self.uri)

    def writer(self, name: str):
        files, folder = self._fs()
        files.create_dir(folder, recursive=True)
        return files.open_output_stream(f"{folder}/{name}")

    def put(self, name: str, parts: list[bytes]) -> None:
        """A whole file under a name that repeated tasks give the same bytes:
        written beside it and moved there in one step."""
        files, folder = self._fs()
        own = f"{uuid.uuid4().hex}.part"
        with self.writer(own) as out:
            for part in parts:
                out.write(part)
        files.move(f"{folder}/{own}", f"{folder}/{name}")

    def exists(self, name: str) -> bool:
        files, folder = self._fs()
        return files.get_file_info(f"{folder}/{name}").is_file

    def array(self, name: str, dtype=U64, absent: bytes | None = None) -> np.ndarray:
        """The content of a file, mapped where it can be; ``absent`` stands for
        a file that was never written."""
        if name not in self._open:
            files, folder = self._fs()
            if absent is not None and not self.exists(name):
                got = np.frombuffer(absent, dtype=np.uint8)
            elif files.type_name == "local":
                size = files.get_file_info(f"{folder}/{name}").size
                got = np.memmap(f"{folder}/{name}", dtype=np.uint8, mode="r") if size else np.zeros(0, np.uint8)
            else:
                with files.open_input_file(f"{folder}/{name}") as f:
                    got = np.frombuffer(f.read(), dtype=np.uint8)
            self._open[name] = got
        return self._open[name].view(dtype)


def trim() -> None:
    """Give memory that is no longer used back to the system.  Python workers
    are reused by later stages, and would keep the peak of each."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def text_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 21
                 ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the incoming batches with about ``limit`` bytes of text (one
    row at least), and the texts as bytes (null: empty)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(column).cast(pa.binary()) if not pa.types.is_binary(
            batch.column(column).type) else batch.column(column)
        sizes = np.array([len(t) if t is not None else 0 for t in _views(texts)], dtype=np.int64)
        start, total = 0, 0
        for i in range(n):
            if i > start and total + sizes[i] > limit:
                yield _cut(batch, texts, start, i)
                start, total = i, 0
            total += int(sizes[i])
        yield _cut(batch, texts, start, n)
    BYTE_POWERS.shrink()
    trim()


def _views(texts: pa.Array):
    return (t.as_buffer() if t.is_valid else None for t in texts)


def _cut(batch, texts, start, end):
    part = texts.slice(start, end - start).to_pylist()
    return batch.slice(start, end - start), [t or b"" for t in part]


# ------------------------------------------------------------- hashing
def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed shifts and odd multipliers), in place
    on a fresh copy; a bijection on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.shrink()

    def shrink(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = _cumprod(self.base, size)
            self.down = _cumprod(self.inverse, size)
        return self.up[:n], self.down[:n]


def _cumprod(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
WORD_POWERS = Powers(0xD6E8FEB86659FD93)


def span_hashes(prefix: np.ndarray, down: np.ndarray, start: np.ndarray,
                end: np.ndarray) -> np.ndarray:
    """Rabin-Karp values of [start, end) from the prefix sums of
    ``value[i] * base**i`` modulo 2**64, shifted back to exponent 0."""
    return (prefix[end] - prefix[start]) * down[start]


def prefix_sums(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ``value[i] * base**i`` (one more than values) and the
    inverse powers that ``span_hashes`` needs."""
    up, down = powers.to(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64) * up[:-1], out=out[1:])
    return out, down


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts at once.

    ``hash``: 64-bit value per word; ``start``/``end``: byte positions in
    ``data``; ``first``: index of each text's first word, one entry more than
    texts."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        if lower:
            self.data = self.data.translate(LOWER_TABLE)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.ones(len(raw) + 1, dtype=bool)
        inside[0] = False
        np.greater((raw - np.uint8(9)), 4, out=inside[1:])
        inside[1:] &= raw != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.first = np.searchsorted(self.start, offsets)
        self._raw = raw
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            prefix, down = prefix_sums(self._raw, BYTE_POWERS)
            value = span_hashes(prefix, down, self.start, self.end)
            self._hash = mix64(value ^ mix64((self.end - self.start).astype(U64)))
        return self._hash

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp value of every ``size`` consecutive values (mixed)."""
    if len(values) < size:
        return np.zeros(0, dtype=U64)
    prefix, down = prefix_sums(values, WORD_POWERS)
    start = np.arange(len(values) - size + 1)
    return mix64(span_hashes(prefix, down, start, start + size))


# ------------------------------------------- positions with a repeated key
def pack_positions(pos: np.ndarray) -> bytes:
    """Ascending positions as byte gaps; 255 adds 255 and goes on."""
    gap = np.diff(pos, prepend=np.int64(-1)) - 1
    extra = gap // 255
    if not extra.any():
        return gap.astype(np.uint8).tobytes()
    out = np.full(len(gap) + int(extra.sum()), 255, dtype=np.uint8)
    out[np.cumsum(extra + 1) - 1] = (gap % 255).astype(np.uint8)
    return out.tobytes()


def unpack_positions(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8)
    total = np.cumsum(raw.astype(np.int64))
    last = np.flatnonzero(raw != 255)
    return total[last] + np.arange(len(last))


KEY_BYTES = 7


def bucket_rows(keys: np.ndarray, pos: np.ndarray, n_buckets: int, more: np.ndarray | None = None
                ) -> Iterator[tuple[int, bytes, bytes, bytes | None]]:
    """(bucket, packed positions, packed keys, packed further values) of the
    given ascending positions.

    The bucket and the ``KEY_BYTES`` low bytes that travel come from
    different bits, so two different keys are taken for one only if all of
    log2(buckets) + 56 bits agree; the number of buckets follows the input, so
    that chance per position is the same at every scale (below 1e-10)."""
    bucket = ((keys >> U64(56)) * U64(n_buckets) >> U64(8)).astype(np.int32) if n_buckets <= 256 \
        else (mix64(keys) % U64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    raw = keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    for part in np.split(order, cuts):
        if len(part):
            yield (int(bucket[part[0]]), pack_positions(pos[part]), raw[part].tobytes(),
                   None if more is None else more[part].tobytes())


def unpack_keys(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = raw
    return out.view(U64).ravel()


ENTRY = "bucket int, batch long, pos binary, keys binary, extra binary"


def entry_batch(rows: list[tuple], batch: int) -> pa.RecordBatch:
    """Rows ``(bucket, pos, keys, extra)`` of one batch of texts."""
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array([batch] * len(rows), pa.int64()),
         *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "batch", "pos", "keys", "extra"])


def directory_bucket(batch: int, n_buckets: int) -> int:
    """Directory rows (keys null) pass through buckets of their own."""
    return n_buckets + batch % n_buckets


def repeated_entries(entries: DataFrame) -> DataFrame:
    """Entries ``(bucket, batch, pos, keys, extra)``, positions and keys packed,
    to ``(batch, pos, extra)``: the positions whose key occurs at least twice,
    in any batches; rows without keys pass through.  One group is one bucket: a
    bounded number of positions, because the number of buckets follows the
    input, and a key that fills a third of all positions is a packed array
    here, not rows."""

    def find(table: pa.Table) -> pa.Table:
        if not table.column("keys")[0].is_valid:
            return table.select(["batch", "pos", "extra"])
        batch = table.column("batch").to_pylist()
        pos = [unpack_positions(b) for b in table.column("pos").to_pylist()]
        keys = unpack_keys(table.column("keys").to_pylist())
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        hit = np.zeros(len(keys), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out, at = [], 0
        for b, p in zip(batch, pos, strict=True):
            mine = p[hit[at:at + len(p)]]
            at += len(p)
            if len(mine):
                out.append((b, pack_positions(mine)))
        return pa.table({"batch": pa.array([o[0] for o in out], pa.int64()),
                         "pos": pa.array([o[1] for o in out], pa.binary()),
                         "extra": pa.nulls(len(out), pa.binary())})

    return entries.groupBy("bucket").applyInArrow(find, "batch long, pos binary, extra binary")


def buckets_for(n: int, each: int = 2_000_000, least: int = 64) -> int:
    """Buckets so that one holds about ``each`` positions."""
    return max(least, -(-n // each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: sizes buckets, groups and shards."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


# ------------------------------------------------------------ components
def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges (a, b)``: rows ``(node, comp)`` with the
    smallest node of each component.

    Alternating large-star and small-star rounds; each is two grouped steps
    over the edge list, whose length never grows, so a component that holds a
    third of all nodes is only a hot key: the minimum per node is a partial
    aggregate and the join against it is split by AQE.  Nothing is gathered on
    the driver but one count per round."""
    def both(e):
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def checksum(e):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    cur = scratch.store(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state, step = checksum(cur), 0
    while state[0]:
        step += 1
        nb = both(cur)
        low = nb.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (nb.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        nxt = scratch.store(small, f"{name}-{step}")
        new = checksum(nxt)
        scratch.drop(f"{name}-{step - 1}")
        cur, done = nxt, new == state
        state = new
        if done:
            break
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).unionAll(
        cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
