"""Stored intermediate tables and the vector store layout.

``materialize`` writes a DataFrame as parquet under the shared directory the
cluster names in ``spark.checkpoint.dir`` and reads it back: the plan runs
once, lineage is cut (a lost executor recomputes nothing upstream), and
later readers get column pruning and filter pushdown.
"""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def scratch_path(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/codeweave/{name}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: dict[int, list] = {}
_lock = threading.Lock()


@contextmanager
def _shuffles_dropped(spark):
    """The shuffle files of the writes inside go when these end (else they stay until the
    driver collects its garbage).  Writes run side by side: the last one restores the setting."""
    with _lock:
        held = _writing.setdefault(id(spark), [0, None])
        if not held[0]:
            held[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _writing[id(spark)]
                spark.conf.unset(_CLEANUP) if held[1] is None else spark.conf.set(_CLEANUP, held[1])


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    path = scratch_path(df, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with _shuffles_dropped(df.sparkSession):
        w.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_all(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """``materialize`` of tables that do not need one another, as jobs that run side by side."""
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        return list(pool.map(lambda t: materialize(t[1], t[0]), tables.items()))


class SharedTables:
    """Small Arrow tables as files in the shared folder, which tasks write under names
    of their own and other tasks map into memory (or read, where the folder is no path)."""

    def __init__(self, uri: str):
        self.uri = uri

    def _fs(self):
        from pyarrow import fs
        if self.uri.startswith("file:") or self.uri.startswith("/"):
            return fs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, table, compression: str | None = None) -> None:
        """Written beside its place and moved there: a task that runs twice gives the same file."""
        import pyarrow as pa
        files, folder = self._fs()
        files.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
        own = f"{folder}/{uuid.uuid4().hex}.part"
        with files.open_output_stream(own) as out, pa.ipc.new_file(
                out, table.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as writer:
            writer.write_table(table)
        files.move(own, f"{folder}/{name}")

    def names(self, part: str) -> list[str]:
        """Names of the tables below ``part/``."""
        from pyarrow import fs
        files, folder = self._fs()
        found = files.get_file_info(fs.FileSelector(f"{folder}/{part}", allow_not_found=True))
        return sorted(f"{part}/{i.base_name}" for i in found if i.is_file)

    def get(self, name: str):
        """The table, or None where none was written."""
        import pyarrow as pa
        files, folder = self._fs()
        path = f"{folder}/{name}"
        if not files.get_file_info(path).is_file:
            return None
        if files.type_name == "local":
            return pa.ipc.open_file(pa.memory_map(path)).read_all()
        with files.open_input_file(path) as f:
            return pa.ipc.open_file(f).read_all()


# ---------------------------------------------------------------- A5-A8
class VectorStore:
    """Chunk vectors as a parquet table partitioned by ``project_id``.

    upsert (A5): old rows whose (project, id) is not in the batch, plus the
    batch; replace_projects (A7): the batch becomes all there is of its
    projects, and of those named besides; delete_project (A6): drop a project's
    partition; scan (A8): partition-pruned read of one or more projects.

    Project ids stay strings whatever they look like.  A rewrite is staged and
    swapped at the commit of the job: a job that fails before leaves the old
    rows (a crash during the commit can leave a part of the partitions new).
    """

    def __init__(self, spark, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _fs_path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs_path(self.path)
        return fs.exists(p)

    def read(self):
        """All rows; the type of the partition column is given, not guessed
        from directory names (``001`` is no number)."""
        guessed = self.spark.read.parquet(self.path).schema
        fields = [T.StructField(f.name, T.StringType()) if f.name == "project_id" else f for f in guessed.fields]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)

    def scan(self, project_ids: list[str] | None = None):
        df = self.read()
        if project_ids is not None:
            df = df.where(df.project_id.isin(*project_ids))
        return df

    def _write_dynamic(self, df):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("project_id").parquet(self.path))

    def replace_projects(self, batch, project_ids: list[str] | None = None):
        """Every project present in ``batch`` is replaced by the batch;
        projects of ``project_ids`` without rows in it end up empty."""
        batch = materialize(batch, "vector-batch")
        if project_ids:
            there = {r[0] for r in batch.select("project_id").where(
                batch.project_id.isin(*project_ids)).distinct().collect()}  # named projects at most
            for p in project_ids:
                if p not in there:
                    self.delete_project(p)
        self._write_dynamic(batch)
        return self.read()

    def upsert(self, batch) -> int:
        """A5: insert or update by (project_id, id); returns the number of rows
        written.  The batch is evaluated once; of rows that repeat an id one
        stays.  Only the partitions of the batch's projects are rewritten."""
        one = Window.partitionBy("project_id", "id").orderBy(F.xxhash64(*[c for c in batch.columns]))
        batch = materialize(batch.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"), "vector-batch")
        n = batch.count()
        if not self.exists():
            batch.write.mode("overwrite").partitionBy("project_id").parquet(self.path)
            return n
        # only the batch's projects are read (semi join on the partition
        # column -> dynamic partition pruning) and rewritten
        touched = batch.select("project_id").distinct()
        old = self.read().join(touched, "project_id", "left_semi")
        merged = old.join(batch.select("project_id", "id"), ["project_id", "id"], "left_anti").unionByName(batch)
        # the rewrite of a partition reads it first: stage to a side path
        self._write_dynamic(materialize(merged, "vector-upsert"))
        return n

    def delete_project(self, project_id: str) -> None:
        """Remove the partition of one project (named as Spark names it)."""
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(
            "project_id", project_id)
        fs, p = self._fs_path(f"{self.path}/{name}")
        if fs.exists(p):
            fs.delete(p, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal the rows of a Python (Arrow) stage evenly over the tasks: small
    stored tables scan as one or two partitions, and a model call on them would
    run on one or two cores.  The same at every size.  With ``by``, rows that are
    near in its order stay together."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, *by) if by else df.repartition(n)


def enough_partitions(spark, amount: int, each: int) -> int:
    """Partitions that hold ``each`` of ``amount`` (bytes of text, rows), one per core at
    least.  AQE joins partitions by their compressed size, in which text and repeated
    names are a small part of what a task sorts; a number that is given stays."""
    return max(spark.sparkContext.defaultParallelism, -(-int(amount or 0) // each))
