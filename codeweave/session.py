"""Spark session helpers.

The library never creates a session on its own inside operators; this module
is for tests, the bench and the driver entry point.  Settings are the ones a
cluster job would use: AQE on (coalescing, skew join), Arrow for the few
pandas stages, UI off.  The checkpoint directory is read from the session
(``spark.checkpoint.dir``) and only set here when it is unset (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "codeweave") -> SparkSession:
    master = master or os.environ.get("CODEWEAVE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory.  Where none is named, a local
    session gets a scratch one (tests); on a cluster that is an error, since
    executors would not share it."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="codeweave-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make the ``codeweave`` package importable in the executors' Python
    workers (``mapInPandas`` stages unpickle functions from it).

    The package is zipped in memory, written through the Hadoop FileSystem
    API into the session's checkpoint directory (a shared location on a
    cluster) and registered with ``addPyFile``; once per SparkContext."""
    import io
    import uuid
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, names in os.walk(pkg):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    zf.write(full, os.path.join("codeweave", os.path.relpath(full, pkg)))
    root = ensure_checkpoint_dir(spark).rstrip("/")
    target = f"{root}/codeweave-code-{uuid.uuid4().hex[:12]}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)
