"""A1 + A2 + B7: source trees on a (distributed) file system as a ``files``
table.

Every first-level directory under ``root`` is one project (``project_id`` =
directory name).  Spark's file sources leave out names that begin with ``_`` or
``.``, among them every ``__init__.py`` and ``.gitignore``, so the trees are
listed here, level by level: the directories of a level are rows that are dealt over
all tasks, what they hold is stored in pages, and its directories are the next level.
A project of many directories is many tasks, and no task holds more than the names
of one directory.  The files, dealt anew, are read on the executors.
Contents are decoded with the strict (NULL on invalid UTF-8) or lenient rule.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import SUPPORTED_EXTENSIONS
from ..operators.files import decode_lenient, decode_strict, files_from_paths
from ..session import ship_code
from .store import materialize, spread

READ_ROWS = 64  # files of one Arrow batch
LIST_ROWS = 4096  # names of one page of a listing


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme and authority of its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def list_corpus(spark: SparkSession, root: str, names: list[str] | None = None,
                suffixes: list[str] | None = None) -> DataFrame:
    """(project_id, file_path, rel_path) of every file of every project
    directory, hidden names included; ``names`` / ``suffixes`` keep files with
    one of these names / (case-sensitive) suffixes."""
    ship_code(spark)
    uri = qualified(spark, root)
    schema = "project_id string, file_path string, rel_path string, is_dir boolean"

    def expand(batches):
        from pyarrow import fs
        files, top = _open(uri)
        for batch in batches:
            for project, path, rel in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = files.get_file_info(fs.FileSelector(path or top))
                keep = [i for i in found if i.type == fs.FileType.Directory or (
                    i.type == fs.FileType.File and project is not None and (names is None or i.base_name in names)
                    and (suffixes is None or any(i.base_name.endswith(x) for x in suffixes)))]
                for at in range(0, len(keep), LIST_ROWS):
                    page = keep[at:at + LIST_ROWS]
                    below = [i.base_name if not rel else f"{rel}/{i.base_name}" for i in page]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.base_name if project is None else project for i in page], pa.string()),
                         pa.array([i.path for i in page], pa.string()),
                         pa.array(["" if project is None else r for r in below], pa.string()),
                         pa.array([i.type == fs.FileType.Directory for i in page])],
                        names=["project_id", "file_path", "rel_path", "is_dir"])

    places = ["project_id", "file_path", "rel_path"]
    level = spark.createDataFrame([(None, None, "")], "project_id string, file_path string, rel_path string")
    listed = None
    while True:  # one round per level of the trees
        found = materialize(spread(level).mapInArrow(expand, schema), "listing")
        files = found.where("NOT is_dir").select(places)
        listed = files if listed is None else listed.unionAll(files)
        level = found.where("is_dir").select(places)
        if level.isEmpty():
            return listed


def _read(listed: DataFrame, uri: str) -> DataFrame:
    """The listed files with their bytes."""
    def read(batches):
        files, _ = _open(uri)
        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                part, data = batch.slice(at, READ_ROWS), []
                for path in part.column(1).to_pylist():
                    with files.open_input_stream(path) as f:
                        data.append(f.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())],
                                                 names=["project_id", "file_path", "rel_path", "content"])

    return spread(listed).mapInArrow(read, "project_id string, file_path string, rel_path string, content binary")


def read_corpus(spark: SparkSession, root: str, source_only: bool = True, strict: bool = True) -> DataFrame:
    """(project_id, file_path, rel_path, ext, language, content) for every
    file of every project directory under ``root``.

    ``source_only`` restricts the listing to the supported suffixes (A1,
    case-sensitive); without it every file is read (config files for project
    metadata, E5-E11)."""
    decode = decode_strict if strict else decode_lenient
    listed = list_corpus(spark, root, suffixes=list(SUPPORTED_EXTENSIONS) if source_only else None)
    return files_from_paths(_read(listed, qualified(spark, root)).select(
        "project_id", "file_path", P.normpath("rel_path").alias("rel_path"), decode(F.col("content")).alias("content")))


def read_config_files(spark: SparkSession, root: str) -> DataFrame:
    """Config files of every project under ``root`` (requirements.txt,
    package.json, ...), picked by name so that only their contents are read;
    input of ``project.project_info(tree, configs)``."""
    from ..operators.project import CONFIG_NAMES
    return _read(list_corpus(spark, root, names=list(CONFIG_NAMES)), qualified(spark, root)).select(
        "project_id", P.normpath("rel_path").alias("rel_path"), decode_lenient(F.col("content")).alias("content"))
