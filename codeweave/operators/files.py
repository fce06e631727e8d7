"""File inventory operators: B1-B4, B7, E4, A2 decoding.

A ``files`` table has (project_id, file_path, rel_path, ext, language,
content).  ``file_path`` is the identity used in graph ids and lookups;
``rel_path`` is relative to the project root.  Order between files is the
order of ``file_path`` (the canonical ``file_ord``); it is used directly as a
sort key so no global ranking (a single-partition window) is ever needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import (ANALYZABLE_LANGUAGES, IGNORE_DIRS_DISCOVERY,
                                   LANGUAGE_BY_EXTENSION, SUPPORTED_EXTENSIONS)


def language_of(ext_col) -> F.Column:
    """Language from the lower-cased last suffix; unknown -> NULL."""
    m = F.create_map(*[x for kv in LANGUAGE_BY_EXTENSION.items() for x in map(F.lit, kv)])
    return F.element_at(m, F.lower(ext_col))


def files_from_paths(df: DataFrame) -> DataFrame:
    """Add ``ext`` and ``language`` to (project_id, file_path, rel_path, content)."""
    return (df.withColumn("ext", P.suffix(F.col("rel_path")))
            .withColumn("language", language_of(F.col("ext")))
            .select("project_id", "file_path", "rel_path", "ext", "language", "content"))


def has_ignored_part(rel_path_col, ignored=IGNORE_DIRS_DISCOVERY) -> F.Column:
    """B1: any path component is an ignored directory name."""
    return F.arrays_overlap(F.split(rel_path_col, "/"),
                            F.array(*[F.lit(x) for x in ignored]))


def discover_source_files(files: DataFrame) -> DataFrame:
    """A1 + B1 + B2: files not under an ignored directory whose suffix is
    supported (case-sensitive)."""
    return files.where(~has_ignored_part(F.col("rel_path"))
                       & F.col("ext").isin(*SUPPORTED_EXTENSIONS))


def analyzable(files: DataFrame) -> DataFrame:
    """Keep languages that have an entity extractor."""
    return files.where(F.col("language").isin(*ANALYZABLE_LANGUAGES))


def source_files(files: DataFrame) -> DataFrame:
    """A1..B4 in one step: the files whose entities are extracted."""
    return analyzable(discover_source_files(files))


def files_by_language(files: DataFrame) -> DataFrame:
    """Files grouped by known language, as bounded facts per group
    (count, first and last path); the members stay rows of ``files``."""
    return (files.where(F.col("language").isNotNull())
            .groupBy("project_id", "language")
            .agg(F.count(F.lit(1)).alias("file_count"), F.min("file_path").alias("first_file"),
                 F.max("file_path").alias("last_file")))


def files_of_languages(files: DataFrame) -> DataFrame:
    """E4 in full: every file of a known language under its language."""
    return files.where(F.col("language").isNotNull()).select("project_id", "language", "file_path")


def decode_strict(binary_col) -> F.Column:
    """A2 strict: text, or NULL when the bytes are not valid UTF-8."""
    return F.try_validate_utf8(binary_col.cast("string"))


def decode_lenient(binary_col) -> F.Column:
    """A2 lenient (errors='ignore'): invalid sequences dropped.  A genuine
    U+FFFD is told apart by standing in for it while the text is repaired."""
    stand_in = "\ue000\uf8ff\ue000"
    text = binary_col.cast("string")
    kept = F.replace(text, F.lit("\ufffd"), F.lit(stand_in))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(
        F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit(stand_in), F.lit("\ufffd")))
