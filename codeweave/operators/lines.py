"""Line model (A3, A4) and per-line lexical features.

Everything downstream of :func:`partition_files` is computed with windows
partitioned by ``(project_id, file_path)`` (or a superset of it), so after the
one hash repartition of the file rows no further exchange is needed: the
window, generate and grouped-aggregate operators reuse that partitioning and
only sort inside partitions.  A file is never split and a project is never
gathered into one task, so a project holding a third of the corpus still
spreads over all partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexer import IN_LITERAL, mask_code
from ..functions.text import split_lines

FILE_KEY = ["project_id", "file_path"]


def partition_files(files: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition file rows by (project_id, file_path): the one shuffle of
    the extraction job.  The number of partitions is the caller's, else that of
    the session (AQE coalesces small ones)."""
    if num_partitions:
        return files.repartition(num_partitions, *FILE_KEY)
    return files.repartition(*FILE_KEY)


def file_lines(files: DataFrame) -> DataFrame:
    """A4: (project_id, file_path, language, line, text, code), line 1-based;
    ``code`` is the line with literals and comments masked (functions/lexer)."""
    masked = split_lines(mask_code(F.col("content"), F.col("language")))
    both = F.arrays_zip(split_lines(F.col("content")).alias("text"), masked.alias("code"))
    return (files.select(*FILE_KEY, "language", F.posexplode(both).alias("pos", "both"))
            .select(*FILE_KEY, "language", (F.col("pos") + 1).alias("line"), "both.text",
                    F.coalesce("both.code", F.lit("")).alias("code")))


def _count(col, chars: str):
    """Occurrences of the given characters in a string (plain replaces, no regex)."""
    total = None
    for ch in chars:
        n = F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))
        total = n if total is None else total + n
    return total


def line_features(lines: DataFrame) -> DataFrame:
    """Add lexical features used by the extent rules.

    code         : masked line without the literal mark at its start
    is_content   : not blank and not a comment-only line
    in_string    : line starts inside a literal that began on an earlier line
    depth_before / depth_after / depth_min : running '{' '}' depth (C family)
    paren_before / paren_after : running bracket depth
    """
    w_prev = Window.partitionBy(*FILE_KEY).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    is_py = F.col("language") == "Python"
    df = lines.withColumn("in_string", F.col("code").startswith(IN_LITERAL))
    df = df.withColumn("code", F.regexp_replace("code", "^" + IN_LITERAL, ""))

    raw_blank = F.col("text").rlike(r"^\s*$")
    comment_only = F.col("code").rlike(r"^\s*$") & ~raw_blank & ~F.col("in_string")
    df = df.withColumn("is_content", ~raw_blank & ~comment_only)

    # brace depth (C family) and bracket depth (all)
    opens = _count(F.col("code"), "{")
    closes = _count(F.col("code"), "}")
    lead = _count(F.substring_index(F.col("code"), "{", 1), "}")
    df = (df.withColumn("_d", opens - closes).withColumn("_lead", lead)
          .withColumn("has_open_brace", opens > 0))
    df = df.withColumn("depth_before", F.coalesce(F.sum("_d").over(w_prev), F.lit(0)).cast("int"))
    df = df.withColumn("depth_after", (F.col("depth_before") + F.col("_d")).cast("int"))
    df = df.withColumn("depth_min", F.least(F.col("depth_after"),
                                            F.col("depth_before") - F.col("_lead")).cast("int"))
    pd = _count(F.col("code"), "([{") - _count(F.col("code"), ")]}")
    pd = F.when(is_py, pd).otherwise(_count(F.col("code"), "(") - _count(F.col("code"), ")"))
    df = df.withColumn("_pd", pd)
    df = df.withColumn("paren_before", F.coalesce(F.sum("_pd").over(w_prev), F.lit(0)).cast("int"))
    df = df.withColumn("paren_after", (F.col("paren_before") + F.col("_pd")).cast("int"))
    df = df.withColumn("indent", F.length(F.regexp_extract("text", r"^[ \t]*", 0)))
    return df.drop("_d", "_lead", "_pd")


def next_close(opens: DataFrame, closes: DataFrame, level_col: str = "level",
               payload_col: str = "close_at") -> DataFrame:
    """For every open row (FILE_KEY, level, line, open_id) the payload of the
    first close row (FILE_KEY, level, line, close_at) at the same level with a
    greater line.

    One window per (file, level) ordered by descending line with a growing
    frame: linear, and it reuses the per-file partitioning.  This replaces a
    range join (which would test every later line of a file)."""
    ev = (opens.select(*FILE_KEY, level_col, "line", F.lit(1).alias("_kind"), "open_id",
                       F.lit(None).cast("int").alias(payload_col))
          .unionByName(closes.select(*FILE_KEY, level_col, "line", F.lit(0).alias("_kind"),
                                     F.lit(None).cast("long").alias("open_id"), payload_col)))
    w = (Window.partitionBy(*FILE_KEY, level_col)
         .orderBy(F.desc("line"), F.desc("_kind"))
         .rowsBetween(Window.unboundedPreceding, -1))
    return (ev.withColumn("_next", F.last(payload_col, ignorenulls=True).over(w))
            .where(F.col("_kind") == 1)
            .select(*FILE_KEY, "open_id", F.col("_next").alias(payload_col)))


def innermost_enclosing(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (FILE_KEY, point_id, line) the innermost range
    (FILE_KEY, range_id, line, end_line) containing it, and the coverage
    count (number of ranges containing it).

    Ranges are nested or disjoint (laminar).  A running sum of +1 at starts
    and -1 after ends gives the coverage of a point and the depth of a range;
    the innermost range around a point of coverage d is the latest range of
    depth d that started at or before it (window per (file, depth)).  Linear
    in the number of rows; no range join."""
    starts = ranges.select(*FILE_KEY, "line", F.lit(1).alias("_k"), F.lit(1).alias("_delta"),
                           "range_id", F.col("end_line").alias("_end"),
                           F.lit(None).cast("long").alias("point_id"))
    ends = ranges.select(*FILE_KEY, (F.col("end_line") + 1).alias("line"), F.lit(0).alias("_k"),
                         F.lit(-1).alias("_delta"), F.lit(None).cast("long").alias("range_id"),
                         F.col("end_line").alias("_end"), F.lit(None).cast("long").alias("point_id"))
    pts = points.select(*FILE_KEY, "line", F.lit(2).alias("_k"), F.lit(0).alias("_delta"),
                        F.lit(None).cast("long").alias("range_id"), F.lit(None).cast("int").alias("_end"),
                        "point_id")
    ev = starts.unionByName(ends).unionByName(pts)
    order = [F.col("line"), F.col("_k"), F.desc("_end"), F.col("range_id")]
    w_run = Window.partitionBy(*FILE_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("depth", F.sum("_delta").over(w_run)).where(F.col("_k") != 0)
    w_lvl = Window.partitionBy(*FILE_KEY, "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_inner", F.last("range_id", ignorenulls=True).over(w_lvl))
    return (ev.where(F.col("_k") == 2)
            .select(*FILE_KEY, "point_id",
                    F.when(F.col("depth") > 0, F.col("_inner")).alias("range_id"),
                    F.col("depth").cast("int").alias("coverage")))
