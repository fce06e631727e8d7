"""Structure-aware chunks (H1, I6-I9, D8) and their enrichment.

One shuffle of text: file rows meet the (small) per-file arrays of their entity
ranges and of the gaps between them on (project_id, file_path).  Function/class
chunks slice the file's line array, the top-level chunk joins its slices at the
gaps; these come from a running coverage count over the ends of the ranges, so no
range join and no per-line scan of all ranges happens.  As rows, the lines outside
every range (D8) are told by the same count over the exploded lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import NO_SUMMARY
from ..functions.text import py_strip, slice_lines, slug, split_lines
from ..sources.store import materialize

FILE_KEY = ["project_id", "file_path"]


def entity_ranges(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Complete entities (name, line, end_line all set) as ranges."""
    f = functions.select(*FILE_KEY, F.lit("function").alias("chunk_type"), "name", "line", "end_line",
                         F.lit(0).alias("kind_ord"), "ord")
    c = classes.select(*FILE_KEY, F.lit("class").alias("chunk_type"), "name", "line", "end_line",
                       F.lit(1).alias("kind_ord"), "ord")
    r = f.unionByName(c)
    return r.where((F.coalesce(F.length("name"), F.lit(0)) > 0) & (F.col("line") > 0) & (F.col("end_line") > 0))


def _files_with_ranges(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    ranges = entity_ranges(functions, classes)
    per_file = (ranges.groupBy(*FILE_KEY)
                .agg(F.array_sort(F.collect_list(F.struct("kind_ord", "ord", "chunk_type", "name", "line",
                                                          "end_line"))).alias("ranges")))
    return (files.select(*FILE_KEY, "rel_path", "language", "content")
            .join(per_file, FILE_KEY, "left")
            .withColumn("lines", split_lines(F.col("content"))))


def _outside_ranges(fj: DataFrame) -> DataFrame:
    """D8 interval anti-join: (FILE_KEY, line, text) of the lines covered by
    no range.  Coverage = running sum of +1 at range starts and -1 after
    range ends, per file (the frame is already partitioned by file)."""
    lines = fj.select(*FILE_KEY, F.posexplode("lines").alias("i", "text")).select(
        *FILE_KEY, (F.col("i") + 1).alias("line"), F.lit(0).alias("_d"), F.lit(2).alias("_k"), "text")
    rng = fj.select(*FILE_KEY, F.explode("ranges").alias("r"))
    starts = rng.select(*FILE_KEY, F.col("r.line").alias("line"), F.lit(1).alias("_d"), F.lit(1).alias("_k"),
                        F.lit(None).cast("string").alias("text"))
    ends = rng.select(*FILE_KEY, (F.col("r.end_line") + 1).alias("line"), F.lit(-1).alias("_d"),
                      F.lit(0).alias("_k"), F.lit(None).cast("string").alias("text"))
    w = (Window.partitionBy(*FILE_KEY).orderBy("line", "_k")
         .rowsBetween(Window.unboundedPreceding, 0))
    return (lines.unionByName(starts).unionByName(ends)
            .withColumn("coverage", F.sum("_d").over(w))
            .where((F.col("_k") == 2) & (F.col("coverage") == 0))
            .select(*FILE_KEY, "line", "text"))


def top_level_lines(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines of each file outside every function/class range."""
    return _outside_ranges(_files_with_ranges(files, functions, classes))


def _ranges_and_gaps(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Per file its ``ranges`` and the ``gaps`` between them, (line, next): lines from ``line``
    to the one before ``next`` (null: to the end) lie in no range.  Narrow rows: no text."""
    ranges = entity_ranges(functions, classes)
    listed = (ranges.groupBy(*FILE_KEY)
              .agg(F.array_sort(F.collect_list(F.struct("kind_ord", "ord", "chunk_type", "name", "line",
                                                        "end_line"))).alias("ranges")))
    steps = ranges.select(*FILE_KEY, F.explode(F.array(
        F.struct(F.lit(1).alias("line"), F.lit(0).alias("d")), F.struct("line", F.lit(1).alias("d")),
        F.struct((F.col("end_line") + 1).alias("line"), F.lit(-1).alias("d")))).alias("e"))
    steps = steps.groupBy(*FILE_KEY, F.col("e.line").alias("line")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*FILE_KEY).orderBy("line")
    steps = (steps.withColumn("next", F.lead("line").over(w))
             .withColumn("coverage", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    gaps = (steps.where("coverage = 0").groupBy(*FILE_KEY)
            .agg(F.array_sort(F.collect_list(F.struct("line", "next"))).alias("gaps")))
    return listed.join(gaps, FILE_KEY, "left")


def chunk_content() -> F.Column:
    """H1: the text of a chunk from its other columns; the id tells a whole file from its top level."""
    path, name, kind = F.col("file_path"), F.col("name"), F.col("chunk_type")
    head = (F.when(kind == "function", F.concat(F.lit("Function: "), name, F.lit("\nFile: "), path))
            .when(kind == "class", F.concat(F.lit("Class: "), name, F.lit("\nFile: "), path))
            .when(F.col("chunk_id").endswith("_top_level"), F.concat(F.lit("File Setup / Top-Level: "), path))
            .otherwise(F.concat(F.lit("File: "), path)))
    return F.concat(head, F.lit("\nLanguage: "), F.col("language"), F.lit("\n\nCode:\n"), F.col("code"))


def with_content(chunks: DataFrame) -> DataFrame:
    """``chunks`` that were stored without ``content``, with it."""
    return chunks.select(*[c for c in chunks.columns if c != "pos"], chunk_content().alias("content"), "pos")


def _chunk(kind, chunk_id, name, line, end_line, code, pos) -> F.Column:
    return F.struct(chunk_id.alias("chunk_id"), kind.alias("chunk_type"), name.alias("name"), line.cast("int").alias("line"),
                    end_line.cast("int").alias("end_line"), code.alias("code"), pos.cast("int").alias("pos"))


def code_chunks(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """H1: function ∪ class ∪ (whole-file or top-level) chunks.

    Output: project_id, chunk_id, chunk_type, name, file_path (relative),
    language, line, end_line, code, content, pos (order within the file).

    The text of a file moves once, to its ranges and gaps; all its chunks are cut there.
    The top level of a path that several files share is put together of all of them."""
    shared = materialize(files.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*FILE_KEY),
                         "shared-paths")
    shares = not shared.isEmpty()
    per_file = _ranges_and_gaps(functions, classes)
    per_file = per_file.join(shared.withColumn("_shared", F.lit(True)), FILE_KEY, "left") if shares else per_file.withColumn(
        "_shared", F.lit(None).cast("boolean"))
    fj = (files.select(*FILE_KEY, "rel_path", "language", "content").join(per_file, FILE_KEY, "left")
          .withColumn("lines", split_lines(F.col("content")))
          .withColumn("slug", slug(P.normpath("rel_path"))))
    n_lines, last = F.size("lines"), F.lit(1 << 20)
    base = P.basename(F.col("rel_path"))

    # Function and class chunks
    def entity(r, i):
        return _chunk(r["chunk_type"], F.concat_ws(
            "_", F.col("slug"), F.when(r["chunk_type"] == "function", F.lit("func")).otherwise(F.lit("class")), slug(r["name"]),
            r["line"].cast("string")), r["name"], r["line"], r["end_line"], slice_lines(F.col("lines"), r["line"], r["end_line"]), i)
    ent = F.filter(F.transform("ranges", entity), lambda x: x["code"].isNotNull() & x["code"].rlike(r"\S"))

    # Whole-file chunk when the file has no complete entity
    given = F.col("content").isNotNull() & (F.col("content") != "")
    whole = F.when(F.col("ranges").isNull() & given, _chunk(
        F.lit("file"), F.concat(F.col("slug"), F.lit("_file")), base, F.lit(1), n_lines,
        py_strip(F.array_join("lines", "\n")), last))
    whole = F.filter(F.array(whole), lambda x: x["code"] != "")

    # I8 + D8: top-level lines (outside every range), if >= 3 are non-blank
    gaps = F.filter(F.coalesce("gaps", F.array().cast("array<struct<line:int,next:int>>")), lambda g: g["line"] <= n_lines)
    outside = F.flatten(F.transform(gaps, lambda g: F.slice(
        "lines", g["line"], F.least(F.coalesce(g["next"], n_lines + 1), n_lines + 1) - g["line"])))
    fj = fj.withColumn("outside", F.when(F.col("ranges").isNotNull() & given & F.col("_shared").isNull(), outside))
    top = F.when(F.size(F.filter("outside", lambda x: x.rlike(r"\S"))) >= 3, _top_chunk(
        n_lines, F.array_join("outside", "\n")))
    top = F.filter(F.array(top), lambda x: x.isNotNull())
    none = F.slice(whole, 1, 0)
    out = fj.select("project_id", "rel_path", "language", F.explode(F.concat(
        F.coalesce(ent, none), whole, top)).alias("c"))
    if shares:
        out = out.unionByName(_shared_top_chunks(files.join(shared, FILE_KEY, "left_semi"), functions, classes))
    return with_content(out.select("project_id", "c.chunk_id", "c.chunk_type", "c.name", F.col("rel_path").alias("file_path"),
                                   "language", "c.line", "c.end_line", "c.code", "c.pos"))


def _top_chunk(n_lines, text) -> F.Column:
    return _chunk(F.lit("file"), F.concat(F.col("slug"), F.lit("_top_level")),
                  F.concat(P.basename(F.col("rel_path")), F.lit(" (top-level)")), F.lit(1), n_lines, py_strip(text), F.lit(1 << 20))


def _shared_top_chunks(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Top-level chunks of files that share a path: each has the lines of all of them."""
    withr = (_files_with_ranges(files, functions, classes).withColumn("slug", slug(P.normpath("rel_path")))
             .where(F.col("ranges").isNotNull() & F.col("content").isNotNull() & (F.col("content") != "")))
    top = (_outside_ranges(withr).groupBy(*FILE_KEY)
           .agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("tl"),
                F.count_if(F.col("text").rlike(r"\S")).alias("non_blank")))
    top = (top.where(F.col("non_blank") >= 3)
           .join(withr.select(*FILE_KEY, "rel_path", "language", "slug", F.size("lines").alias("n")), FILE_KEY))
    return top.select("project_id", "rel_path", "language", _top_chunk(
        F.col("n"), F.array_join(F.transform("tl", lambda x: x["text"]), "\n")).alias("c"))


def document_text() -> F.Column:
    """The document that stands for an enriched chunk, from its other columns."""
    ctype = F.concat(F.upper(F.substring("chunk_type", 1, 1)), F.lower(F.expr("substring(chunk_type, 2)")))
    header = F.concat_ws("\n", F.concat(F.lit("Type: "), ctype), F.concat(F.lit("Name: "), F.col("name")),
                         F.concat(F.lit("File: "), F.col("file_path")),
                         F.concat(F.lit("Language: "), F.col("language")),
                         F.when(F.col("summary").isNotNull() & (F.col("summary") != ""),
                                F.concat(F.lit("Summary: "), F.col("summary"))))
    return F.concat(header, F.lit("\n\nCode:\n"), F.col("code"))


def enrich_chunks(chunks: DataFrame, function_summaries: DataFrame | None = None,
                  file_summaries: DataFrame | None = None) -> DataFrame:
    """D9 + D10 + I9: attach the summary of a function chunk (by relative
    path and name, else base name and name) or a file chunk (by relative
    path, else base name); the last summary of a key wins, the sentinel and
    blanks are ignored.  ``content`` becomes the enriched document text.

    Summaries: function (project_id, file_path, ord, name, summary),
    file (project_id, file_path, summary)."""
    # a summary follows from these columns: they meet the summaries, the text of a chunk only what they found
    key = ["project_id", "chunk_type", "file_path", "name"]

    def usable(df):
        return df.where(F.col("summary").isNotNull() & (F.col("summary") != "") & (F.col("summary") != NO_SUMMARY))

    c = chunks.select(*key).distinct().withColumn("_base", P.basename(F.col("file_path")))
    found = []
    if function_summaries is not None:
        fs = usable(function_summaries).withColumn("_o", F.struct("file_path", "ord"))
        by_path = fs.groupBy("project_id", "file_path", "name").agg(F.max_by("summary", "_o").alias("_path"))
        by_base = (fs.withColumn("_base", P.basename(F.col("file_path")))
                   .groupBy("project_id", "_base", "name").agg(F.max_by("summary", "_o").alias("_by_base")))
        found.append(c.where("chunk_type = 'function'").join(by_path, ["project_id", "file_path", "name"], "left")
                     .join(by_base, ["project_id", "_base", "name"], "left"))
    if file_summaries is not None:
        fls = usable(file_summaries)
        f_path = fls.groupBy("project_id", "file_path").agg(F.max_by("summary", "file_path").alias("_path"))
        f_base = (fls.withColumn("_base", P.basename(F.col("file_path")))
                  .groupBy("project_id", "_base").agg(F.max_by("summary", "file_path").alias("_by_base")))
        found.append(c.where("chunk_type = 'file'").join(f_path, ["project_id", "file_path"], "left")
                     .join(f_base, ["project_id", "_base"], "left"))
    if found:
        rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        rows = rows.select(*key, F.coalesce("_path", "_by_base").alias("summary")).where("summary IS NOT NULL")
        c = chunks.drop("summary").join(rows, key, "left")
    else:
        c = chunks.withColumn("summary", F.lit(None).cast("string"))
    out = c.withColumn("content", document_text())
    return out.select(*[x for x in chunks.columns if x not in ("content", "summary")], "content", "summary")
