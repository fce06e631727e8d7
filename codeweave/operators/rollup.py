"""Summary roll-up function -> file -> module -> project (E20-E24, D11-D13,
F1, F2, G5, I11-I13, L15) through a pluggable inference function (N1).

Batches (F1) are numbered per project without gathering a project's items
into one task: items are ranked inside their file, files get running
offsets from a range-partitioned sort of the per-file count table (a hot
project spreads over many partitions), and item number = file offset +
rank in file.  Prompts are built per (project, batch) from
at most ``size`` items, model responses are stored once (a retried task
must not call the model again), parsed with ``regexp_extract_all`` and
zipped back to the items by (project, batch, position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import NO_SUMMARY, SUMMARY_BATCH_SIZE
from ..functions.text import py_strip, slice_lines, split_lines, truncate_code
from ..sources.store import materialize
from .infer import infer

FILE_KEY = ["project_id", "file_path"]

# FIXED VALUES: response format (numbered lines) and project answer labels
ITEM_PATTERN = r"(?md)^\[(\d+)\]\s*(.+)"
FENCE = "```"


@dataclass
class BatchRun:
    summaries: DataFrame   # items of complete batches with their summary
    errors: DataFrame      # (project_id, level, batch_no, pos) missing or empty answers
    responses: DataFrame   # (project_id, batch_no, n, prompt, response)


def group_offsets(per: DataFrame, group_col: str) -> DataFrame:
    """Running offsets of ordered groups inside each project without a
    per-project window: rows (project_id, group_col, _n) are range-partitioned
    by (project_id, group_col), so a project with millions of groups spreads
    over many partitions in order; offsets = prefix of the per-(partition,
    project) totals (a table of at most partitions x projects rows) + running
    sum inside the partition.  Adds ``_off`` and ``_total``."""
    ranged = (per.repartitionByRange("project_id", group_col)
              .withColumn("_pid", F.spark_partition_id()))
    ranged = materialize(ranged, "group-offsets")
    w_in = (Window.partitionBy("_pid", "project_id").orderBy(group_col)
            .rowsBetween(Window.unboundedPreceding, -1))
    inner = ranged.withColumn("_in", F.coalesce(F.sum("_n").over(w_in), F.lit(0)))
    tot = ranged.groupBy("_pid", "project_id").agg(F.sum("_n").alias("_part"))
    w_p = Window.partitionBy("project_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    tot = (tot.withColumn("_before", F.coalesce(F.sum("_part").over(w_p), F.lit(0)))
           .withColumn("_total", F.sum("_part").over(Window.partitionBy("project_id"))))
    return (inner.join(tot, ["_pid", "project_id"])
            .select("project_id", group_col, "_n", (F.col("_before") + F.col("_in")).alias("_off"), "_total"))


def number_batches(items: DataFrame, size: int = SUMMARY_BATCH_SIZE,
                   group_col: str = "file_path", order_col: str = "ord") -> DataFrame:
    """F1 + F2: batch_no, pos, n_batches and the batch's item count for
    items ordered by (group_col, order_col) inside each project."""
    w_in = Window.partitionBy("project_id", group_col).orderBy(order_col)
    it = items.withColumn("_r", F.row_number().over(w_in))
    per = it.groupBy("project_id", group_col).agg(F.count(F.lit(1)).alias("_n"))
    it = it.join(group_offsets(per, group_col), ["project_id", group_col])
    rn = F.col("_off") + F.col("_r")
    n_batches = F.ceil(F.col("_total") / F.lit(size)).cast("int")
    batch_no = (F.floor((rn - 1) / size) + 1).cast("int")
    it = (it.withColumn("batch_no", batch_no)
          .withColumn("pos", (F.pmod(rn - 1, F.lit(size)) + 1).cast("int"))
          .withColumn("n_batches", n_batches)
          .withColumn("batch_count", F.least(F.lit(size), F.col("_total") - (batch_no - 1) * size).cast("int")))
    return it.drop("_r", "_n", "_off", "_total")


def max_tokens(count_col, per_item: int) -> F.Column:
    """response budget max(500, per_item * n)."""
    return F.greatest(F.lit(500), count_col * per_item)


def parse_numbered(responses: DataFrame) -> DataFrame:
    """(project_id, batch_no, idx, text) from numbered answer lines;
    text stripped, code fences removed, the last duplicate of an index wins."""
    idx = F.regexp_extract_all(F.col("response"), F.lit(ITEM_PATTERN), 1)
    txt = F.regexp_extract_all(F.col("response"), F.lit(ITEM_PATTERN), 2)
    ex = responses.select("project_id", "batch_no", F.posexplode(F.arrays_zip(idx.alias("i"), txt.alias("t")))
                          .alias("k", "m"))
    ex = ex.select("project_id", "batch_no", "k", F.col("m.i").try_cast("int").alias("idx"),
                   F.replace(py_strip(F.col("m.t")), F.lit(FENCE), F.lit("")).alias("text"))
    return ex.groupBy("project_id", "batch_no", "idx").agg(F.max_by("text", "k").alias("text"))


def missing_positions(responses: DataFrame, parsed: DataFrame, level: str) -> DataFrame:
    """Positions 1..n without a non-empty answer."""
    want = responses.select("project_id", "batch_no", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pos"))
    got = parsed.where(F.col("text") != "").select("project_id", "batch_no", F.col("idx").alias("pos"))
    return (want.join(got, ["project_id", "batch_no", "pos"], "left_anti")
            .select("project_id", F.lit(level).alias("level"), "batch_no", "pos"))


def run_batches(items: DataFrame, level: str, header: str, item_text: F.Column, fn,
                per_item_tokens: int, size: int = SUMMARY_BATCH_SIZE,
                group_col: str = "file_path", order_col: str = "ord") -> BatchRun:
    """F1 -> L15 -> N1 -> I11/I12 -> D13 for one level."""
    # numbering, prompts and summaries read the items: their texts are made once
    items = materialize(items, f"items-{level}")
    nb = number_batches(items, size, group_col, order_col).withColumn("_item", item_text)
    prompts = (nb.groupBy("project_id", "batch_no")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "_item"))).alias("_items"),
                    F.first("n_batches").alias("n_batches"), F.count(F.lit(1)).alias("n"))
               .withColumn("max_tokens", max_tokens(F.col("n"), per_item_tokens))
               .withColumn("prompt", F.concat(
                   F.lit(header.replace("{kind}", level)), F.lit("\nAnswer with one line per item, formatted as "
                                                                  "\"[number] summary\", and nothing else.\n"),
                   F.lit("Batch "), F.col("batch_no").cast("string"), F.lit("/"),
                   F.col("n_batches").cast("string"), F.lit("\n\n"),
                   F.array_join(F.transform("_items", lambda x: x["_item"]), "\n")))
               .select("project_id", "batch_no", "n", "max_tokens", "prompt"))
    responses = materialize(infer(prompts, fn, "prompt", max_tokens_col="max_tokens"), f"responses-{level}")
    parsed = parse_numbered(responses)
    errors = missing_positions(responses, parsed, level)
    bad = errors.select("project_id", "batch_no").distinct()
    good = parsed.join(bad, ["project_id", "batch_no"], "left_anti")
    summ = (nb.drop("_item").join(good.withColumnRenamed("idx", "pos").withColumnRenamed("text", "summary"),
                                  ["project_id", "batch_no", "pos"], "inner"))
    return BatchRun(summ, errors, responses)


# ------------------------------------------------------------ functions
def function_items(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions with a name and line range whose code slice is not empty,
    code truncated (G5)."""
    f = functions.where((F.coalesce(F.length("name"), F.lit(0)) > 0) & (F.col("line") > 0) & (F.col("end_line") > 0))
    arr = files.select(*FILE_KEY, "language", split_lines(F.col("content")).alias("_lines"))
    j = f.drop("language").join(arr, FILE_KEY)
    code = slice_lines(F.col("_lines"), F.col("line"), F.col("end_line"))
    return (j.withColumn("code", code).where(F.col("code").isNotNull() & (F.col("code") != ""))
            .withColumn("code", truncate_code(F.col("code"))).drop("_lines"))


def summarize_functions(files: DataFrame, functions: DataFrame, fn) -> BatchRun:
    items = function_items(files, functions)
    text = F.concat(F.lit("### "), F.col("pos").cast("string"), F.lit(". "), F.col("name"), F.lit(" ("),
                    F.col("file_path"), F.lit(")\n```"), F.col("language"), F.lit("\n"), F.col("code"),
                    F.lit("\n```\n"))
    return run_batches(items, "function", "Summarize each of the {kind}s below in one or two sentences: "
                       "what it does, what it takes and what it gives back.", text, fn, 100)


# ----------------------------------------------------------------- files
def file_context(files: DataFrame, function_summaries: DataFrame, classes: DataFrame,
                 imports: DataFrame) -> DataFrame:
    """E20 + D11: per analyzed file the function names, class names, import
    count and the context text built from the function summaries."""
    fs = (function_summaries.groupBy(*FILE_KEY)
          .agg(F.array_sort(F.collect_list(F.struct("ord", "name", "summary"))).alias("_fs")))
    cl = (classes.where(F.coalesce(F.length("name"), F.lit(0)) > 0).groupBy(*FILE_KEY)
          .agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("_cl")))
    im = imports.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("imports_count"))
    j = (files.select(*FILE_KEY, "language").join(fs, FILE_KEY, "left").join(cl, FILE_KEY, "left")
         .join(im, FILE_KEY, "left"))
    fnames = F.transform(F.coalesce("_fs", F.array()), lambda x: x["name"])
    cnames = F.transform(F.coalesce("_cl", F.array()), lambda x: x["name"])
    fctx = F.when(F.size(F.coalesce("_fs", F.array())) > 0, F.concat(
        F.lit("Functions:\n"),
        F.array_join(F.transform("_fs", lambda x: F.concat(F.lit("  - "), x["name"], F.lit(": "), x["summary"],
                                                            F.lit("\n"))), ""))).otherwise(F.lit("No functions defined.\n"))
    cctx = F.when(F.size(cnames) > 0, F.concat(F.lit("Classes: "), F.array_join(cnames, ", "), F.lit("\n"))
                  ).otherwise(F.lit(""))
    return j.select(*FILE_KEY, "language", fnames.alias("function_names"), cnames.alias("class_names"),
                    F.coalesce("imports_count", F.lit(0)).alias("imports_count"),
                    fctx.alias("function_context"), cctx.alias("class_context"))


def summarize_files(context: DataFrame, fn) -> BatchRun:
    items = context.withColumn("ord", F.lit(0))
    text = F.concat(F.lit("### "), F.col("pos").cast("string"), F.lit(". "), F.col("file_path"),
                    F.lit("\nLanguage: "), F.col("language"), F.lit("\nImports: "),
                    F.col("imports_count").cast("string"), F.lit("\n"), F.col("class_context"),
                    F.col("function_context"))
    return run_batches(items, "file", "Describe the purpose and responsibilities of each source {kind} "
                       "below in one to three sentences, from its metadata and function descriptions.",
                       text, fn, 120)


# --------------------------------------------------------------- modules
def module_context(modules: DataFrame, members: DataFrame, file_summaries: DataFrame) -> DataFrame:
    """E21 + D12: per module its file names and context text (the prompt
    input of one module); files without a summary read 'No summary
    available.'.  Membership rows come from ``project.module_files``."""
    m = modules.where(F.coalesce(F.length("name"), F.lit(0)) > 0)
    ex = members.select("project_id", "path", "file_path").join(m, ["project_id", "path"])
    fsum = file_summaries.select(*FILE_KEY, F.col("summary").alias("_s"), F.col("function_names").alias("_f"))
    ex = ex.join(fsum, FILE_KEY, "left")
    fname = P.basename(F.col("file_path"))
    line = F.concat(F.lit("  - "), fname, F.lit(": "), F.coalesce(F.col("_s"), F.lit(NO_SUMMARY)), F.lit("\n"),
                    F.when(F.col("_s").isNotNull() & (F.size(F.coalesce("_f", F.array())) > 0),
                           F.concat(F.lit("    Functions: "), F.array_join("_f", ", "), F.lit("\n")))
                    .otherwise(F.lit("")))
    g = (ex.groupBy("project_id", "pos", "name", "path", "file_count")
         .agg(F.array_sort(F.collect_list(F.struct("file_path", line.alias("l"), fname.alias("n")))).alias("_x")))
    return g.select("project_id", "pos", "name", "path", "file_count",
                    F.transform("_x", lambda x: x["n"]).alias("file_names"),
                    F.concat(F.lit("Files:\n"), F.array_join(F.transform("_x", lambda x: x["l"]), ""))
                    .alias("file_context"))


def summarize_modules(context: DataFrame, fn) -> BatchRun:
    items = context.withColumn("_grp", F.col("pos"))
    text = F.concat(F.lit("### "), F.col("pos").cast("string"), F.lit(". "), F.col("name"), F.lit(" ("),
                    F.col("path"), F.lit(")\n"), F.col("file_context"))
    return run_batches(items, "module", "Describe the role of each {kind} below in one to three sentences.",
                       text, fn, 120, group_col="_grp", order_col="pos")


# --------------------------------------------------------------- project
def project_prompts(module_summaries: DataFrame, info: DataFrame, stats: DataFrame) -> DataFrame:
    """One prompt per project from module summaries, metadata and
    graph statistics."""
    ms = (module_summaries.groupBy("project_id")
          .agg(F.array_sort(F.collect_list(F.struct(
              "pos", F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("file_count").cast("string"),
                              F.lit(" files): "), F.coalesce("summary", F.lit(NO_SUMMARY)),
                              F.lit("\n")).alias("l")))).alias("_m")))
    st = (stats.groupBy("project_id").pivot("graph", ["function_calls", "dependencies"])
          .agg(F.first(F.struct("node_count", "edge_count"))))
    j = info.join(ms, "project_id", "left").join(st, "project_id", "left")

    def cnt(g, f):
        return F.coalesce(F.col(f"{g}.{f}"), F.lit(0)).cast("string")

    prompt = F.concat(
        F.lit("From the facts below, write a three to five sentence summary of the repository, then its main "
              "technologies and its main features.\nProject: "), F.col("project_id"),
        F.lit("\nMetadata:\n- Language: "), F.col("language"), F.lit("\n- Framework: "), F.col("framework"),
        F.lit("\n- Package manager: "), F.col("package_manager"),
        F.lit("\nModules:\n"), F.array_join(F.transform(F.coalesce("_m", F.array()), lambda x: x["l"]), ""),
        F.lit("Statistics:\n- Call graph: "), cnt("function_calls", "node_count"), F.lit(" functions, "),
        cnt("function_calls", "edge_count"), F.lit(" calls\n- Dependency graph: "), cnt("dependencies", "node_count"),
        F.lit(" files, "), cnt("dependencies", "edge_count"),
        F.lit(" imports\nAnswer in exactly three lines:\nSUMMARY: <summary>\nTECHNOLOGIES: <comma-separated>\n"
              "FEATURES: <comma-separated>"))
    return j.select("project_id", prompt.alias("prompt"))


def parse_project_answer(responses: DataFrame) -> DataFrame:
    """SUMMARY / TECHNOLOGIES / FEATURES lines, the last of each kind
    wins; lists split on ',' with blanks dropped."""
    lines = F.transform(F.split(py_strip(F.col("response")), "\n"), lambda x: py_strip(x))

    def last_value(label):
        hits = F.filter(lines, lambda x: x.startswith(label))
        return F.when(F.size(hits) > 0, py_strip(F.element_at(hits, -1).substr(len(label) + 1, 1 << 30)))

    def as_list(c):
        return F.filter(F.transform(F.split(c, ","), lambda x: py_strip(x)), lambda x: x != "")

    return responses.select(
        "project_id",
        F.coalesce(last_value("SUMMARY:"), F.lit("")).alias("summary"),
        F.coalesce(as_list(last_value("TECHNOLOGIES:")), F.array().cast("array<string>")).alias("main_technologies"),
        F.coalesce(as_list(last_value("FEATURES:")), F.array().cast("array<string>")).alias("main_features"))


def summarize_projects(module_summaries: DataFrame, info: DataFrame, stats: DataFrame, fn) -> DataFrame:
    prompts = project_prompts(module_summaries, info, stats)
    responses = materialize(infer(prompts, fn, "prompt"), "responses-project")
    return parse_project_answer(responses)


@dataclass
class Understanding:
    """The summary hierarchy, one table per level, plus the batches
    whose answers were incomplete."""
    functions: DataFrame
    files: DataFrame
    modules: DataFrame
    projects: DataFrame
    errors: DataFrame


def understand(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame,
               modules: DataFrame, members: DataFrame, info: DataFrame, stats: DataFrame, fn) -> Understanding:
    """Function -> file -> module -> project summaries in one call; each
    level is stored before the next one reads it."""
    fr = summarize_functions(files, functions, fn)
    fsum = materialize(fr.summaries, "understand-functions")
    flr = summarize_files(file_context(files, fsum, classes, imports), fn)
    flsum = materialize(flr.summaries, "understand-files")
    mr = summarize_modules(module_context(modules, members, flsum), fn)
    msum = materialize(mr.summaries, "understand-modules")
    proj = summarize_projects(msum.select("project_id", "pos", "name", "file_count", "summary"), info, stats, fn)
    return Understanding(fsum, flsum, msum, proj, fr.errors.unionByName(flr.errors).unionByName(mr.errors))
