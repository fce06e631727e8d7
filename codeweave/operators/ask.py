"""Batch question answering: L1-L14, I14-I16, B10-B12.

A batch of questions (question_id, project_id, question, top_k) is
classified by column rules (or by a model through N1 + I14/I15), routed by
type, and each strategy is a join of the question rows with the persisted
corpus tables (modules, graphs, functions, files, chunk vectors) -- the
repository is never re-analysed per question.  Errors are rows (``error``
column), never exceptions, so one bad question cannot fail the batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import ARCHITECTURE_EDGE_LIMIT, QUESTION_TYPES
from ..functions.text import py_strip, slice_lines, split_lines, strip_chars
from ..sources.store import enough_partitions, materialize, spread
from .infer import infer

# Rules (standing in for a model's judgement), first match wins
FILE_RULE = r"(?U)([\w./\\-]+\.(?:py|jsx?|tsx?|java|cpp|hpp|c|h|cs))\b"
FUNCTION_RULES = [
    r"(?U)(\w+)\(\s*\)",
    r"(?U)(?i:(?:function|method)\s+)(\w*[A-Z_]\w*)",
    r"(?U)(\w+)(?i:\s+(?:function|method))\b",
    r"(?U)\b([a-z]+[A-Z]\w*|\w+_\w+)\b",
]
ARCHITECTURE_RULE = r"(?i)architecture|\bmodules\b|\bcomponents\b|dependency flow|dependencies"
OVERVIEW_RULE = r"(?i)overview|this (project|repository)|technologies|frameworks|main purpose"
NULL_TARGETS = ["null", "none", "n/a", "", "undefined"]
DEFAULT_REASONING = "Classified by question rules."


# --------------------------------------------------------------- I16
def sanitize_target(target, qtype) -> F.Column:
    """I16: strip quotes/backticks, null-like words -> NULL; FUNCTION: drop
    '()', a leading keyword, keep the last identifier; FILE: '\\' -> '/',
    drop a leading './' or '/'."""
    c = strip_chars(py_strip(target), "\"'`")
    fn = py_strip(F.regexp_replace(py_strip(F.regexp_replace(c, r"\(\s*\)$", "")),
                                   r"(?i)^(?:function|def|method|const|let|var)\s+", ""))
    idents = F.regexp_extract_all(fn, F.lit(r"[a-zA-Z_]\w*"), 0)
    fn = F.when(F.size(idents) > 0, F.element_at(idents, -1)).otherwise(fn)
    fl = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^\.?/", "")
    out = F.when(qtype == "FUNCTION", fn).when(qtype == "FILE", fl).otherwise(c)
    return F.when(target.isNull() | F.lower(c).isin(*NULL_TARGETS), F.lit(None)).otherwise(F.nullif(out, F.lit("")))


# ---------------------------------------------------------------- L1
def classify_rules(questions: DataFrame) -> DataFrame:
    """L1: question_type, target_name, reasoning, error for every question."""
    q = py_strip(F.col("question"))
    file_t = F.regexp_extract(q, FILE_RULE, 1)
    fn_hits = [F.regexp_extract(q, r, 1) for r in FUNCTION_RULES]
    fn_t = F.coalesce(*[F.nullif(h, F.lit("")) for h in fn_hits])
    qtype = (F.when(q == "", F.lit(None))
             .when(file_t != "", F.lit("FILE"))
             .when(fn_t.isNotNull(), F.lit("FUNCTION"))
             .when(q.rlike(ARCHITECTURE_RULE), F.lit("ARCHITECTURE"))
             .when(q.rlike(OVERVIEW_RULE), F.lit("PROJECT_OVERVIEW"))
             .otherwise(F.lit("SEMANTIC_SEARCH")))
    raw_target = F.when(qtype == "FILE", file_t).when(qtype == "FUNCTION", fn_t)
    return (questions.withColumn("question_type", qtype)
            .withColumn("target_name", sanitize_target(raw_target, F.col("question_type")))
            .withColumn("reasoning", F.when(F.col("question_type").isNotNull(), F.lit(DEFAULT_REASONING)))
            .withColumn("error", F.when(F.col("question_type").isNull(), F.lit("Question must not be empty."))))


# ------------------------------------------------------------ I14, I15
def extract_json_object(text) -> F.Column:
    """JSON object from model text: fences removed, whole text parsed,
    else the first '{' .. last '}' span; NULL when neither parses."""
    schema = "struct<question_type:string,target_name:string,reasoning:string>"
    t = py_strip(text)
    t = F.when(t.startswith("```"), py_strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""),
                                                              r"\s*```$", ""))).otherwise(t)
    whole = F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, schema))
    span = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    part = F.when(F.get_json_object(span, "$").isNotNull(), F.from_json(span, schema))
    return F.coalesce(whole, part)


def classify_with_model(questions: DataFrame, fn, prompt_builder) -> DataFrame:
    """L1 through a model: prompt -> N1 -> I14 -> I15 validation (type
    upper-cased and checked against the five types; errors as rows)."""
    q = questions.withColumn("_prompt", prompt_builder(F.col("question")))
    r = infer(q.where(py_strip(F.col("question")) != ""), fn, "_prompt", "_answer")
    obj = extract_json_object(F.col("_answer"))
    t = F.upper(py_strip(obj["question_type"]))
    r = (r.withColumn("_obj", obj)
         .withColumn("question_type", F.when(t.isin(*QUESTION_TYPES), t))
         .withColumn("target_name", sanitize_target(F.col("_obj.target_name"), F.col("question_type")))
         .withColumn("reasoning", F.coalesce(F.col("_obj.reasoning"), F.lit(DEFAULT_REASONING)))
         .withColumn("error", F.when(F.col("_obj").isNull(), F.lit("Model answer holds no JSON object."))
                     .when(F.col("question_type").isNull(), F.concat(F.lit("Unknown question type: "),
                                                                      F.coalesce(t, F.lit(""))))))
    blank = (questions.where(py_strip(F.col("question")) == "")
             .withColumn("question_type", F.lit(None).cast("string"))
             .withColumn("target_name", F.lit(None).cast("string"))
             .withColumn("reasoning", F.lit(None).cast("string"))
             .withColumn("error", F.lit("Question must not be empty.")))
    cols = questions.columns + ["question_type", "target_name", "reasoning", "error"]
    return r.select(*cols).unionByName(blank.select(*cols))


# ---------------------------------------------------------- retrieval
@dataclass
class AskTables:
    """Persisted corpus tables the strategies read."""
    files: DataFrame           # analyzed files (project_id, file_path, rel_path, language, content)
    functions: DataFrame
    classes: DataFrame
    imports: DataFrame
    modules: DataFrame         # (project_id, pos, name, path, files, file_count)
    project_info: DataFrame
    totals: DataFrame          # E12
    dep_edges: DataFrame       # with (file_path, ord) order columns
    call_edges: DataFrame
    search_hits: DataFrame | None = None   # K7 results per question (question_id, rank, ...)


def context_key() -> F.Column:
    """What a question's context depends on: its type and project, the target, or
    (semantic search) the question itself; null without a type."""
    kind, target = F.col("question_type"), F.coalesce("target_name", F.lit("\0"))
    return (F.when(kind.isin("PROJECT_OVERVIEW", "ARCHITECTURE"), F.concat_ws("|", kind, "project_id"))
            .when(kind.isin("FUNCTION", "FILE"), F.concat_ws("|", kind, "project_id", target))
            .when(kind == "SEMANTIC_SEARCH", F.concat_ws("|", kind, F.col("question_id").cast("string"))))


def asked_contexts(classified: DataFrame) -> DataFrame:
    """One row per context key: (context_key, project_id, question_type, target_name)."""
    return (classified.withColumn("context_key", context_key()).where("context_key IS NOT NULL")
            .groupBy("context_key").agg(*(F.min(x).alias(x) for x in ("project_id", "question_type", "target_name"))))


def _keyed_hits(t: AskTables) -> DataFrame:
    return t.search_hits.withColumn("context_key", F.concat_ws("|", F.lit("SEMANTIC_SEARCH"), F.col("question_id").cast("string")))


def function_matches(classified: DataFrame, t: AskTables, with_code: bool = True, by: str = "question_id") -> DataFrame:
    """B10 + L5: every function whose lower(name) equals lower(strip(target)).
    Only the matched files are read for the code slices, which are cut once per function
    and meet the questions last: no exchange holds a row per question and match."""
    q = (classified.where(F.col("question_type") == "FUNCTION")
         .select(by, "project_id", F.lower(py_strip(F.col("target_name"))).alias("_key")))
    f = t.functions.select("project_id", F.lower("name").alias("_key"), "file_path", "ord", "name", "language",
                           "line", "end_line", "parameters")
    f = f.join(q.select("project_id", "_key").distinct(), ["project_id", "_key"], "left_semi")
    paths = t.files.select("project_id", "file_path", "rel_path")
    if not with_code:
        return q.join(f.join(paths, ["project_id", "file_path"]), ["project_id", "_key"]).select(
            by, "project_id", "file_path", "ord", "name", "language", "line", "end_line",
            "parameters", "rel_path")
    hit = f.select("project_id", "file_path").distinct()
    lines = (t.files.join(hit, ["project_id", "file_path"], "left_semi")
             .select("project_id", "file_path", "rel_path", split_lines(F.col("content")).alias("_lines")))
    cut = f.join(lines, ["project_id", "file_path"]).withColumn(
        "code", slice_lines(F.col("_lines"), F.col("line"), F.col("end_line"))).drop("_lines")
    return q.join(cut, ["project_id", "_key"]).select(
        by, "project_id", "file_path", "ord", "name", "language", "line", "end_line", "parameters", "rel_path", "code")


def file_match(classified: DataFrame, t: AskTables, by: str = "question_id") -> DataFrame:
    """B11 + L6: the FIRST analyzed file (in order) whose relative path equals
    the target or whose base name equals the target's base name.  Two
    equi-joins (never an OR join condition) folded with min_by."""
    q = (classified.where(F.col("question_type") == "FILE")
         .select(by, "project_id",
                 F.lower(py_strip(F.regexp_replace(F.col("target_name"), r"\\", "/"))).alias("_full"))
         .withColumn("_base", P.basename(F.col("_full"))))
    fl = t.files.select("project_id", "file_path", "rel_path",
                        F.lower("rel_path").alias("_full"), F.lower(P.basename(F.col("rel_path"))).alias("_base"))
    by_full = q.join(fl.drop("_base"), ["project_id", "_full"]).select(by, "file_path", "rel_path")
    by_base = q.join(fl.drop("_full"), ["project_id", "_base"]).select(by, "file_path", "rel_path")
    both = by_full.unionByName(by_base)
    return (both.groupBy(by)
            .agg(F.min_by(F.struct("file_path", "rel_path"), "file_path").alias("m"))
            .select(by, "m.file_path", "m.rel_path"))


def file_listing(match: DataFrame, t: AskTables, classified: DataFrame, by: str = "question_id") -> DataFrame:
    """Functions, classes, imports and code of each matched file."""
    fq = match.join(classified.select(by, "project_id"), by)
    hit = fq.select("project_id", "file_path").distinct()

    def names(df, col, alias):
        return (df.join(hit, ["project_id", "file_path"], "left_semi").groupBy("project_id", "file_path")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", col))), lambda x: x[col]).alias(alias)))
    files = t.files.join(hit, ["project_id", "file_path"], "left_semi")
    out = (fq.join(files.select("project_id", "file_path", "language", "content"), ["project_id", "file_path"])
           .join(names(t.functions, "name", "functions"), ["project_id", "file_path"], "left")
           .join(names(t.classes, "name", "classes"), ["project_id", "file_path"], "left")
           .join(names(t.imports, "module", "imports"), ["project_id", "file_path"], "left"))
    empty = F.array().cast("array<string>")
    return out.select(by, "project_id", "file_path", "rel_path", "language",
                      F.coalesce("functions", empty).alias("functions"),
                      F.coalesce("classes", empty).alias("classes"),
                      F.coalesce("imports", empty).alias("imports"),
                      F.col("content").alias("code"))


def key_dependencies(t: AskTables, projects: DataFrame | None = None) -> DataFrame:
    """The first 15 dependency edges of each project, in order."""
    w = Window.partitionBy("project_id").orderBy("file_path", "ord")
    e = t.dep_edges if projects is None else t.dep_edges.join(projects, "project_id", "left_semi")
    return (e.withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= ARCHITECTURE_EDGE_LIMIT))


def module_lists(t: AskTables, projects: DataFrame | None = None) -> DataFrame:
    m = t.modules if projects is None else t.modules.join(projects, "project_id", "left_semi")
    return (m.groupBy("project_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "name", "path", "file_count"))).alias("modules")))


def context_table(classified: DataFrame, t: AskTables) -> DataFrame:
    """(context_key, strategy, found, context), each text once, however many
    questions ask for it."""
    return reduce(DataFrame.unionByName, [*shared_context_tables(classified, t).values(), semantic_contexts(classified, t)])


def shared_context_tables(classified: DataFrame, t: AskTables) -> dict[str, DataFrame]:
    """The contexts by strategy, except those of semantic search."""
    by = "context_key"
    c = asked_contexts(classified)
    asked = c.select("project_id").distinct()
    mods = module_lists(t, asked)
    mod_text = F.array_join(F.transform(F.coalesce("modules", F.array()), lambda m: F.concat(
        F.lit("- "), m["name"], F.lit(" ("), m["path"], F.lit(", "), m["file_count"].cast("string"),
        F.lit(" files)"))), "\n")

    # L3 overview
    ov = (c.where(F.col("question_type") == "PROJECT_OVERVIEW")
          .join(t.project_info.select("project_id", "language", "framework", "package_manager"), "project_id", "left")
          .join(t.totals.select("project_id", "total_source_files"), "project_id", "left")
          .join(mods, "project_id", "left"))
    ov = ov.select(by, F.lit("project_overview").alias("strategy"), F.lit(True).alias("found"),
                   F.concat_ws("\n", F.lit("Project overview"),
                               F.concat(F.lit("Language: "), F.coalesce("language", F.lit("Unknown"))),
                               F.concat(F.lit("Framework: "), F.coalesce("framework", F.lit("Unknown"))),
                               F.concat(F.lit("Package manager: "), F.coalesce("package_manager", F.lit("Unknown"))),
                               F.concat(F.lit("Source files: "), F.coalesce("total_source_files", F.lit(0)).cast("string")),
                               F.lit("Modules:"), mod_text).alias("context"))

    # L4 architecture
    kd = key_dependencies(t, asked)
    kd_list = (kd.groupBy("project_id")
               .agg(F.array_sort(F.collect_list(F.struct("rn", "source", "target"))).alias("kd")))
    n_dep = (t.dep_edges.join(asked, "project_id", "left_semi")
             .groupBy("project_id").agg(F.count(F.lit(1)).alias("total_dependencies")))
    n_call = (t.call_edges.join(asked, "project_id", "left_semi")
              .groupBy("project_id").agg(F.count(F.lit(1)).alias("total_function_calls")))
    ar = (c.where(F.col("question_type") == "ARCHITECTURE").join(mods, "project_id", "left")
          .join(kd_list, "project_id", "left").join(n_dep, "project_id", "left").join(n_call, "project_id", "left"))
    kd_text = F.array_join(F.transform(F.coalesce("kd", F.array()), lambda e: F.concat(
        F.lit("- "), e["source"], F.lit(" -> "), e["target"])), "\n")
    ar = ar.select(by, F.lit("architecture").alias("strategy"), F.lit(True).alias("found"),
                   F.concat_ws("\n", F.lit("Architecture"), F.lit("Modules:"), mod_text,
                               F.concat(F.lit("Import relationships: "),
                                        F.coalesce("total_dependencies", F.lit(0)).cast("string")),
                               F.concat(F.lit("Function calls: "),
                                        F.coalesce("total_function_calls", F.lit(0)).cast("string")),
                               F.lit("Key dependencies:"), kd_text).alias("context"))

    # L5 function
    fm = function_matches(c, t, by=by)
    fm_agg = (fm.groupBy(by)
              .agg(F.array_sort(F.collect_list(F.struct("file_path", "ord", "name", "rel_path", "language", "line",
                                                        "end_line", "parameters", "code"))).alias("fns")))
    fq = c.where(F.col("question_type") == "FUNCTION").join(fm_agg, by, "left")
    fn_text = F.array_join(F.transform(F.coalesce("fns", F.array()), lambda f: F.concat(
        F.lit("Function "), f["name"], F.lit(" in "), f["rel_path"], F.lit(" (lines "), f["line"].cast("string"),
        F.lit("-"), f["end_line"].cast("string"), F.lit(", "), f["language"], F.lit(")\nParameters: "),
        F.array_join(f["parameters"], ", "), F.lit("\n"), F.coalesce(f["code"], F.lit("")))), "\n\n")
    fq = fq.select(by, F.lit("function").alias("strategy"),
                   (F.size(F.coalesce("fns", F.array())) > 0).alias("found"),
                   F.when(F.col("target_name").isNull(), F.lit(None))
                   .otherwise(F.concat(F.lit("Target function: "), F.col("target_name"), F.lit("\nMatches: "),
                                       F.size(F.coalesce("fns", F.array())).cast("string"), F.lit("\n\n"), fn_text))
                   .alias("context"))

    # L6 file
    fmatch = file_match(c, t, by)
    fl = file_listing(fmatch, t, c, by)
    flq = c.where(F.col("question_type") == "FILE").join(fl.drop("project_id"), by, "left")
    flq = flq.select(by, F.lit("file").alias("strategy"), F.col("rel_path").isNotNull().alias("found"),
                     F.when(F.col("rel_path").isNotNull(), F.concat_ws(
                         "\n", F.concat(F.lit("File: "), F.col("rel_path")),
                         F.concat(F.lit("Language: "), F.col("language")),
                         F.concat(F.lit("Functions: "), F.array_join("functions", ", ")),
                         F.concat(F.lit("Classes: "), F.array_join("classes", ", ")),
                         F.concat(F.lit("Imports: "), F.array_join("imports", ", ")),
                         F.concat(F.lit("\n"), F.col("code")))).alias("context"))

    return {"overview": ov, "architecture": ar, "function": fq, "file": flq}


def semantic_contexts(classified: DataFrame, t: AskTables) -> DataFrame:
    """The contexts of semantic search, one per question id."""
    by = "context_key"
    sq = asked_contexts(classified.where(F.col("question_type") == "SEMANTIC_SEARCH"))
    if t.search_hits is not None:
        hits = (_keyed_hits(t).groupBy(by)
                .agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "file_path", "name", "chunk_type",
                                                          "code", "score"))).alias("hits")))
        sq = sq.join(hits, by, "left")
    else:
        sq = sq.withColumn("hits", F.lit(None).cast(
            "array<struct<rank:int,chunk_id:string,file_path:string,name:string,chunk_type:string,code:string,score:double>>"))
    n = F.size(F.coalesce("hits", F.array()))
    hit_text = F.array_join(F.transform(F.coalesce("hits", F.array()), lambda h: F.concat(
        F.lit("Chunk "), h["rank"].cast("string"), F.lit("/"), n.cast("string"), F.lit(": "), h["name"],
        F.lit(" ("), h["chunk_type"], F.lit(", "), h["file_path"], F.lit(", score "),
        F.format_string("%.4f", h["score"]),
        F.lit(")\n"), h["code"])), "\n\n")
    return sq.select(by, F.lit("semantic_search").alias("strategy"), (n > 0).alias("found"),
                     F.concat(F.lit("Search results: "), n.cast("string"), F.lit("\n\n"), hit_text).alias("context"))


#: questions that read one copy of a context text, and bytes of texts that a task hands on
COPY_QUESTIONS, TASK_CONTEXTS = 256, 128 << 20


def _copies(q: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``q`` and ``contexts`` with ``copy``: a text that many questions ask for is copied, a copy
    per ``COPY_QUESTIONS``, and the partitions of both sides follow the text that leaves them (AQE
    sees narrow questions and few texts, and would put those of many contexts into one task)."""
    asked = materialize(q.groupBy("context_key").agg(F.count(F.lit(1)).alias("_asked")), "asked")
    size = contexts.select("context_key", F.octet_length("context").alias("_size")).join(asked, "context_key")
    n = enough_partitions(q.sparkSession, size.agg(F.sum(F.col("_size") * F.col("_asked"))).first()[0], TASK_CONTEXTS)
    many = materialize(asked.where(F.col("_asked") > COPY_QUESTIONS).select(
        "context_key", F.ceil(F.col("_asked") / COPY_QUESTIONS).cast("int").alias("_n")), "asked-often")
    copies = F.coalesce("_n", F.lit(1))
    q = q.join(many, "context_key", "left").withColumn("copy", F.pmod(F.xxhash64("question_id"), copies).cast("int"))
    contexts = contexts.join(many, "context_key", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return tuple(x.drop("_n").repartition(n, "context_key", "copy") for x in (q, contexts))


def retrieve(classified: DataFrame, t: AskTables, contexts: DataFrame | None = None, shared: bool = False) -> DataFrame:
    """One row per question with strategy, found flag and the text of its
    context.  Texts are made once per key (``contexts``, or ``context_table`` of the
    questions) and meet the questions here, by key; a question is a narrow row until then.
    ``shared``: the contexts are stored and may each be asked for by many questions."""
    contexts = context_table(classified, t) if contexts is None else contexts
    q = classified.select("question_id", "project_id", "question", "question_type", "target_name", "error").withColumn(
        "context_key", context_key())
    if shared:
        q, contexts = _copies(q, contexts)
        out = q.join(contexts, ["context_key", "copy"], "left")
    else:
        out = spread(q).join(contexts, "context_key", "left")
    typed = F.col("question_type").isNotNull()
    return out.select("question_id", "project_id", "question", "question_type", "target_name", "error",
                      F.when(typed, F.col("strategy")).otherwise("none").alias("strategy"),
                      F.when(typed, F.col("found")).otherwise(False).alias("found"), "context")


# ------------------------------------------------------------- L11
def insufficiency(ctx: DataFrame) -> DataFrame:
    """Error > not found > no chunks -> insufficient with a message."""
    msg = (F.when(F.col("error").isNotNull(), F.concat(F.lit("This cannot be answered: "), F.col("error")))
           .when((F.col("question_type") == "FUNCTION") & F.col("target_name").isNull(),
                 F.lit("This cannot be answered: no function name was given."))
           .when((F.col("question_type") == "FILE") & F.col("target_name").isNull(),
                 F.lit("This cannot be answered: no file was given."))
           .when((F.col("question_type") == "FUNCTION") & ~F.col("found"),
                 F.concat(F.lit("Not enough is indexed to answer: function '"), F.col("target_name"),
                          F.lit("' was not found.")))
           .when((F.col("question_type") == "FILE") & ~F.col("found"),
                 F.concat(F.lit("Not enough is indexed to answer: file '"), F.col("target_name"),
                          F.lit("' was not found.")))
           .when((F.col("question_type") == "SEMANTIC_SEARCH") & ~F.col("found"),
                 F.lit("Not enough is indexed to answer: no matching code was found.")))
    return ctx.withColumn("insufficient", msg.isNotNull()).withColumn("message", msg)


# ------------------------------------------------------------- L12
def source_table(classified: DataFrame, t: AskTables) -> DataFrame:
    """Citations per context key (context_key, pos, file_path, name, chunk_type,
    line, end_line), each list once."""
    by = "context_key"
    ok = asked_contexts(classified.where(F.col("error").isNull()))
    fn = (function_matches(ok, t, with_code=False, by=by)
          .select(by, F.struct("file_path", "ord").alias("_o"), F.col("rel_path").alias("file_path"),
                  "name", F.lit("function").alias("chunk_type"), "line", "end_line"))
    fl = file_match(ok, t, by).select(by, F.struct("file_path", F.lit(0).alias("ord")).alias("_o"),
                                  F.col("rel_path").alias("file_path"), P.basename(F.col("rel_path")).alias("name"),
                                  F.lit("file").alias("chunk_type"), F.lit(1).alias("line"),
                                  F.lit(None).cast("int").alias("end_line"))
    parts = [fn, fl]
    if t.search_hits is not None:
        sem = (ok.where(F.col("question_type") == "SEMANTIC_SEARCH").select(by)
               .join(_keyed_hits(t), by)
               .select(by, F.struct(F.lit("").alias("file_path"), F.col("rank").alias("ord")).alias("_o"),
                       "file_path", "name", "chunk_type", "line", "end_line"))
        parts.append(sem)
    # H2: distinct endpoints of the key dependencies, first appearance order
    arch_projects = ok.where(F.col("question_type") == "ARCHITECTURE").select("project_id").distinct()
    kd = key_dependencies(t, arch_projects)
    ends = kd.select("project_id", F.posexplode(F.array(F.struct("rn", F.lit(0).alias("side"), F.col("source").alias("p")),
                                                        F.struct("rn", F.lit(1).alias("side"), F.col("target").alias("p"))))
                     .alias("_i", "e"))
    ends = (ends.groupBy("project_id", F.col("e.p").alias("p"))
            .agg(F.min(F.struct("e.rn", "e.side")).alias("first")))
    arch = (ok.where(F.col("question_type") == "ARCHITECTURE").select(by, "project_id")
            .join(ends, "project_id")
            .select(by, F.struct(F.lit("").alias("file_path"),
                                            (F.col("first.rn") * 2 + F.col("first.side")).alias("ord")).alias("_o"),
                    F.col("p").alias("file_path"), P.basename(F.col("p")).alias("name"),
                    F.lit("file").alias("chunk_type"), F.lit(None).cast("int").alias("line"),
                    F.lit(None).cast("int").alias("end_line")))
    ov = (ok.where(F.col("question_type") == "PROJECT_OVERVIEW").select(by, "project_id")
          .join(t.modules, "project_id")
          .select(by, F.struct(F.lit("").alias("file_path"), F.col("pos").alias("ord")).alias("_o"),
                  F.col("path").alias("file_path"), "name", F.lit("module").alias("chunk_type"),
                  F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line")))
    parts += [arch, ov]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    w = Window.partitionBy(by).orderBy("_o")
    return allp.withColumn("pos", F.row_number().over(w)).drop("_o")


def answer_sources(classified: DataFrame, t: AskTables, sources: DataFrame | None = None) -> DataFrame:
    """Citations per question (question_id, pos, file_path, name,
    chunk_type, line, end_line), from those of its context key."""
    sources = source_table(classified, t) if sources is None else sources
    q = classified.where(F.col("error").isNull()).select("question_id", context_key().alias("context_key"))
    return q.join(sources, "context_key").drop("context_key")


# ------------------------------------------------------------ L13, L14
# Per-type answer instructions
TYPE_INSTRUCTIONS = {
    "FUNCTION": "Explain what the function does, its parameters and its result, citing its file and lines.",
    "FILE": "Explain the purpose of the file and its main functions, classes and imports.",
    "ARCHITECTURE": "Explain how the modules fit together and how dependencies flow between them.",
    "PROJECT_OVERVIEW": "Explain what the project does, its technologies and its main modules.",
    "SEMANTIC_SEARCH": "Answer from the retrieved code chunks, citing the chunks you use.",
}


def answer_prompt() -> F.Column:
    """Instructions, per-type instruction, context and question."""
    m = F.create_map(*[x for kv in TYPE_INSTRUCTIONS.items() for x in map(F.lit, kv)])
    return F.concat(
        F.lit("Answer the question about the repository using only the context below. If the context is not "
              "enough, say so.\nInstruction: "),
        F.coalesce(F.element_at(m, F.col("question_type")), F.element_at(m, F.lit("SEMANTIC_SEARCH"))),
        F.lit("\n\nContext:\n"), F.coalesce(F.col("context"), F.lit("")),
        F.lit("\n\nQuestion: "), py_strip(F.col("question")))


def answer(ctx: DataFrame, fn) -> DataFrame:
    """Insufficient questions get their message and no model call; the
    rest go through the model (filtered BEFORE mapInPandas); an empty model
    answer is an error row."""
    chk = insufficiency(ctx)
    short = chk.where(F.col("insufficient")).select(
        "question_id", F.col("message").alias("answer"), F.lit(True).alias("insufficient"),
        F.lit(None).cast("string").alias("error"))
    todo = (chk.where(~F.col("insufficient"))
            .select("question_id", answer_prompt().alias("prompt")))
    # the narrow rows of ``ctx`` are dealt over the tasks; prompts stay where they are made
    got = infer(todo, fn, "prompt", "raw", deal=False)
    got = got.select("question_id", py_strip(F.col("raw")).alias("answer"), F.lit(False).alias("insufficient"),
                     F.when(py_strip(F.coalesce(F.col("raw"), F.lit(""))) == "",
                            F.lit("The model returned an empty answer.")).alias("error"))
    return short.unionByName(got)


def answer_records(ctx: DataFrame, answers: DataFrame, sources: DataFrame, provider: str | None = None,
                   model: str | None = None) -> DataFrame:
    """L14 in full: one row per question with its type, strategy, answer, the
    ordered sources (empty list where there are none), provider and model.  ``sources``
    are those of questions (L12) or, with a ``context_key``, of contexts: then a list is made
    once and meets the questions by its key."""
    by = "context_key" if "context_key" in sources.columns else "question_id"

    def lists(rows, key, name):
        return rows.groupBy(key).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "file_path", "name", "chunk_type", "line", "end_line"))),
            lambda x: x.dropFields("pos")).alias(name))
    none = F.array().cast("array<struct<file_path:string,name:string,chunk_type:string,line:int,end_line:int>>")
    ctx = ctx.withColumn("context_key", context_key())
    out = ctx.select("question_id", "question", "question_type", "strategy", "context_key").join(answers, "question_id")
    listed = F.col("sources")
    if by == "context_key":
        # an id of several questions has the citations of all of them
        many = ctx.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        each = ctx.where(F.col("error").isNull()).select("question_id", by).join(many, "question_id", "left_semi").join(sources, by)
        out = out.join(many.join(lists(each, "question_id", "_all"), "question_id", "left"), "question_id", "left")
        listed = F.when(F.col("_n").isNotNull(), F.col("_all")).otherwise(listed)
    return (out.join(lists(sources, by, "sources"), by, "left").withColumn("sources", listed).drop("context_key", "_n", "_all")
            .withColumn("sources", F.when(F.col("insufficient"), none).otherwise(F.coalesce("sources", none)))
            .withColumn("provider", F.lit(provider)).withColumn("model", F.lit(model)))
