"""Entity extraction C1-C7.

Python files are read by lines: definitions begin a logical line, a block ends
before the first later logical line of the same or a lower indentation
(:func:`lines.next_close`).  Files of brace languages are read by their brackets
(:mod:`brackets`).  Both give entities that reach from one place of the file to
another, ``line * 2**32 + column``; callers, class members and order are decided on
these places (:func:`lines.innermost_enclosing`), lines are derived from them.  No
tree is built and nothing leaves the JVM; the known differences to a full grammar
are listed in the README.

All tables carry (project_id, file_path) and stay partitioned by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexer import LITERAL, split_arguments
from ..functions.text import py_strip, split_lines, strip_chars
from ..sources.store import enough_partitions, materialize_all
from .brackets import LINE, bracket_entities, lines_read, named_entities, source_modules
from .lines import FILE_KEY, file_lines, innermost_enclosing, line_features, next_close, partition_files

_FUNCTION = r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("
_CLASS = r"^\s*class\s+([A-Za-z_]\w*)"
# call sites: a dotted name, then '('
CALL_PATTERN = r"(?<![\w$])((?:\.\s*)?[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\("
# words that are never callees unless something is called on (x.catch())
NOT_CALLEES = [
    "if", "elif", "for", "while", "switch", "catch", "return", "function", "with", "not", "and",
    "or", "in", "is", "assert", "yield", "await", "lambda", "del", "except", "typeof", "sizeof",
    "synchronized", "throw", "case", "else", "do", "try", "class", "def",
    "import", "from", "async", "delete", "void", "instanceof",
]
# Java constructor invocations are not method calls
NOT_CALLEES_JAVA = ["super", "this"]
# an import statement, alone, behind a semicolon or in a block of one line
_IMPORT = r"^\s*(?:(?:if|elif|else|try|except|finally|with|for|while|class|def|async)\b.*?:)?\s*((?:from\s+\S+\s+import\b|import\s).*)$"


#: bytes of source text whose lines, marks and windows one task sorts
TASK_TEXT = 16 << 20


@dataclass
class Entities:
    """The four entity relations plus the per-file line table they came from."""
    functions: DataFrame
    classes: DataFrame
    imports: DataFrame
    calls: DataFrame
    lines: DataFrame


# the parameter list up to its end if that is on the line (six levels deep; else the signature is read whole)
_NEST = r"[^()]*+"
for _ in range(6):
    _NEST = r"(?:[^()]++|\(" + _NEST + r"\))*+"
_ARGS = r"(" + _NEST + r")(\)?)"


def python_lines(files: DataFrame) -> DataFrame:
    """Line features of Python files, with the ranks of indentation."""
    lf = line_features(file_lines(files))
    w_file = Window.partitionBy(*FILE_KEY)
    w_prev = Window.partitionBy(*FILE_KEY).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    w_next = Window.partitionBy(*FILE_KEY).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    # logical lines: content, not a bracket continuation, not in a string
    lf = lf.withColumn("logical", F.col("is_content") & (F.col("paren_before") == 0) & ~F.col("in_string"))
    lf = lf.withColumn("prev_content", F.last(F.when(F.col("is_content"), F.col("line")), True).over(w_prev))
    lf = lf.withColumn("last_content", F.max(F.when(F.col("is_content"), F.col("line"))).over(w_file))
    lf = lf.withColumn("rank", F.when(F.col("logical"), F.dense_rank().over(
        Window.partitionBy(*FILE_KEY).orderBy(F.when(F.col("logical"), F.col("indent"))))))
    lf = lf.withColumn("prev_rank", F.last("rank", True).over(w_prev))
    lf = lf.withColumn("next_logical", F.last(F.when(F.col("logical"), F.struct(
        F.col("rank").alias("rank"), F.col("prev_content").alias("prev_content"))), True).over(w_next))
    # signatures are read from lines with brackets; no other text is asked for again
    bracketed = (F.col("paren_before") > 0) | F.col("code").rlike(r"[()\[\]{}]")
    return lf.select(*FILE_KEY, "language", "line", F.when(bracketed, F.col("text")).alias("text"), "code", "logical", "rank", "prev_rank", "prev_content",
                     "last_content", "next_logical", "paren_before", "paren_after")


def python_entities(lf: DataFrame) -> DataFrame:
    """Functions and classes of Python files, as ``brackets.named_entities``."""
    code = F.col("code")
    fname, cname = F.regexp_extract(code, _FUNCTION, 1), F.regexp_extract(code, _CLASS, 1)
    args, closed = (F.regexp_extract(code, _FUNCTION + _ARGS, g) for g in (2, 3))
    defs = (lf.where(code.rlike(r"^\s*(?:async\s+)?(?:def|class)\s") & F.col("logical"))
            .withColumn("kind", F.when(fname != "", F.lit("function")).when(cname != "", F.lit("class")))
            .where(F.col("kind").isNotNull()).withColumn("name", F.when(fname != "", fname).otherwise(cname))
            .withColumn("args", F.when((closed != "") & ~args.contains(LITERAL), F.concat(args, F.lit(")"))))
            .withColumn("open_id", F.col("line").cast("long")))
    # signatures that go on over lines, by their brackets
    s_opens = defs.where(F.col("paren_after") > F.col("paren_before")).select(
        *FILE_KEY, "line", "open_id", F.col("paren_before").alias("level"))
    pmin = F.least(F.col("paren_after"), F.col("paren_before"))
    s_closes = (lf.where(F.col("paren_after") < F.col("paren_before"))
                .select(*FILE_KEY, "line", F.explode(F.sequence(pmin, F.col("paren_before") - 1)).alias("level"),
                        F.col("line").cast("int").alias("close_at")))
    sig_end = next_close(s_opens, s_closes).withColumnRenamed("close_at", "sig_close")
    # a block ends before the first later logical line at the same or a lower indentation rank
    p_opens = defs.select(*FILE_KEY, "line", "open_id", F.col("rank").alias("level"))
    p_closes = (lf.where(F.col("logical") & (F.col("prev_rank") > F.col("rank")))
                .select(*FILE_KEY, "line", F.explode(F.sequence(F.col("rank"), F.col("prev_rank") - 1))
                        .alias("level"), F.col("prev_content").cast("int").alias("close_at")))
    ent = (defs.join(sig_end, FILE_KEY + ["open_id"], "left")
           .join(next_close(p_opens, p_closes), FILE_KEY + ["open_id"], "left"))
    one_line = F.col("next_logical").isNotNull() & (F.col("next_logical.rank") <= F.col("rank"))
    ent = ent.withColumn("end_line", F.when(one_line, F.col("next_logical.prev_content")).otherwise(
        F.coalesce(F.col("close_at"), F.col("last_content"))).cast("int"))
    # signatures that are read whole: their lines, joined
    wanted = ent.where((F.col("kind") == "function") & F.col("args").isNull())
    spans = wanted.select(*FILE_KEY, F.col("line").alias("def_line"),
                          F.explode(F.sequence(F.col("line"), F.coalesce("sig_close", "line").cast("int"))).alias("line"))
    sig = (lf.select(*FILE_KEY, "line", "text").join(spans, FILE_KEY + ["line"])
           .groupBy(*FILE_KEY, F.col("def_line").alias("line"))
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))),
                                         lambda x: x["text"]), "\n").alias("sig")))
    ent = ent.join(sig, FILE_KEY + ["line"], "left")
    head = r"(?s)^\s*(?:async\s+)?def\s+\w+\s*\("
    text = F.coalesce("args", F.regexp_replace("sig", head, ""))
    return ent.select(
        *FILE_KEY, "language", "kind", "name",
        F.when(F.col("kind") == "function", F.coalesce(split_arguments(text, F.lit(False)),
                                                       F.array().cast("array<string>"))).alias("parameters"),
        (F.col("line").cast("long") * LINE).alias("pos"), ((F.col("end_line").cast("long") + 1) * LINE).alias("end_pos"),
        F.col("line").cast("int").alias("line"), "end_line")


def python_calls(lf: DataFrame) -> DataFrame:
    """C5 of Python files: ``FILE_KEY, language, callee, pos`` (heads of definitions are masked)."""
    code = F.regexp_replace(F.regexp_replace("code", _FUNCTION, " ("), _CLASS, " ")
    c = lf.where(F.col("code").contains("(")).select(
        *FILE_KEY, "language", "line", F.posexplode(F.regexp_extract_all(code, F.lit(CALL_PATTERN), F.lit(1))).alias("k", "name"))
    callee = F.element_at(F.split(F.regexp_replace("name", r"\s+", ""), r"\."), -1)
    return (c.withColumn("callee", callee)
            .where(~F.col("callee").isin("", "import") & (F.col("name").contains(".") | ~F.col("callee").isin(*NOT_CALLEES)))
            .select(*FILE_KEY, "language", "callee", (F.col("line").cast("long") * LINE + F.col("k")).alias("pos")))


def python_imports(lf: DataFrame) -> DataFrame:
    """C4 of Python files: every import statement, module by rule, else its text."""
    parts = lf.where(F.col("logical") & F.col("code").rlike(r"\bimport\b")).select(
        *FILE_KEY, "language", "line", F.posexplode(F.split("code", ";")).alias("k", "part"))
    statement = py_strip(F.regexp_extract("part", _IMPORT, 1))
    origin = F.regexp_extract(statement, r"^from\s+(\.*[\w.]*)\s+import\b", 1)
    names = F.split(F.regexp_extract(statement, r"^import\s+(.*)$", 1), ",")
    plain = F.filter(F.transform(names, lambda x: py_strip(x)), lambda x: x.rlike(r"^[A-Za-z_][\w.]*$"))
    module = F.when(origin != "", origin).otherwise(F.coalesce(F.try_element_at(plain, F.lit(1)), statement))
    return parts.where(statement != "").select(
        *FILE_KEY, "language", module.alias("module"), (F.col("line").cast("long") * LINE + F.col("k")).alias("pos"))


def cpp_includes(files: DataFrame) -> DataFrame:
    """C4 of C++ files: their include lines."""
    rule = r"^\s*#\s*include\b"
    lines = file_lines(files).where(F.col("code").rlike(rule) & F.col("text").rlike(rule))
    module = strip_chars(F.regexp_extract("text", r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", 1), "\"'<>")
    return lines.select(*FILE_KEY, "language", F.when(module != "", module).otherwise(py_strip("text")).alias("module"),
                        (F.col("line").cast("long") * LINE).alias("pos"))


def extract_entities(files: DataFrame, num_partitions: int | None = None,
                     materialize: bool = True) -> Entities:
    """C1-C6 over analyzable ``files`` (see operators.files.source_files).

    With ``materialize`` the features of Python lines, the marks that hold something, the
    lines that these are read from and the four entity tables are stored as parquet in the
    session's checkpoint directory: every regular expression runs once, later branches read
    the columns they need from narrow tables, and a lost executor recomputes nothing
    upstream.  ``lines`` is not stored: text is read from its file."""
    def stored(**tables):
        return materialize_all(tables) if materialize else list(tables.values())

    if num_partitions is None:
        size = files.agg(F.sum(F.octet_length("content"))).first()[0]
        num_partitions = enough_partitions(files.sparkSession, size, TASK_TEXT)
    fp = partition_files(files.select(*FILE_KEY, "language", "content"), num_partitions)
    lines = (fp.select(*FILE_KEY, "language", F.posexplode(split_lines(F.col("content"))).alias("k", "text"))
             .select(*FILE_KEY, "language", (F.col("k") + 1).alias("line"), "text"))
    lf = python_lines(fp.where("language = 'Python'"))
    marks = bracket_entities(fp.where("language IN ('JavaScript', 'Java', 'C++')"), NOT_CALLEES, NOT_CALLEES_JAVA)
    lf, marks = stored(python=lf, marks=marks)
    read, = stored(lines=_lines_at(fp, lines_read(marks)))

    ent = python_entities(lf).unionByName(named_entities(marks, read))
    # pre-order: an entity comes before what it holds
    w_ord = Window.partitionBy(*FILE_KEY, "kind").orderBy("pos", F.desc("end_pos"), "name")
    in_file = Window.partitionBy(*FILE_KEY).orderBy("pos")
    line = F.shiftright("pos", 32).cast("int").alias("line")
    imports = (python_imports(lf).unionByName(source_modules(marks, read))
               .unionByName(cpp_includes(fp.where("language = 'C++'")))
               .withColumn("ord", F.row_number().over(in_file)).select(*FILE_KEY, "ord", "language", "module", line))
    ent, imports = stored(entities=ent.withColumn("ord", F.row_number().over(w_ord)), imports=imports)
    functions, classes = (ent.where(F.col("kind") == k) for k in ("function", "class"))

    # methods = functions whose innermost enclosing entity is the class
    members = (_parent_entity(ent).join(classes.select(*FILE_KEY, F.col("pos").alias("parent")), FILE_KEY + ["parent"])
               .where(F.col("kind") == "function").groupBy(*FILE_KEY, "parent")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("methods")))
    classes = (classes.join(members.withColumnRenamed("parent", "pos"), FILE_KEY + ["pos"], "left")
               .withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
               .select(*FILE_KEY, "ord", "name", "language", "line", "end_line", "methods"))
    called = python_calls(lf).unionByName(marks.where("callee IS NOT NULL").select(
        *FILE_KEY, "language", "callee", F.col("at").alias("pos")))
    calls = _callers(called, functions).withColumn("ord", F.row_number().over(in_file)).select(
        *FILE_KEY, "ord", "language", "caller", "callee", line)
    classes, calls = stored(classes=classes, calls=calls)
    return Entities(functions.select(*FILE_KEY, "ord", "name", "language", "parameters", "line", "end_line"),
                    classes, imports, calls, lines)


def _lines_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """``FILE_KEY, line, text`` at ``places (FILE_KEY, line)``: a file meets its list of lines."""
    listed = places.groupBy(*FILE_KEY).agg(F.array_sort(F.collect_set("line")).alias("places"))
    cut = files.join(listed, FILE_KEY).withColumn("all", split_lines(F.col("content")))
    found = F.transform(F.filter("places", lambda x: (x >= 1) & (x <= F.size("all"))), lambda x: F.struct(
        x.alias("line"), F.get("all", x - 1).alias("text")))
    return cut.select(*FILE_KEY, F.explode(found).alias("f")).select(*FILE_KEY, "f.line", "f.text")


def _parent_entity(ent: DataFrame) -> DataFrame:
    """``ent`` with ``parent``, the place where the innermost other entity around each
    begins.  Entities are laminar, so with the starts ordered outer first, the parent
    of an entity at depth d is the latest entity of depth d-1 that began before it."""
    starts = ent.select(*FILE_KEY, "kind", "name", "ord", "pos", "end_pos", F.lit(1).alias("_delta"), F.lit(1).alias("_k"))
    none = F.lit(None)
    ends = ent.select(*FILE_KEY, none.cast("string").alias("kind"), none.cast("string").alias("name"),
                      none.cast("int").alias("ord"), F.col("end_pos").alias("pos"), none.cast("long").alias("end_pos"),
                      F.lit(-1).alias("_delta"), F.lit(0).alias("_k"))
    w_run = (Window.partitionBy(*FILE_KEY).orderBy("pos", "_k", F.desc("end_pos"))
             .rowsBetween(Window.unboundedPreceding, 0))
    ev = starts.unionByName(ends).withColumn("depth", F.sum("_delta").over(w_run)).where(F.col("_k") == 1)
    # parent = last start of depth-1 before this one: shift the depth of
    # candidates by one and look in the same (file, depth) window
    cand = ev.withColumn("depth", F.col("depth") + 1).withColumn("begin", F.col("pos")).withColumn("_side", F.lit(0))
    me = ev.withColumn("begin", none.cast("long")).withColumn("_side", F.lit(1))
    w_lvl = (Window.partitionBy(*FILE_KEY, "depth").orderBy("pos", F.desc("end_pos"), "_side")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (cand.unionByName(me).withColumn("parent", F.last("begin", True).over(w_lvl)).where(F.col("_side") == 1)
            .select(*FILE_KEY, "kind", "name", "ord", "pos", "parent"))


def _callers(called: DataFrame, functions: DataFrame) -> DataFrame:
    """``called`` with the innermost named function around each call (NULL at top level)."""
    ranges = functions.select(*FILE_KEY, F.col("pos").alias("range_id"), F.col("pos").alias("line"),
                              (F.col("end_pos") - 1).alias("end_line"))
    around = innermost_enclosing(ranges, called.select(*FILE_KEY, F.col("pos").alias("point_id"), F.col("pos").alias("line")))
    names = functions.select(*FILE_KEY, F.col("pos").alias("range_id"), F.col("name").alias("caller"))
    return (called.join(around.select(*FILE_KEY, F.col("point_id").alias("pos"), "range_id"), FILE_KEY + ["pos"], "left")
            .join(names, FILE_KEY + ["range_id"], "left"))


def analysis_records(files: DataFrame, ent: Entities) -> DataFrame:
    """One row per analyzed file with the four ordered entity lists
    (empty list, not NULL, when a file has none)."""
    def nest(df, cols, alias):
        return (df.groupBy(*FILE_KEY)
                .agg(F.array_sort(F.collect_list(F.struct("ord", *cols))).alias(alias)))
    f = nest(ent.functions, ["name", "parameters", "line", "end_line"], "functions")
    c = nest(ent.classes, ["name", "line", "end_line", "methods"], "classes")
    i = nest(ent.imports, ["module", "line"], "imports")
    k = nest(ent.calls, ["caller", "callee", "line"], "calls")
    out = files.select(*FILE_KEY, "language")
    for t, name in ((f, "functions"), (c, "classes"), (i, "imports"), (k, "calls")):
        out = out.join(t, FILE_KEY, "left")
    empty = {
        "functions": "array<struct<ord:int,name:string,parameters:array<string>,line:int,end_line:int>>",
        "classes": "array<struct<ord:int,name:string,line:int,end_line:int,methods:array<string>>>",
        "imports": "array<struct<ord:int,module:string,line:int>>",
        "calls": "array<struct<ord:int,caller:string,callee:string,line:int>>",
    }
    for name, typ in empty.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(typ)))
    return out
