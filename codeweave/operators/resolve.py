"""Name and path resolution: E1-E3, D1-D7.

Every "first writer wins" / "last writer wins" dictionary of the original
becomes a ``min`` / ``max`` (or ``min_by``) aggregate that reduces an index
to ONE row per key before any join, so a hot name (``__init__``, ``get``) can
never fan a join out, and the aggregates run partially on the map side.
Ordered fallbacks become an array of ranked candidate keys that is
exploded, equi-joined once against the reduced key table, and folded back
with ``min_by(target, rank)``: no OR join conditions (which would plan as a
nested loop) and no per-candidate join chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import EXTERNAL_FILE, PACKAGE_INDEX_FILES
from ..sources.store import enough_partitions

FILE_KEY = ["project_id", "file_path"]
#: files and imports per partition of path resolution (each has some ten keys), and
#: parts per partition into which the files of a project are dealt
TASK_ROWS, PARTS = 50_000, 8


def path_partitions(*tables: DataFrame) -> int:
    """Partitions of path resolution: they follow the rows of ``tables``."""
    return enough_partitions(tables[0].sparkSession, sum(t.count() for t in tables), TASK_ROWS)


def in_parts(df: DataFrame, n: int) -> DataFrame:
    """``_part``: a number by file path, so that rows of a hot project or module go to all
    ``n`` partitions and are reduced to one per part before they meet."""
    return df.withColumn("_part", F.pmod(F.xxhash64("file_path"), F.lit(n * PARTS)))


# --------------------------------------------------------------------- E1
def function_index(functions: DataFrame) -> DataFrame:
    """Name -> its definitions, reduced to bounded facts per key (count,
    first and last definition in (file, pre-order) order).  The definitions
    themselves stay rows of ``functions``: a hot name is never collected into
    one array."""
    o = F.struct("file_path", "ord")
    d = F.struct("file_path", "line", "language")
    return (functions.groupBy("project_id", "name")
            .agg(F.count(F.lit(1)).alias("n_definitions"),
                 F.min_by(d, o).alias("first"), F.max_by(d, o).alias("last")))


def function_entries(functions: DataFrame) -> DataFrame:
    """E1 in full: every definition under its name; definitions of a name are
    ordered by (file_path, ord)."""
    return functions.where(F.col("name").isNotNull()).select(
        "project_id", "name", "file_path", "ord", "line", "end_line", "language")


def first_definition_in_project(functions: DataFrame) -> DataFrame:
    """(project_id, name) -> first definition by (file order, pre-order)."""
    return (functions.groupBy("project_id", "name")
            .agg(F.min_by(F.struct("file_path", "line"), F.struct("file_path", "ord")).alias("d"))
            .select("project_id", "name", F.col("d.file_path").alias("def_file"),
                    F.col("d.line").alias("def_line")))


def first_definition_in_file(functions: DataFrame) -> DataFrame:
    """(project_id, file_path, name) -> first definition in that file."""
    return (functions.groupBy(*FILE_KEY, "name")
            .agg(F.min_by("line", "ord").alias("def_line")))


# ------------------------------------------------------------------ D1, D2
def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """D1 + D2: resolved caller and callee of every call with a callee.

    Resolution order for a name: same file (first definition), else first
    definition in the project, else a fallback (caller: this file with a NULL
    line; callee: the 'external' file).  A top-level call's caller is the
    file's base name.

    Plan: the same-file lookups need no join -- definitions and the two
    probes of every call (its caller name and its callee name) are unioned,
    repartitioned ONCE by (project_id, file_path), and a window per
    (file, name) hands every probe the file's first definition; the probes
    are folded back per call inside the same partitioning; then one left join
    per side with the one-row-per-name project index supplies the fallback."""
    c = calls.where(F.col("callee").isNotNull() & (F.col("callee") != ""))
    cols = ["ord", "caller", "callee", "line"]
    defs = functions.select(*FILE_KEY, F.col("name").alias("_key"), F.lit(0).alias("_kind"),
                            F.col("ord").alias("_dord"), F.col("line").alias("_dline"),
                            *[F.lit(None).cast(t).alias(n) for n, t in
                              (("ord", "int"), ("caller", "string"), ("callee", "string"), ("line", "int"))])
    probe = [c.select(*FILE_KEY, F.col(name).alias("_key"), F.lit(kind).alias("_kind"),
                      F.lit(None).cast("int").alias("_dord"), F.lit(None).cast("int").alias("_dline"), *cols)
             for name, kind in (("caller", 1), ("callee", 2))]
    ev = (defs.unionByName(probe[0].where(F.col("_key").isNotNull())).unionByName(probe[1])
          .repartition(*FILE_KEY))
    w = Window.partitionBy(*FILE_KEY, "_key")
    ev = (ev.withColumn("_first", F.min_by("_dline", "_dord").over(w))
          .where(F.col("_kind") > 0))
    per_call = (ev.groupBy(*FILE_KEY, "ord")
                .agg(F.first("caller", ignorenulls=True).alias("caller"),
                     F.first("callee", ignorenulls=True).alias("callee"),
                     F.first("line", ignorenulls=True).alias("line"),
                     F.max(F.when(F.col("_kind") == 1, F.col("_first"))).alias("cr_fline"),
                     F.max(F.when(F.col("_kind") == 2, F.col("_first"))).alias("ce_fline")))

    in_proj = first_definition_in_project(functions)

    def project_fallback(df, name_col, prefix):
        """Left join with the one-row-per-name project index; rows resolved
        in their own file keep their same-file answer."""
        p = in_proj.select("project_id", F.col("name").alias(name_col),
                           F.col("def_file").alias(prefix + "_pfile"),
                           F.col("def_line").alias(prefix + "_pline"))
        return df.join(p, ["project_id", name_col], "left")

    r = project_fallback(project_fallback(per_call, "caller", "cr"), "callee", "ce")
    caller = (F.when(F.col("caller").isNull(),
                     F.struct(P.basename(F.col("file_path")).alias("name"),
                              F.col("file_path").alias("file"), F.lit(None).cast("int").alias("line")))
              .when(F.col("cr_fline").isNotNull(),
                    F.struct(F.col("caller").alias("name"), F.col("file_path").alias("file"),
                             F.col("cr_fline").alias("line")))
              .when(F.col("cr_pfile").isNotNull(),
                    F.struct(F.col("caller").alias("name"), F.col("cr_pfile").alias("file"),
                             F.col("cr_pline").alias("line")))
              .otherwise(F.struct(F.col("caller").alias("name"), F.col("file_path").alias("file"),
                                  F.lit(None).cast("int").alias("line"))))
    callee = (F.when(F.col("ce_fline").isNotNull(),
                     F.struct(F.col("callee").alias("name"), F.col("file_path").alias("file"),
                              F.col("ce_fline").alias("line")))
              .when(F.col("ce_pfile").isNotNull(),
                    F.struct(F.col("callee").alias("name"), F.col("ce_pfile").alias("file"),
                             F.col("ce_pline").alias("line")))
              .otherwise(F.struct(F.col("callee").alias("name"), F.lit(EXTERNAL_FILE).alias("file"),
                                  F.lit(None).cast("int").alias("line"))))
    return r.select(*FILE_KEY, "ord", caller.alias("caller_info"), callee.alias("callee_info"),
                    F.col("line").alias("call_line"))


# --------------------------------------------------------------------- E3
def project_roots(files: DataFrame) -> DataFrame:
    """Common root directory of each project's files (a single file ->
    its directory).  One partial aggregate per project (min/max of the path
    component arrays); a huge project is reduced map-side."""
    agg = (files.select("project_id", F.split(P.normpath("file_path"), "/").alias("_parts"))
           .groupBy("project_id")
           .agg(F.min("_parts").alias("lo"), F.max("_parts").alias("hi")))
    n = P.common_prefix_len(F.col("lo"), F.col("hi"))
    n = F.when(F.col("lo") == F.col("hi"), F.size("lo") - 1).otherwise(n)
    return agg.select("project_id", F.array_join(F.slice("lo", 1, n), "/").alias("root"))


# --------------------------------------------------------------------- E2
def module_key_index(files: DataFrame, roots: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(project_id, key) -> file.  Exact keys (full dotted path, dotted /
    slash relative path, relative path with suffix): the LAST file in order
    wins.  Suffix keys and the package key of ``__init__``: the FIRST file
    wins, and only where no exact key exists.  Keys are reduced per part of a
    project first, since every folder may hold a file of the same name."""
    roots = roots if roots is not None else project_roots(files)
    n = partitions or path_partitions(files)
    # staged columns: each path expression is computed once, not inlined
    f = (in_parts(files.select(*FILE_KEY).join(roots, "project_id"), n).repartition(n, "project_id", "_part")
         .withColumn("_norm", P.normpath("file_path"))
         .withColumn("_rel", P.strip_root("_norm", "root"))
         .withColumn("_rel_nosfx", P.drop_suffix("_rel"))
         .withColumn("_parts", F.split("_rel_nosfx", "/")))
    parts = F.col("_parts")
    exact = F.array(F.regexp_replace(P.drop_suffix("_norm"), "/", "."), F.array_join(parts, "."),
                    F.col("_rel_nosfx"), F.col("_rel"))
    pkg = F.when(F.element_at(parts, -1) == "__init__",
                 F.array(F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")))\
        .otherwise(F.array().cast("array<string>"))
    loose = F.concat(P.suffix_keys(parts, "."), P.suffix_keys(parts, "/"), pkg)
    keys = F.concat(F.transform(exact, lambda k: F.struct(F.lit(0).alias("tier"), k.alias("key"))),
                    F.transform(loose, lambda k: F.struct(F.lit(1).alias("tier"), k.alias("key"))))
    k = f.select(*FILE_KEY, "_part", F.explode(F.array_distinct(keys)).alias("k")).select(
        *FILE_KEY, "_part", "k.tier", "k.key")
    return (k.groupBy("project_id", "_part", "key")
            .agg(F.max(F.when(F.col("tier") == 0, F.col("file_path"))).alias("exact_file"),
                 F.min(F.when(F.col("tier") == 1, F.col("file_path"))).alias("loose_file"))
            .repartition(n, "project_id", "key").groupBy("project_id", "key")
            .agg(F.coalesce(F.max("exact_file"), F.min("loose_file")).alias("target")))


# --------------------------------------------------------------------- D3
def known_file_keys(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """D3: (project_id, key) -> file for the normalised path, the path
    without its suffix and, for package index files, the directory.  Last
    writer (in file order) wins."""
    n = partitions or path_partitions(files)
    norm = F.col("_norm")
    is_index = P.basename(F.col("file_path")).isin(*PACKAGE_INDEX_FILES)
    keys = F.concat(F.array(norm, P.drop_suffix(norm)),
                    F.when(is_index, F.array(P.dirname(norm))).otherwise(F.array().cast("array<string>")))
    return (files.select("project_id", "file_path").withColumn("_norm", P.normpath("file_path"))
            .select("project_id", "file_path", F.explode(F.array_distinct(keys)).alias("key"))
            .repartition(n, "project_id", "key").groupBy("project_id", "key").agg(F.max("file_path").alias("target")))


# ------------------------------------------------------------------ D4-D7
def resolve_imports(imports: DataFrame, files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(project_id, source, target, module, line) for imports that
    resolve to another analyzed file, in (file, import) order.

    Plan: the paths of a relative import depend on its folder, its names in the
    module index on the module alone; both are looked up once per part of a
    project (``in_parts``), so a module that all files import meets the index in a
    bounded number of rows.  Partitions follow the files and imports: AQE would
    join them by compressed size, and paths are long, alike and sorted."""
    n = path_partitions(imports, files)
    m = F.col("module")
    imp = in_parts(imports.where(F.col("project_id").isNotNull() & F.col("file_path").isNotNull() & F.col("ord").isNotNull()), n)
    imp = (imp.select(*FILE_KEY, "ord", "module", "line", "_part",
                      F.when(m.startswith("."), P.dirname(P.normpath("file_path"))).alias("_dir"))
           .repartition(n, "project_id", "_part", "module"))
    asked = imp.where(m.isNotNull() & (m != ""))
    dots = F.length(F.regexp_extract(m, r"^\.*", 0))
    is_rel = m.startswith(".")
    is_py_rel = is_rel & ~m.contains("/") & ~m.contains("\\")
    remainder = F.regexp_replace(m, r"^\.*", "")

    def cand(rank, key):
        return F.struct(F.lit(rank).alias("rank"), key.alias("key"))

    def look_up(probes, key, cands, table, prefix):
        """``key``, ``<prefix>rank`` and ``<prefix>target``: the first candidate that ``table`` has."""
        hit = (probes.select(*key, F.explode(F.filter(cands, lambda x: x.isNotNull())).alias("c"))
               .select(*key, "c.rank", "c.key").repartition(n, "project_id", "key")
               .join(table, ["project_id", "key"], "inner"))
        return (hit.select(*key, "rank", "target").repartition(n, *key).groupBy(*key)
                .agg(F.min("rank").alias(prefix + "rank"), F.min_by("target", "rank").alias(prefix + "target")))

    by_name = ["project_id", "_part", "module"]
    names = F.array(F.when(is_py_rel & (remainder != ""), cand(4, remainder)), cand(5, m),
                    F.when(m.contains("."), cand(6, F.regexp_replace(m, r"\.[^.]*$", ""))))
    named = look_up(asked.select(*by_name).distinct(), by_name, names, module_key_index(files, roots, n), "n_")

    # staged path columns (each computed once)
    by_path = ["project_id", "_part", "_dir", "module"]
    src_dir = F.col("_dir")
    dir_parts = F.when(src_dir == "", F.array().cast("array<string>")).otherwise(F.split(src_dir, "/"))
    up = F.slice(dir_parts, 1, F.greatest(F.size(dir_parts) - (dots - 1), F.lit(0)))
    rel = (asked.where(is_rel).select(*by_path).distinct()
           .withColumn("_py_raw", F.when(remainder != "", F.array_join(F.concat(up, F.split(remainder, r"\.")), "/"))
                       .otherwise(F.array_join(up, "/")))
           .withColumn("_py", P.normpath("_py_raw"))
           .withColumn("_js", P.normpath(F.when(src_dir == "", m).otherwise(F.concat(src_dir, F.lit("/"), m)))))
    py_combined, js_combined = F.col("_py"), F.col("_js")
    init_path = F.when(py_combined == ".", F.lit("__init__.py")).otherwise(F.concat(py_combined, F.lit("/__init__.py")))
    py_c = F.array(cand(1, py_combined), cand(2, F.concat(py_combined, F.lit(".py"))), cand(3, init_path))
    js_c = F.array(cand(1, js_combined), cand(2, P.drop_suffix(js_combined)),
                   cand(3, F.concat(js_combined, F.lit("/index"))))
    placed = look_up(rel, by_path, F.when(is_py_rel, py_c).otherwise(js_c), known_file_keys(files, n), "p_")

    found = (imp.join(named, by_name, "left").repartition(n, *by_path).join(placed, by_path, "left")
             .repartition(n, *FILE_KEY))
    # rows that share a file and a number share the target
    w = Window.partitionBy(*FILE_KEY, "ord")
    out = found.withColumn("target", F.min_by(F.coalesce("p_target", "n_target"), F.coalesce("p_rank", "n_rank")).over(w))
    out = out.where(P.normpath(F.col("target")) != P.normpath(F.col("file_path")))
    return out.select("project_id", F.col("file_path").alias("source"), "target", "module", "line", "ord")
