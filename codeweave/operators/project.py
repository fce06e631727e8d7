"""Project metadata: E4-E13 and D16 over the whole file tree of each project.

Every rule "a later rule overwrites an earlier one" becomes a ranked
candidate row ``(project_id, field, rank, value)`` and one
``max_by(value, rank)`` per (project, field): a single partial aggregate,
no per-project driver loop, and a project with millions of files is reduced
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import IGNORE_DIRS_PROJECT
from ..sources.store import materialize
from .files import has_ignored_part

# FIXED VALUES: framework markers (checked in this order; the first hit of a
# file counts) and lock files (checked in this order beside package.json)
PY_FRAMEWORKS = [("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask")]
JS_FRAMEWORKS = [(["react", "react-dom"], "React"), (["next"], "Next.js"), (["express"], "Express"),
                 (["vue"], "Vue"), (["@angular/core"], "Angular"), (["nest", "@nestjs/core"], "NestJS")]
JS_LOCKS = [(["package-lock.json"], "npm"), (["yarn.lock"], "Yarn"), (["pnpm-lock.yaml"], "pnpm"),
            (["bun.lockb", "bun.lock"], "Bun")]
CONFIG_NAMES = ["requirements.txt", "pyproject.toml", "package.json", "tsconfig.json", "pom.xml",
                "build.gradle", "go.mod", "Cargo.toml"]
README_FILES = ["README.md", "readme.md"]
DOCKER_FILES = ["Dockerfile", "docker-compose.yml"]
UNKNOWN = "Unknown"


def _parts(rel):
    return F.split(rel, "/")


def config_files(tree: DataFrame, name: str) -> DataFrame:
    """Files called ``name`` at the root or one/two directories down,
    where no directory on the way is ignored or starts with '.'.  Order:
    root first, then by path."""
    parts = _parts(F.col("rel_path"))
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    ok = ((F.element_at(parts, -1) == name) & (F.size(parts) <= 3)
          & ~F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in IGNORE_DIRS_PROJECT]))
          & ~F.exists(dirs, lambda d: d.startswith(".")))
    return (tree.where(ok).select("project_id", "rel_path", "content",
                                  P.dirname(F.col("rel_path")).alias("dir"),
                                  F.struct((F.size(parts) > 1).alias("nested"), F.col("rel_path").alias("p"))
                                  .alias("order")))


def language_distribution(tree: DataFrame) -> DataFrame:
    """E5: (project_id, language, files) over every file with a known
    language outside the ignored directories."""
    return (tree.where(F.col("language").isNotNull()
                       & ~has_ignored_part(F.col("rel_path"), IGNORE_DIRS_PROJECT))
            .groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files")))


def project_info(tree: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """E6-E10 + D16: one row per project with language, framework,
    package_manager, build_tool, has_readme, has_docker, has_gitignore and
    the language distribution map.

    ``tree`` supplies paths and languages only (its content is never read
    when ``configs`` is given); ``configs`` holds (project_id, rel_path,
    content) of the candidate config files, e.g. from a glob-filtered listing
    (``sources.filesystem.read_config_files``).  Without it the candidates
    are picked from ``tree`` in one pass."""
    projects = tree.select("project_id").distinct()
    root = F.col("rel_path")
    flags = (tree.groupBy("project_id").agg(
        F.bool_or(root.isin(*README_FILES)).alias("has_readme"),
        F.bool_or(root.isin(*DOCKER_FILES)).alias("has_docker"),
        F.bool_or(root == ".gitignore").alias("has_gitignore"),
        F.bool_or(root == "CMakeLists.txt").alias("has_cmake"),
        F.bool_or(root == "Makefile").alias("has_make"),
        F.bool_or(P.suffix(root) == ".csproj").alias("has_csproj")))

    # one pass over the tree picks the config-file candidates (the only rows
    # whose content is read); every rule below works on that small table
    src = configs if configs is not None else tree
    cand_files = materialize(
        src.where(P.basename(F.col("rel_path")).isin(*CONFIG_NAMES) & (F.size(F.split("rel_path", "/")) <= 3))
        .select("project_id", "rel_path", "content"), "config-candidates")
    req = config_files(cand_files, "requirements.txt")
    pyproject = config_files(cand_files, "pyproject.toml")
    pkg = config_files(cand_files, "package.json")
    tsconfig = config_files(cand_files, "tsconfig.json")
    pom = config_files(cand_files, "pom.xml")
    gradle = config_files(cand_files, "build.gradle")
    gomod = config_files(cand_files, "go.mod")
    cargo = config_files(cand_files, "Cargo.toml")

    # Sibling files of each config file's directory
    siblings = tree.select("project_id", P.dirname(F.col("rel_path")).alias("dir"),
                           P.basename(F.col("rel_path")).alias("name"))
    sib_names = [n for names, _ in JS_LOCKS for n in names] + ["poetry.lock"]
    sib = (siblings.where(F.col("name").isin(*sib_names))
           .groupBy("project_id", "dir").agg(F.collect_set("name").alias("siblings")))

    # framework candidates: requirements files (rank 0), then package.json (rank 1)
    low = F.lower(F.col("content"))
    py_fw = None
    for marker, fw in PY_FRAMEWORKS:
        py_fw = (F.when(low.contains(marker), F.lit(fw)) if py_fw is None
                 else py_fw.when(low.contains(marker), F.lit(fw)))
    def dep_keys(path):
        m = F.from_json(F.get_json_object("content", path), "map<string,string>")
        return F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    # H3: dependencies ∪ devDependencies (key sets; values are not used)
    pkg = (pkg.withColumn("_deps", F.array_union(dep_keys("$.dependencies"), dep_keys("$.devDependencies")))
           .withColumn("_valid", F.get_json_object("content", "$").isNotNull()))
    pkg_all = pkg
    pkg = pkg.where("_valid")
    js_fw = None
    for names, fw in JS_FRAMEWORKS:
        cond = F.arrays_overlap(F.col("_deps"), F.array(*[F.lit(n) for n in names]))
        js_fw = F.when(cond, F.lit(fw)) if js_fw is None else js_fw.when(cond, F.lit(fw))
    pkg = pkg.join(sib, ["project_id", "dir"], "left")
    lock = None
    for names, pm in JS_LOCKS:
        cond = F.arrays_overlap(F.coalesce("siblings", F.array().cast("array<string>")),
                                F.array(*[F.lit(n) for n in names]))
        lock = F.when(cond, F.lit(pm)) if lock is None else lock.when(cond, F.lit(pm))

    def cand(df, field, rank, value):
        return df.select("project_id", F.lit(field).alias("field"),
                         F.struct(F.lit(rank).alias("r"), F.col("order").alias("o")).alias("rank"),
                         value.alias("value"))

    pyp_poetry = pyproject.join(sib, ["project_id", "dir"], "left").where(
        F.array_contains(F.coalesce("siblings", F.array().cast("array<string>")), "poetry.lock"))
    cands = (cand(req, "framework", 0, py_fw)
             .unionByName(cand(pkg, "framework", 1, js_fw))
             .unionByName(cand(req, "package_manager", 0, F.lit("pip")))
             .unionByName(cand(pyproject, "package_manager", 0, F.lit("pip")))
             .unionByName(cand(pyp_poetry, "package_manager", 1, F.lit("Poetry")))
             .unionByName(cand(pkg, "package_manager", 2, lock))
             .unionByName(cand(gomod, "package_manager", 3, F.lit("go modules")))
             .unionByName(cand(cargo, "package_manager", 4, F.lit("cargo")))
             .unionByName(cand(gradle, "build_tool", 0, F.lit("Gradle")))
             .unionByName(cand(pom, "build_tool", 1, F.lit("Maven")))
             .unionByName(cand(tsconfig, "has_tsconfig", 0, F.lit("true")))
             .unionByName(cand(pkg.where(F.array_contains("_deps", "typescript")), "has_tsconfig", 0,
                               F.lit("true")))
             .unionByName(cand(pkg_all, "has_package_json", 0, F.lit("true")))
             .unionByName(cand(req, "has_python_config", 0, F.lit("true")))
             .unionByName(cand(pyproject, "has_python_config", 0, F.lit("true")))
             .unionByName(cand(pom, "has_java_config", 0, F.lit("true")))
             .unionByName(cand(gradle, "has_java_config", 0, F.lit("true")))
             .unionByName(cand(gomod, "has_go", 0, F.lit("true")))
             .unionByName(cand(cargo, "has_cargo", 0, F.lit("true")))
             .where(F.col("value").isNotNull()))
    fields = (cands.groupBy("project_id")
              .pivot("field", ["framework", "package_manager", "build_tool", "has_tsconfig",
                               "has_package_json", "has_python_config", "has_java_config", "has_go",
                               "has_cargo"])
              .agg(F.max_by("value", "rank")))

    dist = language_distribution(tree)
    w = Window.partitionBy("project_id").orderBy(F.desc("files"), "language")
    dist_agg = (dist.groupBy("project_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("language_distribution"),
        F.sum(F.when(F.col("language") == "TypeScript", F.col("files")).otherwise(0)).alias("_ts"),
        F.sum(F.when(F.col("language") == "JavaScript", F.col("files")).otherwise(0)).alias("_js")))
    dominant = (dist.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
                .select("project_id", F.col("language").alias("_dominant")))
    out = (projects.join(flags, "project_id", "left").join(fields, "project_id", "left")
           .join(dist_agg, "project_id", "left").join(dominant, "project_id", "left"))
    has_ts = F.col("has_tsconfig").isNotNull()
    ts, js = F.coalesce("_ts", F.lit(0)), F.coalesce("_js", F.lit(0))
    language = (F.when(F.col("_dominant").isNotNull(),
                       F.when((has_ts | (ts > 0)) & (ts >= js), F.lit("TypeScript")).otherwise(F.col("_dominant")))
                .when(F.col("has_package_json").isNotNull(),
                      F.when(has_ts, F.lit("TypeScript")).otherwise(F.lit("JavaScript")))
                .when(F.col("has_python_config").isNotNull(), F.lit("Python"))
                .when(F.col("has_java_config").isNotNull(), F.lit("Java"))
                .when(F.col("has_go").isNotNull(), F.lit("Go"))
                .when(F.col("has_cargo").isNotNull(), F.lit("Rust"))
                .otherwise(F.lit(UNKNOWN)))
    build = (F.when(F.col("has_cmake"), F.lit("CMake")).when(F.col("has_make"), F.lit("Make"))
             .when(F.col("has_csproj"), F.lit(".NET"))
             .otherwise(F.coalesce(F.col("build_tool"), F.lit(UNKNOWN))))
    return out.select(
        "project_id", language.alias("language"),
        F.coalesce("framework", F.lit(UNKNOWN)).alias("framework"),
        F.coalesce("package_manager", F.lit(UNKNOWN)).alias("package_manager"),
        build.alias("build_tool"),
        F.coalesce("has_readme", F.lit(False)).alias("has_readme"),
        F.coalesce("has_docker", F.lit(False)).alias("has_docker"),
        F.coalesce("has_gitignore", F.lit(False)).alias("has_gitignore"),
        F.coalesce("language_distribution",
                   F.create_map().cast("map<string,bigint>")).alias("language_distribution"))


def project_totals(discovered: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Source files discovered, functions and classes extracted."""
    s = discovered.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_source_files"))
    f = functions.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_functions"))
    c = classes.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_classes"))
    return (s.join(f, "project_id", "left").join(c, "project_id", "left")
            .select("project_id", "total_source_files",
                    F.coalesce("total_functions", F.lit(0)).alias("total_functions"),
                    F.coalesce("total_classes", F.lit(0)).alias("total_classes")))


def module_files(files: DataFrame) -> DataFrame:
    """E13 membership: one row per analyzed file with its module (parent
    directory relative to the project root, '.' -> 'root')."""
    d = P.dirname(P.normpath(F.col("rel_path")))
    return (files.select("project_id", "file_path", F.when(d == "", F.lit("root")).otherwise(d).alias("path"))
            .withColumn("name", F.when(F.col("path") == "root", F.lit("root"))
                        .otherwise(F.element_at(F.split("path", "/"), -1))))


def detect_modules(files: DataFrame) -> DataFrame:
    """E13 + G1: one row per module with bounded facts (file count, first
    file); ``pos`` orders modules by (name, first file) inside each project.
    Membership stays in rows (:func:`module_files`), so a huge directory is
    never one array, and positions come from range-partitioned offsets, so
    a project with millions of directories is never sorted in one task."""
    from .rollup import group_offsets
    m = (module_files(files).groupBy("project_id", "path", "name")
         .agg(F.count(F.lit(1)).alias("file_count"), F.min("file_path").alias("first_file"))
         .withColumn("_key", F.struct("name", "first_file")))
    off = group_offsets(m.select("project_id", "_key", F.lit(1).alias("_n")), "_key")
    return (m.join(off, ["project_id", "_key"])
            .select("project_id", (F.col("_off") + 1).cast("int").alias("pos"), "name", "path", "file_count",
                    "first_file"))
