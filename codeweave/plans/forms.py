"""Entities of code in many layouts: several definitions and imports on a line,
bodies that are expressions, wrapped arrows, C++ declarators, blocks of one line.

Every document becomes a file in one of four languages by its number; a formula
gives the names, and the whole text of the document follows as comment.  The oracle
states the entities of each layout from the same numbers, never by parsing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import Entities, extract_entities
from ..operators.files import analyzable, files_from_paths
from ..session import read_table
from .corpus import as_bigint

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: suffix, language and lines of each layout; {a} and {b} are numbers of the document
LAYOUTS = [
    ("js", "JavaScript", [
        'import p{a} from "./p_{a}"; import q from "../q_{b}";',
        "const w_{a} = wrap(async (req, res) => {",
        "  send_{b}(res); });",
        "const e_{a} = (p) => (",
        "  h_{b}(p)",
        ");",
        "function a_{a}(){x_{a}()} function b_{b}(u, v){y_{b}()} z_{a}();",
        "const { d_{a}, k } = use(() => get_{b}());"]),
    ("java", "Java", [
        "import m.A_{a}; import n.B_{b};",
        "class X_{a} {",
        "  X_{a}(int i) { init_{b}(i); } int f_{a}() { return g_{b}(); }",
        "  int big_{b}(",
        "    int u,",
        "    Map<String, Integer> v) { return m_{a}(u); }",
        "}"]),
    ("cpp", "C++", [
        "#include <v_{a}>",
        "class K_{a} : public B, public C {",
        " public:",
        "  K_{a}(int x) : x_(x), y_{one_{b}(x)} { start_{a}(); }",
        "  ~K_{a}() { stop_{b}(); }",
        "  bool operator==(const K_{a}& o) const { return same_{a}(o); }",
        "  int get_{b}() const;",
        "};",
        "unsigned long long big_{b}(int n) {",
        "  return K_{a}::twice(n);",
        "}"]),
    ("py", "Python", [
        "import a_{a}; import b_{b}",
        "try: import z_{a}",
        "except ImportError: z = None",
        "if x: from y_{b}.q import w",
        "def f_{a}(u, v=(1, 2)): return g_{b}(u)",
        "class P_{b}:",
        "    async def run(self,",
        "                  k=1): return self.go_{a}()"]),
]
#: name, parameters, first and last line of the functions of each layout, in order
FUNCTIONS = [
    [("w_{a}", "req | res", 2, 3), ("e_{a}", "p", 4, 6), ("a_{a}", "", 7, 7), ("b_{b}", "u | v", 7, 7), ("{ d_{a}, k }", "", 8, 8)],
    [("X_{a}", "int i", 3, 3), ("f_{a}", "", 3, 3), ("big_{b}", "int u | Map<String, Integer> v", 4, 6)],
    [("K_{a}", "int x", 4, 4), ("~K_{a}", "", 5, 5), ("operator==", "const K_{a}& o", 6, 6), ("big_{b}", "int n", 9, 11)],
    [("f_{a}", "u | v=(1, 2)", 5, 5), ("run", "self | k=1", 7, 8)],
]
CLASSES = [[], [("X_{a}", "X_{a},f_{a},big_{b}", 2, 7)], [("K_{a}", "K_{a},~K_{a},operator==", 2, 8)], [("P_{b}", "run", 6, 8)]]
IMPORTS = [[("./p_{a}", 1), ("../q_{b}", 1)], [("m.A_{a}", 1), ("n.B_{b}", 1)], [("v_{a}", 1)],
           [("a_{a}", 1), ("b_{b}", 1), ("z_{a}", 2), ("y_{b}.q", 4)]]
CALLS = [
    [(None, "wrap", 2), ("w_{a}", "send_{b}", 3), ("e_{a}", "h_{b}", 5), ("a_{a}", "x_{a}", 7), ("b_{b}", "y_{b}", 7),
     (None, "z_{a}", 7), (None, "use", 8), ("{ d_{a}, k }", "get_{b}", 8)],
    [("X_{a}", "init_{b}", 3), ("f_{a}", "g_{b}", 3), ("big_{b}", "m_{a}", 6)],
    [("K_{a}", "one_{b}", 4), ("K_{a}", "start_{a}", 4), ("~K_{a}", "stop_{b}", 5), ("operator==", "same_{a}", 6),
     ("big_{b}", "twice", 10)],
    [("f_{a}", "g_{b}", 5), ("run", "go_{a}", 8)],
]


def _text(pattern: str | None) -> str:
    """SQL (of Spark and DuckDB) of a text with the document's numbers in it."""
    if pattern is None:
        return "CAST(NULL AS STRING)"
    parts = [f"CAST({p} AS STRING)" if p in ("a", "b") else f"'{p}'"
             for p in re.split(r"\{([ab])\}", pattern) if p]
    return f"concat({', '.join(parts)})" if parts else "''"


def _rows(layouts: list[list[tuple]], columns: list[str]) -> str:
    """SQL of the expected rows: one branch per place in a layout."""
    out = []
    for k, rows in enumerate(layouts):
        for at, row in enumerate(rows):
            cells = [f"CAST({x} AS BIGINT) AS {c}" if isinstance(x, int) else f"{_text(x)} AS {c}" for x, c in zip(row, columns)]
            out.append(f"SELECT project_id, file_path, CAST({at + 1} AS BIGINT) AS ord, '{LAYOUTS[k][1]}' AS language, "
                       f"{', '.join(cells)} FROM d WHERE k = {k}")
    suffix = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _, _) in enumerate(LAYOUTS)) + " END"
    return (f"WITH d AS (SELECT source AS project_id, 'forms/doc_' || doc_id || '.' || {suffix} AS file_path, doc_id % 4 AS k, "
            "doc_id % 7 AS a, doc_id % 5 AS b FROM documents)\n" + "\nUNION ALL ".join(out))


def form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source AS project_id", "doc_id % 4 AS k", "doc_id % 7 AS a", "doc_id % 5 AS b", "coalesce(text, '') AS body")
    suffix = F.element_at(F.array(*(F.lit(s) for s, _, _ in LAYOUTS)), (F.col("k") + 1).cast("int"))
    code = F.element_at(F.array(*(F.expr("array_join(array(" + ", ".join(map(_text, lines)) + "), '\n')")
                                  for _, _, lines in LAYOUTS)), (F.col("k") + 1).cast("int"))
    note = F.when(F.col("k") == 3, "# ").otherwise("// ")
    text = F.concat(code, F.lit("\n"), note, F.regexp_replace("body", r"\r\n|[\n\r]", " "))
    path = F.concat(F.lit("forms/doc_"), F.col("doc_id"), F.lit("."), suffix)
    return analyzable(files_from_paths(docs.select("project_id", path.alias("rel_path"), path.alias("file_path"),
                                                   text.alias("content"))))


_STORED: dict[tuple[str, str], tuple[SparkSession, Entities]] = {}


def entities(spark: SparkSession, sf_dir: str) -> Entities:
    """Extracted once per session and dataset."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _STORED or _STORED[key][0] is not spark:
        _STORED[key] = spark, extract_entities(form_files(spark, sf_dir))
    return _STORED[key][1]


def register(name: str, layouts: list[list[tuple]], columns: list[str]):
    def deco(fn):
        QUERIES[name] = (lambda spark, sf_dir: as_bigint(fn(spark, sf_dir)), _rows(layouts, columns))
        return fn
    return deco


@register("c1_forms_functions", FUNCTIONS, ["name", "parameters", "line", "end_line"])
def c1_forms_functions(spark, sf_dir):
    return entities(spark, sf_dir).functions.withColumn("parameters", F.array_join("parameters", " | "))


@register("c2_forms_classes", CLASSES, ["name", "methods", "line", "end_line"])
def c2_forms_classes(spark, sf_dir):
    return entities(spark, sf_dir).classes.withColumn("methods", F.array_join("methods", ","))


@register("c4_forms_imports", IMPORTS, ["module", "line"])
def c4_forms_imports(spark, sf_dir):
    return entities(spark, sf_dir).imports


@register("c5_forms_calls", CALLS, ["caller", "callee", "line"])
def c5_forms_calls(spark, sf_dir):
    return entities(spark, sf_dir).calls


# ------------------------------------------------- import paths and config files
#: files of a document's folder, and (file, module, file it resolves to or None)
PATHS = ["pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "top.py", "ui/app.js", "ui/lib/index.js",
         "ui/lib/util.js", "shared.js"]
RELATIVE = [
    ("pkg/sub/b.py", "..a", "pkg/a.py"), ("pkg/sub/b.py", ".", "pkg/sub/__init__.py"), ("pkg/sub/b.py", "..", "pkg/__init__.py"),
    ("pkg/sub/b.py", "...top", "top.py"), ("pkg/sub/b.py", "..sub", "pkg/sub/__init__.py"), ("pkg/sub/b.py", ".absent.name", None),
    ("pkg/__init__.py", ".a", "pkg/a.py"), ("pkg/__init__.py", ".", None), ("ui/app.js", "./lib", "ui/lib/index.js"),
    ("ui/app.js", "./lib/util.js", "ui/lib/util.js"), ("ui/app.js", "./lib/util", "ui/lib/util.js"),
    ("ui/app.js", "../shared", "shared.js"), ("ui/app.js", "./lib/../../shared.js", "shared.js"), ("ui/lib/util.js", "..", None),
    ("ui/lib/util.js", "../app", "ui/app.js"), ("ui/lib/util.js", ".", "ui/lib/index.js"),
]

_RELATIVE_SQL = ("WITH d AS (SELECT source AS project_id, 'd' || doc_id || '/' AS f FROM documents)\n" + "\nUNION ALL ".join(
    f"SELECT project_id, f || '{source}' AS source, f || '{target}' AS target, '{module}' AS module, "
    f"CAST({i + 1} AS BIGINT) AS line FROM d" for i, (source, module, target) in enumerate(RELATIVE) if target))


def d4_forms_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and current packages, index files, paths that climb."""
    from ..operators.resolve import resolve_imports
    docs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"),
                                                         F.concat(F.lit("d"), F.col("doc_id"), F.lit("/")).alias("f"))
    files = docs.select("project_id", F.explode(F.array(*(F.concat("f", F.lit(p)) for p in PATHS))).alias("file_path"))
    rows = F.array(*(F.struct(F.concat("f", F.lit(source)).alias("file_path"), F.lit(module).alias("module"),
                              F.lit(i + 1).alias("line")) for i, (source, module, _) in enumerate(RELATIVE)))
    imports = docs.select("project_id", F.explode(rows).alias("r")).select(
        "project_id", "r.file_path", F.col("r.line").alias("ord"), F.lit("x").alias("language"), "r.module", "r.line")
    return resolve_imports(imports, files).drop("ord")


QUERIES["d4_forms_relative"] = (lambda spark, sf_dir: as_bigint(d4_forms_relative(spark, sf_dir)), _RELATIVE_SQL)

#: files of a project, and its language, package manager and build tool
CONFIGS = [
    (["pyproject.toml", "poetry.lock"], "Python", "Poetry", "Unknown"), (["app/pyproject.toml"], "Python", "pip", "Unknown"),
    (["package.json", "pnpm-lock.yaml"], "JavaScript", "pnpm", "Unknown"), (["web/package.json", "web/bun.lockb"], "JavaScript", "Bun", "Unknown"),
    (["package.json", "bun.lock", "tsconfig.json"], "TypeScript", "Bun", "Unknown"), (["Cargo.toml"], "Rust", "cargo", "Unknown"),
    (["go.mod"], "Go", "go modules", "Unknown"), (["build.gradle"], "Java", "Unknown", "Gradle"),
    (["pom.xml", "core/build.gradle"], "Java", "Unknown", "Maven"), (["CMakeLists.txt", "Makefile"], "Unknown", "Unknown", "CMake"),
    (["Makefile", "a.csproj"], "Unknown", "Unknown", "Make"), (["a.csproj"], "Unknown", "Unknown", ".NET"),
    (["package.json", "package-lock.json", "yarn.lock"], "JavaScript", "npm", "Unknown"),
    (["requirements.txt", "go.mod", "Cargo.toml"], "Python", "cargo", "Unknown"),
]
#: dependency of a package.json, by number, and the framework it shows
PACKAGES = [("next", "Next.js"), ("@angular/core", "Angular"), ("vue", "Vue"), ("@nestjs/core", "NestJS"), ("left-pad", "Unknown")]

_CONFIG_SQL = ("WITH d AS (SELECT 'c' || doc_id AS project_id, doc_id AS n FROM documents)\n" + "\nUNION ALL ".join(
    f"SELECT project_id, '{language}' AS language, " + (
        "CASE n % 5 " + " ".join(f"WHEN {j} THEN '{fw}'" for j, (_, fw) in enumerate(PACKAGES)) + " END"
        if any(x.endswith("package.json") for x in files) else "'Unknown'") +
    f" AS framework, '{manager}' AS package_manager, '{build}' AS build_tool, n % 4 = 1 AS has_readme, n % 3 = 0 AS has_docker "
    f"FROM d WHERE n % {len(CONFIGS)} = {k}" for k, (files, language, manager, build) in enumerate(CONFIGS)))


def e8_forms_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lock file, build file and language rule, one project per document."""
    from ..operators.project import project_info
    docs = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id")).alias("project_id"),
                                                         F.col("doc_id").alias("n"))
    names = F.element_at(F.array(*(F.array(*map(F.lit, files)) for files, *_ in CONFIGS)), (F.col("n") % len(CONFIGS) + 1).cast("int"))
    extra = F.concat(F.when(F.col("n") % 4 == 1, F.array(F.lit("readme.md"))).otherwise(F.array().cast("array<string>")),
                     F.when(F.col("n") % 3 == 0, F.array(F.lit("docker-compose.yml"))).otherwise(F.array().cast("array<string>")))
    package = F.element_at(F.array(*(F.lit('{"devDependencies":{"%s":"1"}}' % p) for p, _ in PACKAGES)), (F.col("n") % 5 + 1).cast("int"))
    tree = docs.select("project_id", "n", F.explode(F.concat(names, extra)).alias("rel_path"), package.alias("package"))
    tree = tree.select("project_id", "rel_path", F.col("rel_path").alias("file_path"), F.when(
        F.col("rel_path").endswith("package.json"), F.col("package")).otherwise("x").alias("content"))
    return project_info(files_from_paths(tree)).select(
        "project_id", "language", "framework", "package_manager", "build_tool", "has_readme", "has_docker")


QUERIES["e8_forms_config"] = (lambda spark, sf_dir: as_bigint(e8_forms_config(spark, sf_dir)), _CONFIG_SQL)


# --------------------------------------------------- classification by a model
_DEFAULT = "Classified by question rules."
#: what a model says, and type, target, reasoning and error that are read from it
SAID = [
    ('{"question_type":"FUNCTION","target_name":"`load_user()`","reasoning":"r0"}', "FUNCTION", "load_user", "r0", None),
    ('```json\n{"question_type": "file", "target_name": "./src\\\\app.py", "reasoning": "r1"}\n```', "FILE", "src/app.py", "r1", None),
    ('Sure: {"question_type":"ARCHITECTURE","target_name":null,"reasoning":"r2"} as asked', "ARCHITECTURE", None, "r2", None),
    ("no json here", None, None, _DEFAULT, "Model answer holds no JSON object."),
    ('{"question_type":"OTHER","target_name":"x"}', None, "x", _DEFAULT, "Unknown question type: OTHER"),
    ('{"question_type":" semantic_search ","target_name":"none"}', "SEMANTIC_SEARCH", None, _DEFAULT, None),
    ('{"question_type":"FUNCTION","target_name":"def pkg.mod.run_all( )"}', "FUNCTION", "run_all", _DEFAULT, None),
    ('{"question_type":"PROJECT_OVERVIEW","target_name":"","reasoning":"r7"}', "PROJECT_OVERVIEW", None, "r7", None),
    ('```\n{"question_type":"FILE","target_name":"\'/lib/x.js\'"}\n```', "FILE", "lib/x.js", _DEFAULT, None),
    ('{"question_type":"FUNCTION","target_name":"N/A"}', "FUNCTION", None, _DEFAULT, None),
    ('{broken {"question_type"', None, None, _DEFAULT, "Model answer holds no JSON object."),
    (None, None, None, None, "Question must not be empty."),
]


def said_by_model(prompts: list[str]) -> list[str]:
    """Stands for a model: the answer whose number begins the question."""
    return [SAID[int(re.match(r"Classify: #(\d+) ", p)[1])][0] for p in prompts]


def _sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _said_sql() -> str:
    k = f"(conv_id + turn) % {len(SAID)}"
    cells = ", ".join(f"CASE {k} " + " ".join(f"WHEN {i} THEN {_sql_text(row[c])}" for i, row in enumerate(SAID)) + f" END AS {name}"
                      for c, name in ((1, "question_type"), (2, "target_name"), (3, "reasoning"), (4, "error")))
    return f"SELECT conv_id * 100 + turn AS question_id, {cells} FROM conversations WHERE role = 'user'"


def i14_model_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 through a model with I14 (JSON in fences or prose), I15 (types) and I16 (targets),
    over the whole text of every user turn."""
    from ..operators.ask import classify_with_model
    k = F.expr(f"(conv_id + turn) % {len(SAID)}")
    turns = read_table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.expr("conv_id * 100 + turn").alias("question_id"),
        F.when(k == len(SAID) - 1, F.lit(" \n ")).otherwise(
            F.concat(F.lit("#"), k.cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))).alias("question"))
    return classify_with_model(turns, said_by_model, lambda q: F.concat(F.lit("Classify: "), q)).select(
        "question_id", "question_type", "target_name", "reasoning", "error")


QUERIES["i14_model_classification"] = (lambda spark, sf_dir: as_bigint(i14_model_classification(spark, sf_dir)), _said_sql())
