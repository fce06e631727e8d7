"""Code-corpus fixtures derived from the driver's tables.

Every table here is a pure Spark projection of ``documents``,
``conversations`` or ``embeddings``: the work grows with the input and no
row is produced from literals alone.  The formulas are the ones written down
in FIXTURES.md §3; the DuckDB oracle states the *expected entities* from the
same formulas, never by parsing.  The whole text of the document closes its
file, as a block comment, a docstring, or line comments (some with a stray quote).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ..operators.files import files_from_paths

# doc_id -> path/shape parameters of the generated source file
_FX_PATHS_SELECT = [
    "doc_id AS d",
    "source AS project_id",
    "doc_id DIV 20 AS k",
    "CAST(((doc_id DIV 20) + 1) % 4 AS INT) AS n",
    """CASE WHEN (doc_id DIV 20) % 7 <= 2 THEN 'py' WHEN (doc_id DIV 20) % 7 <= 4 THEN 'js'
            WHEN (doc_id DIV 20) % 7 = 5 THEN 'java' ELSE 'ts' END AS ext""",
    "(doc_id DIV 20) % 10 AS r",
    "(doc_id DIV 20) % 3 = 0 AS has_class",
    "(doc_id DIV 20) % 6 <> 0 AS has_imports",
    "coalesce(text, '') AS body",
]

_REL_PATH = """CASE WHEN r = 9 THEN concat('node_modules/m', d % 3, '/doc_', d, '.', ext)
     WHEN r = 5 AND ext = 'py' THEN concat('src/pkg', d, '/__init__.py')
     WHEN r = 5 AND ext IN ('js', 'ts') THEN concat('src/pkg', d, '/index.', ext)
     ELSE concat('src/m', d % 3, '/doc_', d, '.', ext) END"""

_CONTENT = """array_join(concat(
  CASE WHEN NOT has_imports THEN array('', '', '', '')
       WHEN ext = 'py' THEN array('import os', concat('from .doc_', d + 60, ' import x'),
                                  concat('from src.m', (d + 20) % 3, '.doc_', d + 20, ' import y'), '')
       WHEN ext = 'java' THEN array('import java.util.List;', concat('import src.m', (d + 20) % 3, '.doc_', d + 20, ';'),
                                    concat('import m', d % 3, '.doc_', d + 60, '.x;'), '')
       ELSE array('import os from "os";', concat('import { x } from "./doc_', d + 60, '";'),
                  concat('import { y } from "../m', (d + 20) % 3, '/doc_', d + 20, '.js";'), '') END,
  flatten(transform(IF(n > 0, sequence(1, n), CAST(array() AS array<int>)), i -> CASE
       WHEN ext = 'py' THEN array(concat('def f_', (k + i) % 7, '_', i, '(a, b=1):'),
            concat('    v = f_', (3 * k + i) % 9, '_', i, '(a)'), '    return print(v)', '')
       WHEN ext = 'java' THEN array(concat('int f_', (k + i) % 7, '_', i, '(int a, int b) {'),
            concat('  int v = f_', (3 * k + i) % 9, '_', i, '(a);'), '  return print(v);', '}')
       ELSE array(concat('function f_', (k + i) % 7, '_', i, '(a, b) {'),
            concat('  const v = f_', (3 * k + i) % 9, '_', i, '(a);'), '  return print(v);', '}') END)),
  CASE WHEN NOT has_class THEN CAST(array() AS array<string>)
       WHEN ext = 'py' THEN array(concat('class C_', k % 4, ':'), '    def run(self):',
                                  concat('        return self.f_', k % 7, '_1(0)'), '')
       WHEN ext = 'java' THEN array(concat('class C_', k % 4, ' {'), '  int run() {',
                                    concat('    return this.f_', k % 7, '_1(0);'), '  }', '}')
       ELSE array(concat('class C_', k % 4, ' {'), '  run() {',
                  concat('    return this.f_', k % 7, '_1(0);'), '  }', '}') END,
  array(concat('f_', (k + 1) % 7, '_1(0)')),
  CASE WHEN d % 3 = 1 THEN concat(array(IF(ext = 'py', '\"\"\"', '/*')), split(body, '\n'),
                                  array(IF(ext = 'py', '\"\"\"', '*/')))
       ELSE transform(split(body, '\n'), x -> concat(IF(ext = 'py', '# ', '// '), IF(d % 3 = 2, '\"', ''), x)) END),
  '\n')"""


def fx_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.selectExpr(*_FX_PATHS_SELECT).withColumn("rel_path", F.expr(_REL_PATH))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, rel_path, ext, d, k, n, has_class, content) per document."""
    return fx_paths(spark, sf_dir).select(
        "project_id", "rel_path", "ext", "d", "k", "n", "has_class",
        F.expr(_CONTENT).alias("content"))


def fx_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project config files (README, requirements, package.json, ...)."""
    docs = read_table(spark, sf_dir, "documents").select("source")
    projects = docs.distinct().selectExpr(
        "source AS project_id", "CAST(substr(source, 4) AS INT) AS p")
    entries = F.expr("""array(
      named_struct('ok', p % 2 = 0, 'rel_path', 'README.md', 'content', 'x'),
      named_struct('ok', p % 3 = 0, 'rel_path', '.gitignore', 'content', 'x'),
      named_struct('ok', p % 5 = 0, 'rel_path', 'Dockerfile', 'content', 'x'),
      named_struct('ok', p % 4 = 0, 'rel_path', 'requirements.txt',
                   'content', CASE p % 3 WHEN 0 THEN 'FastAPI==1' WHEN 1 THEN 'Django' ELSE 'flask' END),
      named_struct('ok', p % 4 = 1, 'rel_path', 'backend/requirements.txt', 'content', concat('numpy', '\\n', 'Flask')),
      named_struct('ok', p % 3 = 1, 'rel_path', 'web/package.json',
                   'content', CASE WHEN p % 2 = 0 THEN '{"dependencies":{"react":"1"}}'
                                   ELSE '{"devDependencies":{"express":"4","typescript":"5"}}' END),
      named_struct('ok', p % 3 = 1 AND p % 4 <> 2, 'rel_path', 'web/yarn.lock', 'content', 'x'),
      named_struct('ok', p % 7 = 0, 'rel_path', 'tsconfig.json', 'content', '{}'),
      named_struct('ok', p % 6 = 5, 'rel_path', 'pom.xml', 'content', 'x'),
      named_struct('ok', p = 3, 'rel_path', 'go.mod', 'content', 'x'),
      named_struct('ok', p = 2, 'rel_path', 'a/b/c/package.json', 'content', '{"dependencies":{"vue":"1"}}'))""")
    return (projects.select("project_id", F.explode(entries).alias("e"))
            .where("e.ok").select("project_id", "e.rel_path", "e.content"))


def fx_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return conv.selectExpr(
        "conv_id * 100 + turn AS question_id",
        "concat('src', conv_id % 20) AS project_id",
        "CAST(1 + (conv_id % 25) AS INT) AS top_k",
        """CASE (conv_id + turn) % 6 WHEN 0 THEN 'What does this project do?'
             WHEN 1 THEN 'Explain the architecture of this project.'
             WHEN 2 THEN concat('What does f_', conv_id % 7, '_1() do?')
             WHEN 3 THEN concat('Explain src/m', conv_id % 3, '/doc_', conv_id, '.py')
             WHEN 4 THEN concat('How are values printed and returned? ', coalesce(text, '')) ELSE '   ' END AS question""")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated corpus as a ``files`` table (all discovered paths,
    before the ignore/extension/language filters of B1-B4)."""
    cf = code_files(spark, sf_dir).select("project_id", "rel_path", "content")
    return files_from_paths(cf.withColumn("file_path", F.col("rel_path")))
