"""Registry of the queries checked against the DuckDB oracle.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Names carry the SURVEY §2 operator id as prefix.  Every query reads the
driver's tables (through the fixture projections) over the whole input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .corpus import as_bigint, corpus
from .oracle import bucket_vec, with_fixture

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (lambda spark, sf_dir: as_bigint(fn(spark, sf_dir)), sql)
        return fn
    return deco


# ------------------------------------------------------------------ C
@register("c1_functions", with_fixture("""
SELECT project_id, rel_path AS file_path, CAST(ord AS BIGINT) AS ord, name, language,
       array_to_string(parameters, ' | ') AS parameters, CAST(line AS BIGINT) AS line,
       CAST(end_line AS BIGINT) AS end_line
FROM fx_funcs"""))
def c1_functions(spark, sf_dir):
    f = corpus(spark, sf_dir).functions
    return f.select("project_id", "file_path", "ord", "name", "language",
                    F.array_join("parameters", " | ").alias("parameters"), "line", "end_line")


@register("c2_classes", with_fixture("""
SELECT project_id, rel_path AS file_path, CAST(ord AS BIGINT) AS ord, name, language,
       CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line,
       array_to_string(methods, ',') AS methods
FROM fx_classes"""))
def c2_classes(spark, sf_dir):
    c = corpus(spark, sf_dir).classes
    return c.select("project_id", "file_path", "ord", "name", "language", "line", "end_line",
                    F.array_join("methods", ",").alias("methods"))


@register("c4_imports", with_fixture("""
SELECT project_id, rel_path AS file_path, CAST(ord AS BIGINT) AS ord, language, module,
       CAST(line AS BIGINT) AS line
FROM fx_imports"""))
def c4_imports(spark, sf_dir):
    return corpus(spark, sf_dir).imports


@register("c5_calls", with_fixture("""
SELECT project_id, rel_path AS file_path, CAST(ord AS BIGINT) AS ord, language, caller, callee,
       CAST(line AS BIGINT) AS line
FROM fx_calls"""))
def c5_calls(spark, sf_dir):
    return corpus(spark, sf_dir).calls


# ------------------------------------------------------------------ D, E
@register("d2_resolve_calls", with_fixture("""
SELECT project_id, rel_path AS file_path, CAST(ord AS BIGINT) AS ord,
       caller_name, caller_file, CAST(caller_line AS BIGINT) AS caller_line,
       callee_name, callee_file, CAST(callee_line AS BIGINT) AS callee_line,
       CAST(call_line AS BIGINT) AS call_line
FROM fx_resolved"""))
def d2_resolve_calls(spark, sf_dir):
    r = corpus(spark, sf_dir).resolved_calls
    return r.select("project_id", "file_path", "ord",
                    F.col("caller_info.name").alias("caller_name"),
                    F.col("caller_info.file").alias("caller_file"),
                    F.col("caller_info.line").alias("caller_line"),
                    F.col("callee_info.name").alias("callee_name"),
                    F.col("callee_info.file").alias("callee_file"),
                    F.col("callee_info.line").alias("callee_line"), "call_line")


@register("e15_call_edges", with_fixture("""
SELECT project_id, caller_file || '::' || caller_name AS source,
       callee_file || '::' || callee_name AS target, 'calls' AS type, CAST(call_line AS BIGINT) AS line
FROM fx_resolved"""))
def e15_call_edges(spark, sf_dir):
    return corpus(spark, sf_dir).call_edges


@register("e1_function_index", with_fixture("""
SELECT project_id, name, count(*) AS n_definitions,
       arg_min(rel_path, (rel_path, ord)) AS first_file, arg_min(line, (rel_path, ord)) AS first_line,
       arg_max(rel_path, (rel_path, ord)) AS last_file, arg_max(line, (rel_path, ord)) AS last_line
FROM fx_funcs GROUP BY project_id, name"""))
def e1_function_index(spark, sf_dir):
    from ..operators.resolve import function_index
    idx = function_index(corpus(spark, sf_dir).functions)
    return idx.select("project_id", "name", "n_definitions",
                      F.col("first.file_path").alias("first_file"), F.col("first.line").alias("first_line"),
                      F.col("last.file_path").alias("last_file"), F.col("last.line").alias("last_line"))


@register("e1_function_entries", with_fixture("""
SELECT project_id, name, rel_path AS file_path, CAST(ord AS BIGINT) AS ord, CAST(line AS BIGINT) AS line,
       CAST(end_line AS BIGINT) AS end_line, language FROM fx_funcs"""))
def e1_function_entries(spark, sf_dir):
    from ..operators.resolve import function_entries
    return function_entries(corpus(spark, sf_dir).functions)


@register("e14_call_nodes", with_fixture("""
SELECT project_id, id, type, label, file_path, CAST(line AS BIGINT) AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY tier, f, o, side) AS rn FROM (
    SELECT project_id, rel_path || '::' || name AS id, 'function' AS type, name AS label,
           rel_path AS file_path, max(line) AS line, 0 AS tier, '' AS f, 0 AS o, 0 AS side
    FROM fx_funcs GROUP BY project_id, rel_path, name
    UNION ALL
    SELECT project_id, caller_file || '::' || caller_name, 'function', caller_name, caller_file, caller_line,
           1, rel_path, ord, 0 FROM fx_resolved
    UNION ALL
    SELECT project_id, callee_file || '::' || callee_name,
           CASE WHEN callee_file = 'external' THEN 'external' ELSE 'function' END, callee_name,
           callee_file, callee_line, 1, rel_path, ord, 1 FROM fx_resolved))
WHERE rn = 1"""))
def e14_call_nodes(spark, sf_dir):
    return corpus(spark, sf_dir).call_nodes


@register("e3_project_roots", with_fixture("SELECT project_id, root FROM fx_roots"))
def e3_project_roots(spark, sf_dir):
    return corpus(spark, sf_dir).roots


@register("e2_module_index", with_fixture("SELECT project_id, key, target FROM fx_modindex"))
def e2_module_index(spark, sf_dir):
    from ..operators.resolve import module_key_index
    c = corpus(spark, sf_dir)
    return module_key_index(c.files.select("project_id", "file_path"), c.roots)


@register("d3_known_files", with_fixture("SELECT project_id, key, target FROM fx_known"))
def d3_known_files(spark, sf_dir):
    from ..operators.resolve import known_file_keys
    return known_file_keys(corpus(spark, sf_dir).files.select("project_id", "file_path"))


@register("d7_resolve_imports", with_fixture("""
SELECT project_id, source, target, module, CAST(line AS BIGINT) AS line FROM fx_imp_res"""))
def d7_resolve_imports(spark, sf_dir):
    return corpus(spark, sf_dir).resolved_imports.drop("ord")


@register("e17_dependency_edges", with_fixture("""
SELECT project_id, source, target, 'imports' AS type, CAST(line AS BIGINT) AS line FROM fx_imp_res"""))
def e17_dependency_edges(spark, sf_dir):
    return corpus(spark, sf_dir).dep_edges


@register("e16_dependency_nodes", with_fixture("""
SELECT s.project_id, s.rel_path AS id, 'file' AS type,
       CASE WHEN r.root = '' THEN s.rel_path ELSE substr(s.rel_path, length(r.root) + 2) END AS label,
       s.rel_path AS file_path
FROM fx_src s JOIN fx_roots r USING (project_id)"""))
def e16_dependency_nodes(spark, sf_dir):
    return corpus(spark, sf_dir).dep_nodes


# ------------------------------------------------------------ project metadata
@register("e5_language_distribution", with_fixture(
    "SELECT project_id, language, files FROM fx_langdist"))
def e5_language_distribution(spark, sf_dir):
    from ..operators.project import language_distribution
    return language_distribution(corpus(spark, sf_dir).all_files)


@register("e10_project_info", with_fixture("""
SELECT i.project_id, i.language, i.framework, i.package_manager, i.build_tool, i.has_readme, i.has_docker,
       i.has_gitignore, d.language_distribution
FROM fx_info i LEFT JOIN (
  SELECT project_id, string_agg(language || ':' || files, ',' ORDER BY language) AS language_distribution
  FROM fx_langdist GROUP BY project_id) d USING (project_id)"""))
def e10_project_info(spark, sf_dir):
    from ..operators.project import project_info
    info = project_info(corpus(spark, sf_dir).all_files)
    dist = F.array_join(F.transform(F.array_sort(F.map_entries("language_distribution")),
                                    lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return info.withColumn("language_distribution", dist)


@register("e11_config_files", with_fixture("""
SELECT project_id, fname AS name, rel_path FROM fx_cfg
WHERE fname IN ('requirements.txt', 'package.json', 'tsconfig.json', 'pom.xml', 'go.mod')"""))
def e11_config_files(spark, sf_dir):
    from ..operators.project import config_files
    tree = corpus(spark, sf_dir).all_files
    out = None
    for name in ["requirements.txt", "package.json", "tsconfig.json", "pom.xml", "go.mod"]:
        part = config_files(tree, name).select("project_id", F.lit(name).alias("name"), "rel_path")
        out = part if out is None else out.unionByName(part)
    return out


@register("e12_project_totals", with_fixture("""
SELECT t.project_id, t.total_source_files, coalesce(f.n, 0) AS total_functions, coalesce(c.n, 0) AS total_classes
FROM (SELECT project_id, count(*) AS total_source_files FROM fx_paths WHERE r <> 9 GROUP BY ALL) t
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_funcs GROUP BY ALL) f USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_classes GROUP BY ALL) c USING (project_id)"""))
def e12_project_totals(spark, sf_dir):
    from ..operators.project import project_totals
    c = corpus(spark, sf_dir)
    return project_totals(c.discovered, c.functions, c.classes)


@register("e13_modules", with_fixture("""
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY name, first_file) AS pos,
       name, path, file_count, first_file FROM (
  SELECT project_id, regexp_extract(path, '[^/]+$') AS name, path, min(rel_path) AS first_file, count(*) AS file_count
  FROM (SELECT project_id, rel_path, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS path FROM fx_src)
  GROUP BY project_id, path)"""))
def e13_modules(spark, sf_dir):
    return corpus(spark, sf_dir).modules


@register("e13_module_files", with_fixture("""
SELECT project_id, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS path,
       regexp_extract(regexp_extract(rel_path, '^(.*)/[^/]*$', 1), '[^/]+$') AS name, rel_path AS file_path
FROM fx_src"""))
def e13_module_files(spark, sf_dir):
    return corpus(spark, sf_dir).module_files


@register("e4_files_by_language", with_fixture("""
SELECT project_id, CASE ext WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'java' THEN 'Java'
                            ELSE 'TypeScript' END AS language,
       count(*) AS file_count, min(rel_path) AS first_file, max(rel_path) AS last_file
FROM fx_paths WHERE r <> 9 GROUP BY ALL"""))
def e4_files_by_language(spark, sf_dir):
    from ..operators.files import files_by_language
    return files_by_language(corpus(spark, sf_dir).discovered)


@register("e4_language_files", with_fixture("""
SELECT project_id, CASE ext WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'java' THEN 'Java'
                            ELSE 'TypeScript' END AS language, rel_path AS file_path
FROM fx_paths WHERE r <> 9"""))
def e4_language_files(spark, sf_dir):
    from ..operators.files import files_of_languages
    return files_of_languages(corpus(spark, sf_dir).discovered)


# ------------------------------------------------------------------ chunks
@register("h1_code_chunks", with_fixture("""
SELECT project_id, chunk_id, chunk_type, name, file_path, language, CAST(line AS BIGINT) AS line,
       CAST(end_line AS BIGINT) AS end_line, code, content FROM fx_chunks"""))
def h1_code_chunks(spark, sf_dir):
    return corpus(spark, sf_dir).chunks.drop("pos")


@register("i9_enriched_documents", with_fixture("""
SELECT project_id, chunk_id, 'Type: ' || upper(chunk_type[1]) || chunk_type[2:] || chr(10) || 'Name: ' || name
       || chr(10) || 'File: ' || file_path || chr(10) || 'Language: ' || language || chr(10) || chr(10)
       || 'Code:' || chr(10) || code AS content
FROM fx_chunks"""))
def i9_enriched_documents(spark, sf_dir):
    from ..operators.chunks import enrich_chunks
    return enrich_chunks(corpus(spark, sf_dir).chunks).select("project_id", "chunk_id", "content")


@register("d8_top_level_lines", with_fixture("""
SELECT project_id, rel_path AS file_path, CAST(count(*) AS BIGINT) AS top_level_lines,
       CAST(count(*) FILTER (WHERE trim(text) <> '') AS BIGINT) AS non_blank,
       string_agg(line::VARCHAR, ',' ORDER BY line) AS line_numbers, md5(string_agg(text, chr(10) ORDER BY line)) AS text_md5
FROM fx_lines l
WHERE NOT EXISTS (SELECT 1 FROM fx_ranges r WHERE r.project_id = l.project_id AND r.rel_path = l.rel_path
                  AND l.line BETWEEN r.line AND r.end_line)
GROUP BY project_id, rel_path"""))
def d8_top_level_lines(spark, sf_dir):
    from ..operators.chunks import top_level_lines
    c = corpus(spark, sf_dir)
    t = top_level_lines(c.files, c.functions, c.classes)
    return (t.groupBy("project_id", "file_path")
            .agg(F.count(F.lit(1)).alias("top_level_lines"),
                 F.count_if(F.col("text").rlike(r"\S")).alias("non_blank"),
                 F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t"))
            .select("project_id", "file_path", "top_level_lines", "non_blank",
                    F.array_join(F.transform("t", lambda x: x["line"].cast("string")), ",").alias("line_numbers"),
                    F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n").cast("binary")).alias("text_md5")))


# ------------------------------------------------------------------ vectors
def _question_vectors(spark, sf_dir, dim):
    from ..operators.vectors import embed, prepare_questions
    from ..sources.fixtures import fx_questions
    q = prepare_questions(fx_questions(spark, sf_dir))
    return materialize(embed(q.select("question_id", "project_id", "top_k", "query"), "query", dim=dim,
                             out_col="qvec"), "question_vectors")


def _embedding_store_rows(spark, sf_dir):
    from ..session import read_table
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("project_id"),
                    F.concat(F.lit("c_"), F.col("vec_id").cast("string")).alias("id"), "embedding")


@register("k3_dimension_check", """
SELECT 'c_' || vec_id AS id, CAST(len(embedding) AS BIGINT) AS actual_dim, CAST(64 AS BIGINT) AS expected_dim
FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:63] ELSE embedding END AS embedding FROM embeddings)
WHERE coalesce(len(embedding), -1) <> 64""")
def k3_dimension_check(spark, sf_dir):
    from ..operators.vectors import dimension_violations
    rows = _embedding_store_rows(spark, sf_dir).withColumn("embedding", F.when(
        F.substring("id", 3, 20).cast("long") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return dimension_violations(rows, 64)


@register("k7_search_embeddings", with_fixture("""
SELECT question_id, CAST(rank AS BIGINT) AS rank, id, score FROM (
  SELECT question_id, id, score, top_k,
         row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.question_id, q.top_k, e.id,
           round(greatest(0, sum(v.w * e.embedding[v.b + 1])), 4) AS score
    FROM fx_q q JOIN fx_ev e ON e.project_id = q.project_id
    JOIN fx_qv64 v ON v.question_id = q.question_id
    GROUP BY q.question_id, q.top_k, e.id))
WHERE rank <= top_k""", extra=[bucket_vec(64, "fx_qv64")]))
def k7_search_embeddings(spark, sf_dir):
    from ..operators.vectors import search
    q = _question_vectors(spark, sf_dir, 64)
    return search(q, _embedding_store_rows(spark, sf_dir), unit_vectors=False)


FX_CHUNK_VEC = """fx_ctok AS (
  SELECT project_id, chunk_id, ('0x' || substr(md5(t), 1, 8))::UBIGINT % 768 AS b
  FROM (SELECT project_id, chunk_id, 'Type: ' || upper(chunk_type[1]) || chunk_type[2:] || chr(10) || 'Name: ' || name
          || chr(10) || 'File: ' || file_path || chr(10) || 'Language: ' || language || chr(10) || chr(10)
          || 'Code:' || chr(10) || code AS content FROM fx_chunks),
       unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS u(t)),
fx_cv AS (
  SELECT project_id, chunk_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY project_id, chunk_id)) AS w FROM (
    SELECT project_id, chunk_id, b, count(*)::DOUBLE AS c FROM fx_ctok GROUP BY ALL))"""


@register("k1_embed_chunks", with_fixture("""
SELECT project_id, chunk_id, CAST(768 AS BIGINT) AS dim, round(sqrt(sum(w * w)), 6) AS norm,
       round(sum((b + 1) * w), 3) AS weighted
FROM fx_cv GROUP BY project_id, chunk_id""", extra=[FX_CHUNK_VEC]))
def k1_embed_chunks(spark, sf_dir):
    v = corpus(spark, sf_dir).chunk_vectors
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("project_id", F.col("chunk_id"), F.size("embedding").alias("dim"),
                    F.round(norm, 6).alias("norm"), F.round(F.aggregate(
                        F.zip_with("embedding", F.sequence(F.lit(1), F.size("embedding")), lambda x, i: x * i),
                        F.lit(0.0), lambda a, x: a + x), 3).alias("weighted"))


@register("k7_search_chunks", with_fixture("""
SELECT question_id, CAST(rank AS BIGINT) AS rank, chunk_id, file_path, chunk_type, name, score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.question_id, q.top_k, c.project_id || '::' || c.chunk_id AS chunk_id, c.file_path, c.chunk_type, c.name,
           round(greatest(0, coalesce(d.dot, 0)), 4) AS score
    FROM fx_q q JOIN fx_chunks c ON c.project_id = q.project_id
    LEFT JOIN (SELECT v.question_id, cv.project_id, cv.chunk_id, sum(v.w * cv.w) AS dot
               FROM fx_qv768 v JOIN fx_q q2 ON q2.question_id = v.question_id
               JOIN fx_cv cv ON cv.project_id = q2.project_id AND cv.b = v.b
               GROUP BY v.question_id, cv.project_id, cv.chunk_id) d
      ON d.question_id = q.question_id AND d.project_id = c.project_id AND d.chunk_id = c.chunk_id) s)
WHERE rank <= top_k""", extra=[bucket_vec(768, "fx_qv768"), FX_CHUNK_VEC]))
def k7_search_chunks(spark, sf_dir):
    from ..operators.vectors import search, search_results
    q = _question_vectors(spark, sf_dir, 768)
    hits = search(q, corpus(spark, sf_dir).chunk_records,
                  extra_cols=["file_path", "chunk_type", "name", "code", "summary", "line", "end_line"])
    return search_results(hits).select("question_id", "rank", "chunk_id", "file_path", "chunk_type", "name",
                                       "score")


FX_K7 = """fx_k7 AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.question_id, q.top_k, c.project_id || '::' || c.chunk_id AS chunk_id,
             round(greatest(0, coalesce(d.dot, 0)), 4) AS score
      FROM fx_q q JOIN fx_chunks c ON c.project_id = q.project_id
      LEFT JOIN (SELECT v.question_id, cv.project_id, cv.chunk_id, sum(v.w * cv.w) AS dot
                 FROM fx_qv768 v JOIN fx_q q2 ON q2.question_id = v.question_id
                 JOIN fx_cv cv ON cv.project_id = q2.project_id AND cv.b = v.b
                 GROUP BY v.question_id, cv.project_id, cv.chunk_id) d
        ON d.question_id = q.question_id AND d.project_id = c.project_id AND d.chunk_id = c.chunk_id) s)
  WHERE rank <= top_k)"""


def _vector_checksum(df):
    s = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select("project_id", "id", F.round(s, 4).alias("vec_sum"),
                     F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 4).alias("first"))


_STORE_SQL_SUM = "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4)"


def _fresh_store(spark, sf_dir):
    from ..sources.store import VectorStore, scratch_path
    rows = _embedding_store_rows(spark, sf_dir)
    store = VectorStore(spark, scratch_path(rows, "vector-store"))
    store.upsert(rows)
    return store, rows


@register("a5_upsert_vectors", f"""
SELECT project_id, id, CASE WHEN embedding[1] > 0 THEN -{_STORE_SQL_SUM} ELSE {_STORE_SQL_SUM} END AS vec_sum,
       round(CASE WHEN embedding[1] > 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 4) AS first
FROM fx_ev""".replace("FROM fx_ev", "FROM (SELECT 'src' || label AS project_id, 'c_' || vec_id AS id, embedding FROM embeddings)"))
def a5_upsert_vectors(spark, sf_dir):
    store, rows = _fresh_store(spark, sf_dir)
    batch = rows.where(F.try_element_at("embedding", F.lit(1)) > 0).withColumn(
        "embedding", F.transform("embedding", lambda x: -x))
    store.upsert(batch)
    return _vector_checksum(store.read())


@register("a6_delete_project", f"""
SELECT 'src' || label AS project_id, 'c_' || vec_id AS id, {_STORE_SQL_SUM} AS vec_sum,
       round(embedding[1]::DOUBLE, 4) AS first
FROM embeddings WHERE 'src' || label <> 'src3'""")
def a6_delete_project(spark, sf_dir):
    store, _ = _fresh_store(spark, sf_dir)
    store.delete_project("src3")
    return _vector_checksum(store.read())


@register("a7_reindex_project", f"""
SELECT 'src' || label AS project_id, 'c_' || vec_id AS id,
       CASE WHEN label = 1 THEN -{_STORE_SQL_SUM} ELSE {_STORE_SQL_SUM} END AS vec_sum,
       round(CASE WHEN label = 1 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 4) AS first
FROM embeddings""")
def a7_reindex_project(spark, sf_dir):
    store, rows = _fresh_store(spark, sf_dir)
    batch = rows.where(F.col("project_id") == "src1").withColumn(
        "embedding", F.transform("embedding", lambda x: -x))
    store.replace_projects(batch)
    return _vector_checksum(store.read())


@register("a8_scan_project", f"""
SELECT 'src' || label AS project_id, 'c_' || vec_id AS id, {_STORE_SQL_SUM} AS vec_sum,
       round(embedding[1]::DOUBLE, 4) AS first
FROM embeddings WHERE label = 2""")
def a8_scan_project(spark, sf_dir):
    store, _ = _fresh_store(spark, sf_dir)
    return _vector_checksum(store.scan(["src2"]))


@register("a5_store_keys", """
WITH r AS (SELECT CASE label % 5 WHEN 0 THEN '001' WHEN 1 THEN '002' WHEN 2 THEN 'a:b' WHEN 3 THEN 'x=y/z' ELSE 'gone' END
             AS project_id, 'c_' || (vec_id // 2) AS id FROM embeddings)
SELECT DISTINCT project_id, id FROM r WHERE project_id NOT IN ('a:b', 'gone')""")
def a5_store_keys(spark, sf_dir):
    """A5-A7 with ids that look like numbers, ids that directory names escape,
    repeated ids, a deleted project and one that is re-indexed to nothing."""
    from ..sources.store import VectorStore, scratch_path
    label = F.substring("project_id", 4, 9).cast("int") % 5
    rows = _embedding_store_rows(spark, sf_dir).select(
        F.when(label == 0, "001").when(label == 1, "002").when(label == 2, "a:b").when(label == 3, "x=y/z")
        .otherwise("gone").alias("project_id"),
        F.concat(F.lit("c_"), F.expr("CAST(substring(id, 3) AS BIGINT) DIV 2")).alias("id"), "embedding")
    store = VectorStore(spark, scratch_path(rows, "store-keys"))
    store.upsert(rows)
    store.upsert(rows.where("project_id = '002'"))
    store.delete_project("a:b")
    store.replace_projects(rows.where("project_id = '001'"), ["001", "gone"]).count()
    # 001 was replaced by its rows, repeated ones included
    return store.read().select("project_id", "id").distinct()


@register("k6_lsh_search", None)
def k6_lsh_search(spark, sf_dir):
    from ..operators.vectors import LshIndex
    return LshIndex(_embedding_store_rows(spark, sf_dir)).search(_question_vectors(spark, sf_dir, 64)).drop("way")


def _vector_questions(spark, sf_dir):
    """Every hundredth stored vector asks for its ten nearest."""
    rows = _embedding_store_rows(spark, sf_dir).withColumn("n", F.expr("CAST(substring(id, 3) AS BIGINT)"))
    return materialize(rows.where("n % 100 = 0").select(
        F.col("n").alias("question_id"), "project_id", F.lit(10).alias("top_k"),
        F.col("embedding").cast("array<double>").alias("qvec")), "vector_questions")


def _recall(found, exact):
    """found and exact: (question_id, id, score, rank); a found row as good as the k-th exact one counts."""
    last = exact.groupBy("question_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    hits = found.join(last, "question_id").where("score >= least").groupBy("question_id").agg(F.count(F.lit(1)).alias("hit"))
    return last.join(hits, "question_id", "left").select("question_id", F.col("n").alias("wanted"),
                                                         F.least("n", F.coalesce("hit", F.lit(0))).alias("hit"))


@register("k6_recall", with_fixture("""
SELECT 'texts' AS questions, count(*) AS n_questions, sum(least(top_k, n)) AS wanted, TRUE AS recall_reached, TRUE AS within_top_k
FROM fx_q JOIN (SELECT project_id, count(*) AS n FROM fx_ev GROUP BY project_id) USING (project_id)
UNION ALL
SELECT 'vectors', count(*), sum(least(10, n)), TRUE, TRUE FROM embeddings
JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) WHERE vec_id % 100 = 0"""))
def k6_recall(spark, sf_dir):
    """Recall of the index against exact search, at least 0.9 over all questions."""
    from ..operators.vectors import LshIndex, search
    v = _embedding_store_rows(spark, sf_dir)
    index, out = LshIndex(v), None
    for name, q in (("texts", _question_vectors(spark, sf_dir, 64)), ("vectors", _vector_questions(spark, sf_dir))):
        found = materialize(index.search(q), "recall-found")  # both are read twice
        r = _recall(found, materialize(search(q, v, unit_vectors=False), "recall-exact"))
        over = found.join(q.select("question_id", "top_k"), "question_id").where("rank > top_k").count() == 0
        row = r.agg(F.count(F.lit(1)).alias("n_questions"), F.sum("wanted").alias("wanted"),
                    (F.sum("hit") >= 0.9 * F.sum("wanted")).alias("recall_reached")).select(
            F.lit(name).alias("questions"), "n_questions", "wanted", "recall_reached", F.lit(over).alias("within_top_k"))
        out = row if out is None else out.unionAll(row)
    return out


# ------------------------------------------------------------------ roll-up
@register("f1_function_batches", with_fixture("""
SELECT project_id, rel_path AS file_path, name, CAST(line AS BIGINT) AS line, CAST(batch_no AS BIGINT) AS batch_no,
       CAST(pos AS BIGINT) AS pos, n_batches, CAST(batch_count AS BIGINT) AS batch_count,
       CAST(greatest(500, batch_count * 100) AS BIGINT) AS max_tokens
FROM fx_fb"""))
def f1_function_batches(spark, sf_dir):
    from ..operators.rollup import function_items, max_tokens, number_batches
    c = corpus(spark, sf_dir)
    nb = number_batches(function_items(c.files, c.functions))
    return nb.select("project_id", "file_path", "name", "line", "batch_no", "pos", "n_batches", "batch_count",
                     max_tokens(F.col("batch_count"), 100).alias("max_tokens"))


@register("i11_function_summaries", with_fixture("""
SELECT project_id, rel_path AS file_path, name, CAST(line AS BIGINT) AS line, summary FROM fx_fsum"""))
def i11_function_summaries(spark, sf_dir):
    s = corpus(spark, sf_dir).function_summaries
    return s.select("project_id", "file_path", "name", "line", "summary")


@register("i12_missing_positions", with_fixture("""
SELECT DISTINCT project_id, 'function' AS level, CAST(batch_no AS BIGINT) AS batch_no, CAST(2 AS BIGINT) AS pos
FROM fx_fb WHERE batch_no % 5 = 0 AND batch_count >= 2"""))
def i12_missing_positions(spark, sf_dir):
    return corpus(spark, sf_dir).function_run.errors


@register("e20_file_context", with_fixture("""
SELECT project_id, rel_path AS file_path, language, function_names, class_names, CAST(imports_count AS BIGINT) AS imports_count,
       function_context, class_context FROM fx_fctx"""))
def e20_file_context(spark, sf_dir):
    fc = corpus(spark, sf_dir).file_context
    return fc.withColumn("function_names", F.array_join("function_names", ",")).withColumn(
        "class_names", F.array_join("class_names", ","))


@register("d12_file_summaries", with_fixture("""
SELECT project_id, rel_path AS file_path, summary FROM fx_flsum"""))
def d12_file_summaries(spark, sf_dir):
    return corpus(spark, sf_dir).file_summaries.select("project_id", "file_path", "summary")


@register("e21_module_context", with_fixture("""
SELECT project_id, name, path, CAST(file_count AS BIGINT) AS file_count, file_context FROM fx_mods"""))
def e21_module_context(spark, sf_dir):
    m = corpus(spark, sf_dir).module_context
    return m.select("project_id", "name", "path", "file_count", "file_context")


@register("d13_module_summaries", with_fixture("""
SELECT project_id, name, path, CASE WHEN batch_no % 7 = 0 AND pos = 1 THEN 'revised summary of ' ELSE 'summary of ' END || name AS summary
FROM (SELECT *, (rn - 1) // 10 + 1 AS batch_no, (rn - 1) % 10 + 1 AS pos, least(10, total - ((rn - 1) // 10) * 10) AS batch_count FROM (
        SELECT m.*, row_number() OVER (PARTITION BY project_id ORDER BY name, first_file) AS rn,
               count(*) OVER (PARTITION BY project_id) AS total FROM fx_mods m))
WHERE NOT (batch_no % 5 = 0 AND batch_count >= 2)"""))
def d13_module_summaries(spark, sf_dir):
    return corpus(spark, sf_dir).module_summaries.select("project_id", "name", "path", "summary")


@register("i13_project_summary", with_fixture("""
SELECT project_id, 'summary of project ' || project_id AS summary,
       array_to_string(list_filter([language, framework], lambda x: x <> 'Unknown'), ',') AS main_technologies,
       'graphs,search' AS main_features
FROM fx_info"""))
def i13_project_summary(spark, sf_dir):
    p = corpus(spark, sf_dir).project_summary
    return p.select("project_id", "summary", F.array_join("main_technologies", ",").alias("main_technologies"),
                    F.array_join("main_features", ",").alias("main_features"))


@register("g5_truncate_documents", """
SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 90
         THEN array_to_string(string_split(text, chr(10))[1:60], chr(10)) || chr(10) || chr(10)
              || '... [CODE TRUNCATED] ...' || chr(10) || chr(10)
              || array_to_string(string_split(text, chr(10))[-30:], chr(10))
         ELSE text END AS code
FROM documents""")
def g5_truncate_documents(spark, sf_dir):
    from ..functions.text import truncate_code
    from ..session import read_table
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", truncate_code(F.col("text")).alias("code"))


@register("a4_document_lines", """
SELECT doc_id, CAST(i AS BIGINT) AS line, string_split(text, chr(10))[i] AS text
FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)""")
def a4_document_lines(spark, sf_dir):
    from ..functions.text import split_lines
    from ..session import read_table
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("p", "text")).select(
        "doc_id", (F.col("p") + 1).alias("line"), "text")


@register("a3_slice_documents", """
SELECT doc_id, CASE WHEN s >= 1 AND e >= s AND s <= len(string_split(text, chr(10)))
                    THEN array_to_string(string_split(text, chr(10))[s:e], chr(10)) END AS code
FROM (SELECT doc_id, text, CAST(doc_id % 7 AS BIGINT) AS s, CAST(doc_id % 7 + doc_id % 11 - 2 AS BIGINT) AS e
      FROM documents)""")
def a3_slice_documents(spark, sf_dir):
    from ..functions.text import slice_lines, split_lines
    from ..session import read_table
    d = read_table(spark, sf_dir, "documents")
    s = (F.col("doc_id") % 7).cast("int")
    e = (F.col("doc_id") % 7 + F.col("doc_id") % 11 - 2).cast("int")
    return d.select("doc_id", slice_lines(split_lines(F.col("text")), s, e).alias("code"))


# ---------------------------------------------------------------------- ask
@register("l1_classify", with_fixture("""
SELECT question_id, project_id, question_type, target_name, error FROM fx_cls"""))
def l1_classify(spark, sf_dir):
    return corpus(spark, sf_dir).classified.select("question_id", "project_id", "question_type", "target_name",
                                                    "error")


@register("l2_route", with_fixture("""
SELECT c.question_id, CASE c.question_type WHEN 'FUNCTION' THEN 'function' WHEN 'FILE' THEN 'file'
         WHEN 'ARCHITECTURE' THEN 'architecture' WHEN 'PROJECT_OVERVIEW' THEN 'project_overview'
         WHEN 'SEMANTIC_SEARCH' THEN 'semantic_search' ELSE 'none' END AS strategy, f.found
FROM fx_cls c JOIN fx_found f USING (question_id)"""))
def l2_route(spark, sf_dir):
    return corpus(spark, sf_dir).contexts.select("question_id", "strategy", "found")


@register("b10_function_matches", with_fixture("""
SELECT question_id, rel_path AS file_path, name, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line
FROM fx_fnmatch"""))
def b10_function_matches(spark, sf_dir):
    from ..operators.ask import function_matches
    c = corpus(spark, sf_dir)
    m = function_matches(c.classified, c.code_tables)
    return m.select("question_id", F.col("rel_path").alias("file_path"), "name", "line", "end_line")


@register("b11_file_match", with_fixture("SELECT question_id, rel_path AS file_path FROM fx_filematch"))
def b11_file_match(spark, sf_dir):
    from ..operators.ask import file_match
    c = corpus(spark, sf_dir)
    return file_match(c.classified, c.code_tables).select("question_id", F.col("rel_path").alias("file_path"))


@register("g3_key_dependencies", with_fixture("""
SELECT project_id, CAST(rn AS BIGINT) AS rn, source, target FROM fx_keydeps"""))
def g3_key_dependencies(spark, sf_dir):
    from ..operators.ask import key_dependencies
    kd = key_dependencies(corpus(spark, sf_dir).code_tables)
    return kd.select("project_id", "rn", "source", "target")


@register("l12_answer_sources", with_fixture("""
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY o1, o2) AS BIGINT) AS pos,
       file_path, name, chunk_type, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line FROM (
  SELECT question_id, rel_path AS o1, ord AS o2, rel_path AS file_path, name, 'function' AS chunk_type, line, end_line
  FROM fx_fnmatch
  UNION ALL
  SELECT question_id, rel_path, 0, rel_path, regexp_extract(rel_path, '[^/]+$'), 'file', 1, NULL FROM fx_filematch
  UNION ALL
  SELECT c.question_id, '', e.first, e.p, regexp_extract(e.p, '[^/]+$'), 'file', NULL, NULL
  FROM fx_cls c JOIN (SELECT project_id, p, min(rn * 2 + side) AS first FROM (
                        SELECT project_id, rn, 0 AS side, source AS p FROM fx_keydeps
                        UNION ALL SELECT project_id, rn, 1, target FROM fx_keydeps) GROUP BY project_id, p) e
    ON e.project_id = c.project_id
  WHERE c.question_type = 'ARCHITECTURE'
  UNION ALL
  SELECT c.question_id, '', m.pos, m.path, m.name, 'module', NULL, NULL
  FROM fx_cls c JOIN (SELECT project_id, path, name,
                             row_number() OVER (PARTITION BY project_id ORDER BY name, first_file) AS pos FROM fx_mods) m
    ON m.project_id = c.project_id
  WHERE c.question_type = 'PROJECT_OVERVIEW'
  UNION ALL
  SELECT k.question_id, '', k.rank, c.file_path, c.name, c.chunk_type, nullif(c.line, 0), nullif(c.end_line, 0)
  FROM fx_k7 k JOIN fx_chunks c ON c.project_id || '::' || c.chunk_id = k.chunk_id
  JOIN fx_cls q ON q.question_id = k.question_id WHERE q.question_type = 'SEMANTIC_SEARCH')""",
    extra=[bucket_vec(768, "fx_qv768"), FX_CHUNK_VEC, FX_K7]))
def l12_answer_sources(spark, sf_dir):
    return corpus(spark, sf_dir).answer_sources


@register("l14_answers", with_fixture("""
SELECT c.question_id, NOT (c.error IS NULL AND f.found) AS insufficient,
       CASE WHEN c.error IS NOT NULL THEN 'This cannot be answered: ' || c.error
            WHEN NOT f.found AND c.question_type = 'FUNCTION' THEN 'Not enough is indexed to answer: function ''' || c.target_name || ''' was not found.'
            WHEN NOT f.found AND c.question_type = 'FILE' THEN 'Not enough is indexed to answer: file ''' || c.target_name || ''' was not found.'
            WHEN NOT f.found THEN 'Not enough is indexed to answer: no matching code was found.'
            ELSE 'answer to: ' || trim(c.question) END AS answer
FROM fx_cls c JOIN fx_found f USING (question_id)"""))
def l14_answers(spark, sf_dir):
    return corpus(spark, sf_dir).answers.select("question_id", "insufficient", "answer")


@register("l14_answer_records", f"""
WITH rt AS ({QUERIES["l2_route"][1]}), an AS ({QUERIES["l14_answers"][1]}), src AS ({QUERIES["l12_answer_sources"][1]})
SELECT rt.question_id, rt.strategy, an.insufficient, an.answer, 'echo' AS provider,
       count(src.pos) AS n_sources, arg_min(src.file_path, src.pos) AS first_source
FROM rt JOIN an USING (question_id) LEFT JOIN src ON src.question_id = rt.question_id AND NOT an.insufficient
GROUP BY ALL""")
def l14_answer_records(spark, sf_dir):
    from ..operators.ask import answer_records
    c = corpus(spark, sf_dir)
    r = answer_records(c.contexts, c.answers, c.source_table, provider=c.model)
    return r.select("question_id", "strategy", "insufficient", "answer", "provider",
                    F.size("sources").cast("long").alias("n_sources"),
                    F.try_element_at("sources", F.lit(1))["file_path"].alias("first_source"))


@register("l4_architecture_counts", with_fixture("""
SELECT c.question_id, coalesce(d.n, 0) AS total_dependencies, coalesce(k.n, 0) AS total_function_calls
FROM fx_cls c
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_imp_res GROUP BY ALL) d USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_resolved GROUP BY ALL) k USING (project_id)
WHERE c.question_type = 'ARCHITECTURE'"""))
def l4_architecture_counts(spark, sf_dir):
    ctx = corpus(spark, sf_dir).contexts.where(F.col("strategy") == "architecture")
    dep = F.regexp_extract("context", r"Import relationships: (\d+)", 1).try_cast("bigint")
    calls = F.regexp_extract("context", r"Function calls: (\d+)", 1).try_cast("bigint")
    return ctx.select("question_id", dep.alias("total_dependencies"), calls.alias("total_function_calls"))


# ------------------------------------------------------------- more inventory
@register("c7_analysis_records", with_fixture("""
SELECT s.project_id, s.rel_path AS file_path, s.language,
       coalesce(f.n, 0) AS n_functions, coalesce(c.n, 0) AS n_classes,
       coalesce(i.n, 0) AS n_imports, coalesce(k.n, 0) AS n_calls,
       coalesce(f.t, '') AS function_list, coalesce(c.t, '') AS class_list, coalesce(i.t, '') AS import_list,
       coalesce(k.t, '') AS call_list
FROM fx_src s
LEFT JOIN (SELECT project_id, rel_path, count(*) AS n, string_agg(name || '(' || array_to_string(parameters, ';') || ')'
             || line || '-' || end_line, ',' ORDER BY ord) AS t
           FROM fx_funcs GROUP BY ALL) f USING (project_id, rel_path)
LEFT JOIN (SELECT project_id, rel_path, count(*) AS n, string_agg(name || '(' || array_to_string(methods, ';') || ')'
             || line || '-' || end_line, ',' ORDER BY ord) AS t
           FROM fx_classes GROUP BY ALL) c USING (project_id, rel_path)
LEFT JOIN (SELECT project_id, rel_path, count(*) AS n, string_agg(module || ':' || line, ',' ORDER BY ord) AS t
           FROM fx_imports GROUP BY ALL) i USING (project_id, rel_path)
LEFT JOIN (SELECT project_id, rel_path, count(*) AS n, string_agg(coalesce(caller, '') || '>' || callee || ':' || line, ','
             ORDER BY ord) AS t
           FROM fx_calls GROUP BY ALL) k USING (project_id, rel_path)"""))
def c7_analysis_records(spark, sf_dir):
    from ..operators.entities import analysis_records
    c = corpus(spark, sf_dir)
    r = analysis_records(c.files, c.entities)

    def entity(x, inner):
        return F.concat(x["name"], F.lit("("), F.array_join(x[inner], ";"), F.lit(")"), x["line"].cast("string"),
                        F.lit("-"), x["end_line"].cast("string"))
    return r.select("project_id", "file_path", "language", F.size("functions").alias("n_functions"),
                    F.size("classes").alias("n_classes"), F.size("imports").alias("n_imports"),
                    F.size("calls").alias("n_calls"),
                    F.array_join(F.transform("functions", lambda x: entity(x, "parameters")), ",").alias("function_list"),
                    F.array_join(F.transform("classes", lambda x: entity(x, "methods")), ",").alias("class_list"),
                    F.array_join(F.transform("imports", lambda x: F.concat(x["module"], F.lit(":"), x["line"].cast("string"))),
                                 ",").alias("import_list"),
                    F.array_join(F.transform("calls", lambda x: F.concat(
                        F.coalesce(x["caller"], F.lit("")), F.lit(">"), x["callee"], F.lit(":"), x["line"].cast("string"))),
                        ",").alias("call_list"))


@register("e19_graph_stats", with_fixture("""
SELECT project_id, 'function_calls' AS graph, n.n AS node_count, e.n AS edge_count
FROM (SELECT project_id, count(*) AS n FROM (
        SELECT DISTINCT project_id, id FROM (
          SELECT project_id, rel_path || '::' || name AS id FROM fx_funcs
          UNION ALL SELECT project_id, caller_file || '::' || caller_name FROM fx_resolved
          UNION ALL SELECT project_id, callee_file || '::' || callee_name FROM fx_resolved)) GROUP BY ALL) n
JOIN (SELECT project_id, count(*) AS n FROM fx_resolved GROUP BY ALL) e USING (project_id)
UNION ALL
SELECT s.project_id, 'dependencies', s.n, coalesce(d.n, 0)
FROM (SELECT project_id, count(*) AS n FROM fx_src GROUP BY ALL) s
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_imp_res GROUP BY ALL) d USING (project_id)"""))
def e19_graph_stats(spark, sf_dir):
    return corpus(spark, sf_dir).graph_stats


@register("e18_graph_nodes", with_fixture("""
SELECT project_id, 'dependencies' AS graph, rel_path AS id, 'file' AS type FROM fx_src
UNION ALL
SELECT project_id, 'function_calls', id, type FROM (
  SELECT project_id, id, type, row_number() OVER (PARTITION BY project_id, id ORDER BY tier, f, o, side) AS rn FROM (
    SELECT project_id, rel_path || '::' || name AS id, 'function' AS type, 0 AS tier, '' AS f, 0 AS o, 0 AS side FROM fx_funcs
    UNION ALL SELECT project_id, caller_file || '::' || caller_name, 'function', 1, rel_path, ord, 0 FROM fx_resolved
    UNION ALL SELECT project_id, callee_file || '::' || callee_name,
                     CASE WHEN callee_file = 'external' THEN 'external' ELSE 'function' END, 1, rel_path, ord, 1
              FROM fx_resolved)) WHERE rn = 1"""))
def e18_graph_nodes(spark, sf_dir):
    from ..operators.graphs import graphs
    c = corpus(spark, sf_dir)
    nodes, _ = graphs(c.call_nodes, c.call_edges, c.dep_nodes, c.dep_edges)
    return nodes.select("project_id", "graph", "id", "type")


@register("e18_graph_edges", f"""
SELECT project_id, 'function_calls' AS graph, source, target, type FROM ({QUERIES["e15_call_edges"][1]})
UNION ALL
SELECT project_id, 'dependencies', source, target, type FROM ({QUERIES["e17_dependency_edges"][1]})""")
def e18_graph_edges(spark, sf_dir):
    from ..operators.graphs import graphs
    c = corpus(spark, sf_dir)
    _, edges = graphs(c.call_nodes, c.call_edges, c.dep_nodes, c.dep_edges)
    return edges.select("project_id", "graph", "source", "target", "type")


@register("b12_validate_urls", """
SELECT page_id, url,
       url IS NOT NULL AND url <> '' AND regexp_matches(trim(url), '^https://github\\.com/[\\w.-]+/[\\w.-]+/?$') AS valid,
       CASE WHEN url IS NULL OR url = '' THEN 'Repository URL cannot be empty.'
            WHEN NOT regexp_matches(trim(url), '^https://github\\.com/[\\w.-]+/[\\w.-]+/?$') THEN 'Invalid GitHub repository URL.'
            ELSE '' END AS message,
       string_split(regexp_replace(url, '/+$', ''), '/')[-2] AS owner,
       replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '.git', '') AS repository
FROM pages""")
def b12_validate_urls(spark, sf_dir):
    from ..functions.text import url_owner, url_repo_name, validate_repo_url
    from ..session import read_table
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    valid, msg = validate_repo_url(F.col("url"))
    return p.select("page_id", "url", valid.alias("valid"), msg.alias("message"),
                    url_owner(F.col("url")).alias("owner"), url_repo_name(F.col("url")).alias("repository"))


@register("b3_file_inventory", with_fixture("""
SELECT project_id, rel_path, '.' || regexp_extract(rel_path, '\\.([^./]+)$', 1) AS ext,
       CASE regexp_extract(rel_path, '\\.([^./]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript'
            WHEN 'java' THEN 'Java' WHEN 'ts' THEN 'TypeScript' END AS language,
       rel_path NOT LIKE 'node_modules/%' AS discovered,
       rel_path NOT LIKE 'node_modules/%' AND regexp_extract(rel_path, '\\.([^./]+)$', 1) IN ('py', 'js', 'java') AS analyzed
FROM fx_paths"""))
def b3_file_inventory(spark, sf_dir):
    from ..functions.constants import ANALYZABLE_LANGUAGES, SUPPORTED_EXTENSIONS
    from ..operators.files import has_ignored_part
    t = corpus(spark, sf_dir).source_tree
    disc = ~has_ignored_part(F.col("rel_path")) & F.col("ext").isin(*SUPPORTED_EXTENSIONS)
    return t.select("project_id", "rel_path", "ext", "language", disc.alias("discovered"),
                    (disc & F.col("language").isin(*ANALYZABLE_LANGUAGES)).alias("analyzed"))


@register("d9_enriched_with_summaries", with_fixture("""
SELECT c.project_id, c.chunk_id,
       CASE WHEN c.chunk_type = 'function' THEN fs.summary WHEN c.chunk_type = 'file' THEN fl.summary END AS summary,
       'Type: ' || upper(c.chunk_type[1]) || c.chunk_type[2:] || chr(10) || 'Name: ' || c.name || chr(10)
       || 'File: ' || c.file_path || chr(10) || 'Language: ' || c.language
       || coalesce(chr(10) || 'Summary: ' || CASE WHEN c.chunk_type = 'function' THEN fs.summary
                                                  WHEN c.chunk_type = 'file' THEN fl.summary END, '')
       || chr(10) || chr(10) || 'Code:' || chr(10) || c.code AS content
FROM fx_chunks c
LEFT JOIN (SELECT project_id, rel_path, name, arg_max(summary, ord) AS summary FROM fx_fsum GROUP BY ALL) fs
  ON fs.project_id = c.project_id AND fs.rel_path = c.file_path AND fs.name = c.name
LEFT JOIN fx_flsum fl ON fl.project_id = c.project_id AND fl.rel_path = c.file_path"""))
def d9_enriched_with_summaries(spark, sf_dir):
    from ..operators.chunks import enrich_chunks
    c = corpus(spark, sf_dir)
    fs = c.function_summaries.select("project_id", "file_path", "ord", "name", "summary")
    fl = c.file_summaries.select("project_id", "file_path", "summary")
    e = enrich_chunks(c.chunks, fs, fl)
    return e.select("project_id", "chunk_id", "summary", "content")


_MOD_TEXT = """(SELECT project_id, string_agg('- ' || name || ' (' || path || ', ' || file_count || ' files)', chr(10)
                ORDER BY name, first_file) AS txt FROM fx_mods GROUP BY ALL)"""


@register("l8_overview_context", with_fixture(f"""
SELECT c.question_id,
       'Project overview' || chr(10) || 'Language: ' || coalesce(i.language, 'Unknown') || chr(10)
       || 'Framework: ' || coalesce(i.framework, 'Unknown') || chr(10)
       || 'Package manager: ' || coalesce(i.package_manager, 'Unknown') || chr(10)
       || 'Source files: ' || coalesce(t.n, 0) || chr(10) || 'Modules:' || chr(10) || coalesce(m.txt, '') AS context
FROM fx_cls c LEFT JOIN fx_info i USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_paths WHERE r <> 9 GROUP BY ALL) t USING (project_id)
LEFT JOIN {_MOD_TEXT} m USING (project_id)
WHERE c.question_type = 'PROJECT_OVERVIEW'"""))
def l8_overview_context(spark, sf_dir):
    ctx = corpus(spark, sf_dir).contexts
    return ctx.where(F.col("strategy") == "project_overview").select("question_id", "context")


@register("l8_architecture_context", with_fixture(f"""
SELECT c.question_id,
       'Architecture' || chr(10) || 'Modules:' || chr(10) || coalesce(m.txt, '') || chr(10)
       || 'Import relationships: ' || coalesce(d.n, 0) || chr(10)
       || 'Function calls: ' || coalesce(k.n, 0) || chr(10) || 'Key dependencies:' || chr(10)
       || coalesce(kd.txt, '') AS context
FROM fx_cls c
LEFT JOIN {_MOD_TEXT} m USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_imp_res GROUP BY ALL) d USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_resolved GROUP BY ALL) k USING (project_id)
LEFT JOIN (SELECT project_id, string_agg('- ' || source || ' -> ' || target, chr(10) ORDER BY rn) AS txt
           FROM fx_keydeps GROUP BY ALL) kd USING (project_id)
WHERE c.question_type = 'ARCHITECTURE'"""))
def l8_architecture_context(spark, sf_dir):
    ctx = corpus(spark, sf_dir).contexts
    return ctx.where(F.col("strategy") == "architecture").select("question_id", "context")


@register("l9_function_context", with_fixture("""
SELECT c.question_id,
       'Target function: ' || c.target_name || chr(10) || 'Matches: ' || coalesce(x.n, 0) || chr(10) || chr(10)
       || coalesce(x.txt, '') AS context
FROM fx_cls c LEFT JOIN (
  SELECT q.question_id, count(*) AS n,
         string_agg('Function ' || f.name || ' in ' || f.rel_path || ' (lines ' || f.line || '-' || f.end_line || ', '
                    || f.language || ')' || chr(10) || 'Parameters: ' || array_to_string(f.parameters, ', ') || chr(10)
                    || array_to_string(string_split(cd.content, chr(10))[f.line:f.end_line], chr(10)),
                    chr(10) || chr(10) ORDER BY f.rel_path, f.ord) AS txt
  FROM fx_cls q JOIN fx_funcs f ON f.project_id = q.project_id AND lower(f.name) = lower(q.target_name)
  JOIN fx_code cd ON cd.project_id = f.project_id AND cd.rel_path = f.rel_path
  WHERE q.question_type = 'FUNCTION' GROUP BY q.question_id) x USING (question_id)
WHERE c.question_type = 'FUNCTION'"""))
def l9_function_context(spark, sf_dir):
    ctx = corpus(spark, sf_dir).contexts
    return ctx.where(F.col("strategy") == "function").select("question_id", "context")


@register("l9_file_context", with_fixture("""
SELECT c.question_id,
       CASE WHEN m.rel_path IS NOT NULL THEN
         'File: ' || m.rel_path || chr(10) || 'Language: ' || s.language || chr(10)
         || 'Functions: ' || coalesce(fn.names, '') || chr(10) || 'Classes: ' || coalesce(cl.names, '') || chr(10)
         || 'Imports: ' || coalesce(im.mods, '') || chr(10) || chr(10) || cd.content END AS context
FROM fx_cls c
LEFT JOIN fx_filematch m USING (question_id)
LEFT JOIN fx_src s ON s.project_id = c.project_id AND s.rel_path = m.rel_path
LEFT JOIN fx_code cd ON cd.project_id = c.project_id AND cd.rel_path = m.rel_path
LEFT JOIN (SELECT project_id, rel_path, string_agg(name, ', ' ORDER BY ord) AS names FROM fx_funcs GROUP BY ALL) fn
  ON fn.project_id = c.project_id AND fn.rel_path = m.rel_path
LEFT JOIN (SELECT project_id, rel_path, string_agg(name, ', ' ORDER BY ord) AS names FROM fx_classes GROUP BY ALL) cl
  ON cl.project_id = c.project_id AND cl.rel_path = m.rel_path
LEFT JOIN (SELECT project_id, rel_path, string_agg(module, ', ' ORDER BY ord) AS mods FROM fx_imports GROUP BY ALL) im
  ON im.project_id = c.project_id AND im.rel_path = m.rel_path
WHERE c.question_type = 'FILE'"""))
def l9_file_context(spark, sf_dir):
    ctx = corpus(spark, sf_dir).contexts
    return ctx.where(F.col("strategy") == "file").select("question_id", "context")


@register("l10_semantic_context", with_fixture("""
SELECT c.question_id, 'Search results: ' || coalesce(x.n, 0) || chr(10) || chr(10) || coalesce(x.txt, '') AS context
FROM fx_cls c LEFT JOIN (
  SELECT k.question_id, count(*) AS n,
         string_agg('Chunk ' || k.rank || '/' || cnt.n || ': ' || ch.name || ' (' || ch.chunk_type || ', '
                    || ch.file_path || ', score ' || printf('%.4f', k.score) || ')' || chr(10) || ch.code,
                    chr(10) || chr(10) ORDER BY k.rank) AS txt
  FROM fx_k7 k JOIN fx_chunks ch ON ch.project_id || '::' || ch.chunk_id = k.chunk_id
  JOIN (SELECT question_id, count(*) AS n FROM fx_k7 GROUP BY ALL) cnt ON cnt.question_id = k.question_id
  GROUP BY k.question_id) x USING (question_id)
WHERE c.question_type = 'SEMANTIC_SEARCH'""", extra=[bucket_vec(768, "fx_qv768"), FX_CHUNK_VEC, FX_K7]))
def l10_semantic_context(spark, sf_dir):
    ctx = corpus(spark, sf_dir).contexts
    return ctx.where(F.col("strategy") == "semantic_search").select("question_id", "context")


@register("d14_embedding_mismatches", with_fixture("""
SELECT 'chunk_without_vector' AS side, project_id, chunk_id AS id FROM fx_chunks WHERE line % 3 = 0
UNION ALL
SELECT 'vector_without_chunk', project_id, chunk_id || '_old' FROM fx_chunks WHERE line % 3 <> 0 AND line % 5 = 1"""))
def d14_embedding_mismatches(spark, sf_dir):
    from ..operators.vectors import embedding_mismatches
    c = corpus(spark, sf_dir)
    # vectors of two thirds of the chunks, and some of chunks that are gone
    v = c.chunk_vectors.select("project_id", "chunk_id", "line").where("line % 3 <> 0")
    old = v.where("line % 5 = 1").withColumn("chunk_id", F.concat("chunk_id", F.lit("_old")))
    return embedding_mismatches(c.chunks, v.unionByName(old))


@register("e24_understanding_counts", with_fixture("""
SELECT p.project_id, coalesce(f.n, 0) AS functions, coalesce(fl.n, 0) AS files, coalesce(m.n, 0) AS modules,
       CAST(1 AS BIGINT) AS projects, coalesce(e.n, 0) AS incomplete_batches
FROM (SELECT DISTINCT project_id FROM fx_src) p
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_fsum GROUP BY ALL) f USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM fx_flsum GROUP BY ALL) fl USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM (
             SELECT *, (rn - 1) // 10 + 1 AS batch_no, least(10, total - ((rn - 1) // 10) * 10) AS batch_count FROM (
               SELECT m.*, row_number() OVER (PARTITION BY project_id ORDER BY name, first_file) AS rn,
                      count(*) OVER (PARTITION BY project_id) AS total FROM fx_mods m))
           WHERE NOT (batch_no % 5 = 0 AND batch_count >= 2) GROUP BY ALL) m USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM (
             SELECT DISTINCT project_id, batch_no FROM fx_fb WHERE batch_no % 5 = 0 AND batch_count >= 2
             UNION ALL
             SELECT DISTINCT project_id, batch_no FROM (
               SELECT project_id, (rn - 1) // 10 + 1 AS batch_no, least(10, total - ((rn - 1) // 10) * 10) AS batch_count
               FROM (SELECT c.*, row_number() OVER (PARTITION BY project_id ORDER BY rel_path) AS rn,
                            count(*) OVER (PARTITION BY project_id) AS total FROM fx_fctx c))
             WHERE batch_no % 5 = 0 AND batch_count >= 2)
           GROUP BY ALL) e USING (project_id)"""))
def e24_understanding_counts(spark, sf_dir):
    from ..operators.rollup import understand
    c = corpus(spark, sf_dir)
    u = understand(c.files, c.functions, c.classes, c.imports, c.modules, c.module_files, c.project_info,
                   c.graph_stats, c.model)

    def count(df, name):
        return df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    errs = u.errors.select("project_id", "level", "batch_no").distinct()
    out = (c.files.select("project_id").distinct()
           .join(count(u.functions, "functions"), "project_id", "left")
           .join(count(u.files, "files"), "project_id", "left")
           .join(count(u.modules, "modules"), "project_id", "left")
           .join(count(u.projects, "projects"), "project_id", "left")
           .join(count(errs, "incomplete_batches"), "project_id", "left"))
    return out.select("project_id", *[F.coalesce(c_, F.lit(0)).alias(c_) for c_ in
                                      ["functions", "files", "modules", "projects", "incomplete_batches"]])


def _prompt_sql() -> str:
    from ..operators.ask import TYPE_INSTRUCTIONS
    contexts = "\nUNION ALL ".join(f"SELECT question_id, context FROM ({QUERIES[name][1]})" for name in (
        "l8_overview_context", "l8_architecture_context", "l9_function_context", "l9_file_context", "l10_semantic_context"))
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_INSTRUCTIONS.items())
    asked = with_fixture("SELECT question_id, question_type, question FROM fx_cls WHERE error IS NULL")
    return f"""SELECT q.question_id, md5('Answer the question about the repository using only the context below. If the context is not '
  || 'enough, say so.' || chr(10) || 'Instruction: ' || CASE question_type {kinds} END || chr(10) || chr(10) || 'Context:' || chr(10)
  || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || trim(question)) AS prompt_md5
FROM ({asked}) q LEFT JOIN ({contexts}) c USING (question_id)"""


@register("l13_answer_prompts", _prompt_sql())
def l13_answer_prompts(spark, sf_dir):
    from ..operators.ask import answer_prompt
    ctx = corpus(spark, sf_dir).contexts.where("error IS NULL")
    return ctx.select("question_id", F.md5(answer_prompt().cast("binary")).alias("prompt_md5"))
