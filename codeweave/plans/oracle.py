"""DuckDB oracle SQL: the EXPECTED results, stated from the generator
formulas of the fixture (FIXTURES.md §3), never by parsing the generated
code.  Each query is ``WITH <fixture CTEs> <select>``.
"""

from __future__ import annotations

# fixture CTEs -----------------------------------------------------------
FX_PATHS = """fx_paths AS (
  SELECT *, CASE WHEN r = 9 THEN 'node_modules/m' || (d % 3) || '/doc_' || d || '.' || ext
                 WHEN r = 5 AND ext = 'py' THEN 'src/pkg' || d || '/__init__.py'
                 WHEN r = 5 AND ext IN ('js', 'ts') THEN 'src/pkg' || d || '/index.' || ext
                 ELSE 'src/m' || (d % 3) || '/doc_' || d || '.' || ext END AS rel_path
  FROM (SELECT doc_id AS d, source AS project_id, doc_id // 20 AS k, (doc_id // 20 + 1) % 4 AS n,
               CASE WHEN (doc_id // 20) % 7 <= 2 THEN 'py' WHEN (doc_id // 20) % 7 <= 4 THEN 'js'
                    WHEN (doc_id // 20) % 7 = 5 THEN 'java' ELSE 'ts' END AS ext,
               (doc_id // 20) % 10 AS r, (doc_id // 20) % 3 = 0 AS has_class,
               (doc_id // 20) % 6 <> 0 AS has_imports, coalesce(text, '') AS body
        FROM documents))"""

# analyzed files: not under node_modules, language with an extractor
FX_SRC = """fx_src AS (
  SELECT *, CASE ext WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' ELSE 'Java' END AS language,
         4 + 4 * n + CASE WHEN has_class THEN (CASE WHEN ext = 'py' THEN 4 ELSE 5 END) ELSE 0 END + 1 AS n_lines
  FROM fx_paths WHERE r <> 9 AND ext IN ('py', 'js', 'java'))"""

FX_DEFS = """fx_defs AS (
  SELECT p.*, i, 'f_' || ((k + i) % 7) || '_' || i AS name, 5 + 4 * (i - 1) AS line,
         5 + 4 * (i - 1) + CASE WHEN ext = 'py' THEN 2 ELSE 3 END AS end_line,
         'f_' || ((3 * k + i) % 9) || '_' || i AS callee, 6 + 4 * (i - 1) AS call_line
  FROM fx_src p, unnest(range(1, n + 1)) AS u(i))"""

FX_FUNCS = """fx_funcs AS (
  SELECT project_id, rel_path, language, i AS ord, name, line, end_line,
         CASE ext WHEN 'py' THEN ['a', 'b=1'] WHEN 'java' THEN ['int a', 'int b'] ELSE ['a', 'b'] END AS parameters
  FROM fx_defs
  UNION ALL
  SELECT project_id, rel_path, language, n + 1, 'run', 5 + 4 * n + 1,
         5 + 4 * n + CASE WHEN ext = 'py' THEN 2 ELSE 3 END,
         CASE WHEN ext = 'py' THEN ['self'] ELSE []::VARCHAR[] END
  FROM fx_src WHERE has_class)"""

FX_CLASSES = """fx_classes AS (
  SELECT project_id, rel_path, language, 1 AS ord, 'C_' || (k % 4) AS name, 5 + 4 * n AS line,
         5 + 4 * n + CASE WHEN ext = 'py' THEN 2 ELSE 4 END AS end_line, ['run'] AS methods
  FROM fx_src WHERE has_class)"""

FX_CALLS = """fx_calls AS (
  SELECT project_id, rel_path, language, name AS caller, callee, call_line AS line, 2 * i - 1 AS ord FROM fx_defs
  UNION ALL
  SELECT project_id, rel_path, language, name, 'print', call_line + 1, 2 * i FROM fx_defs
  UNION ALL
  SELECT project_id, rel_path, language, 'run', 'f_' || (k % 7) || '_1', 5 + 4 * n + 2, 2 * n + 1
  FROM fx_src WHERE has_class
  UNION ALL
  SELECT project_id, rel_path, language, NULL, 'f_' || ((k + 1) % 7) || '_1', n_lines,
         2 * n + CASE WHEN has_class THEN 2 ELSE 1 END
  FROM fx_src)"""

FX_IMPORTS = """fx_imports AS (
  SELECT project_id, rel_path, language, d, j AS ord, j AS line,
         CASE WHEN ext = 'py' THEN [ 'os', '.doc_' || (d + 60), 'src.m' || ((d + 20) % 3) || '.doc_' || (d + 20)][j]
              WHEN ext = 'java' THEN ['java.util.List', 'src.m' || ((d + 20) % 3) || '.doc_' || (d + 20),
                                      'm' || (d % 3) || '.doc_' || (d + 60) || '.x'][j]
              ELSE ['os', './doc_' || (d + 60), '../m' || ((d + 20) % 3) || '/doc_' || (d + 20) || '.js'][j] END AS module
  FROM fx_src, unnest(range(1, 4)) AS u(j) WHERE has_imports)"""

# first definition of a name in a file / in a project (file order, pre-order)
FX_RESOLVE = """fx_in_file AS (
  SELECT project_id, rel_path, name, min(line) AS line FROM fx_funcs GROUP BY ALL),
fx_in_proj AS (
  SELECT project_id, name, rel_path, line FROM (
    SELECT project_id, name, rel_path, line,
           row_number() OVER (PARTITION BY project_id, name ORDER BY rel_path, line) AS rn
    FROM fx_funcs) WHERE rn = 1),
fx_resolved AS (
  SELECT c.project_id, c.rel_path, c.ord, c.line AS call_line,
         CASE WHEN c.caller IS NULL THEN regexp_extract(c.rel_path, '[^/]+$') ELSE c.caller END AS caller_name,
         CASE WHEN c.caller IS NULL OR cf.line IS NOT NULL THEN c.rel_path
              ELSE coalesce(cp.rel_path, c.rel_path) END AS caller_file,
         CASE WHEN c.caller IS NULL THEN NULL ELSE coalesce(cf.line, cp.line) END AS caller_line,
         c.callee AS callee_name,
         CASE WHEN ef.line IS NOT NULL THEN c.rel_path ELSE coalesce(ep.rel_path, 'external') END AS callee_file,
         coalesce(ef.line, ep.line) AS callee_line
  FROM fx_calls c
  LEFT JOIN fx_in_file cf ON cf.project_id = c.project_id AND cf.rel_path = c.rel_path AND cf.name = c.caller
  LEFT JOIN fx_in_proj cp ON cp.project_id = c.project_id AND cp.name = c.caller
  LEFT JOIN fx_in_file ef ON ef.project_id = c.project_id AND ef.rel_path = c.rel_path AND ef.name = c.callee
  LEFT JOIN fx_in_proj ep ON ep.project_id = c.project_id AND ep.name = c.callee)"""

BASE = [FX_PATHS, FX_SRC, FX_DEFS, FX_FUNCS, FX_CLASSES, FX_CALLS, FX_IMPORTS, FX_RESOLVE]


def with_fixture(select_sql: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join(BASE + (extra or [])) + "\n" + select_sql

# dependency-graph CTEs --------------------------------------------------
# Longest directory prefix shared by all analyzed files of a project
FX_ROOTS = """fx_prefixes AS (
  SELECT project_id, array_to_string(string_split(p, '/')[1:j], '/') AS prefix, j
  FROM (SELECT project_id, min(rel_path) AS p FROM fx_src GROUP BY project_id),
       unnest(range(0, len(string_split(p, '/')))) AS u(j)),
fx_roots AS (
  SELECT project_id, arg_max(prefix, j) AS root FROM (
    SELECT x.project_id, x.prefix, x.j FROM fx_prefixes x JOIN fx_src s ON s.project_id = x.project_id
    GROUP BY x.project_id, x.prefix, x.j
    HAVING bool_and(x.j = 0 OR starts_with(s.rel_path, x.prefix || '/'))) GROUP BY project_id)"""

# E2 keys: tier 0 exact (last file wins), tier 1 suffix / package (first wins)
FX_MODKEYS = """fx_rel AS (
  SELECT s.project_id, s.rel_path,
         regexp_replace(s.rel_path, '\\.[^./]+$', '') AS nosfx,
         CASE WHEN r.root = '' THEN s.rel_path ELSE substr(s.rel_path, length(r.root) + 2) END AS rel
  FROM fx_src s JOIN fx_roots r USING (project_id)),
fx_rel2 AS (
  SELECT *, regexp_replace(rel, '\\.[^./]+$', '') AS rel_nosfx,
         string_split(regexp_replace(rel, '\\.[^./]+$', ''), '/') AS parts FROM fx_rel),
fx_keys AS (
  SELECT project_id, rel_path, 0 AS tier, replace(nosfx, '/', '.') AS key FROM fx_rel2
  UNION ALL SELECT project_id, rel_path, 0, array_to_string(parts, '.') FROM fx_rel2
  UNION ALL SELECT project_id, rel_path, 0, rel_nosfx FROM fx_rel2
  UNION ALL SELECT project_id, rel_path, 0, rel FROM fx_rel2
  UNION ALL SELECT project_id, rel_path, 1, array_to_string(parts[i + 1:], '.')
            FROM fx_rel2, unnest(range(1, len(parts))) AS u(i)
  UNION ALL SELECT project_id, rel_path, 1, array_to_string(parts[i + 1:], '/')
            FROM fx_rel2, unnest(range(1, len(parts))) AS u(i)
  UNION ALL SELECT project_id, rel_path, 1, array_to_string(parts[1:len(parts) - 1], '.')
            FROM fx_rel2 WHERE parts[len(parts)] = '__init__'),
fx_modindex AS (
  SELECT project_id, key, coalesce(max(rel_path) FILTER (WHERE tier = 0),
                                   min(rel_path) FILTER (WHERE tier = 1)) AS target
  FROM fx_keys GROUP BY project_id, key),
fx_known AS (
  SELECT project_id, key, max(rel_path) AS target FROM (
    SELECT project_id, rel_path, rel_path AS key FROM fx_src
    UNION ALL SELECT project_id, rel_path, regexp_replace(rel_path, '\\.[^./]+$', '') FROM fx_src
    UNION ALL SELECT project_id, rel_path, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) FROM fx_src
              WHERE regexp_extract(rel_path, '[^/]+$') IN ('__init__.py', 'index.js', 'index.jsx', 'index.ts', 'index.tsx'))
  GROUP BY project_id, key)"""

# D4-D7 over the generated import forms: '.x' (one dot), './x', '../d/x.js', dotted
FX_IMPRES = """fx_imp_c AS (
  SELECT i.*, regexp_extract(i.rel_path, '^(.*)/[^/]*$', 1) AS src_dir FROM fx_imports i),
fx_js AS (
  SELECT project_id, rel_path, ord,
         CASE WHEN module LIKE './%' THEN src_dir || '/' || substr(module, 3)
              ELSE regexp_extract(src_dir, '^(.*)/[^/]*$', 1) || '/' || substr(module, 4) END AS jsp
  FROM fx_imp_c WHERE module LIKE './%' OR module LIKE '../%'),
fx_cands AS (
  SELECT project_id, rel_path, ord, 1 AS rank, 'k' AS tbl, src_dir || '/' || replace(substr(module, 2), '.', '/') AS key
    FROM fx_imp_c WHERE module LIKE '.%' AND module NOT LIKE '%/%' AND module NOT LIKE '..%'
  UNION ALL SELECT project_id, rel_path, ord, 2, 'k', src_dir || '/' || replace(substr(module, 2), '.', '/') || '.py'
    FROM fx_imp_c WHERE module LIKE '.%' AND module NOT LIKE '%/%' AND module NOT LIKE '..%'
  UNION ALL SELECT project_id, rel_path, ord, 3, 'k', src_dir || '/' || replace(substr(module, 2), '.', '/') || '/__init__.py'
    FROM fx_imp_c WHERE module LIKE '.%' AND module NOT LIKE '%/%' AND module NOT LIKE '..%'
  UNION ALL SELECT project_id, rel_path, ord, 4, 'i', substr(module, 2)
    FROM fx_imp_c WHERE module LIKE '.%' AND module NOT LIKE '%/%' AND module NOT LIKE '..%'
  UNION ALL SELECT project_id, rel_path, ord, 1, 'k', jsp FROM fx_js
  UNION ALL SELECT project_id, rel_path, ord, 2, 'k', regexp_replace(jsp, '([^/.])\\.[^./]+$', '\\1') FROM fx_js
  UNION ALL SELECT project_id, rel_path, ord, 3, 'k', jsp || '/index' FROM fx_js
  UNION ALL SELECT project_id, rel_path, ord, 5, 'i', module FROM fx_imp_c
  UNION ALL SELECT project_id, rel_path, ord, 6, 'i', regexp_replace(module, '\\.[^.]*$', '')
    FROM fx_imp_c WHERE module LIKE '%.%'),
fx_keyed AS (
  SELECT project_id, 'k' AS tbl, key, target FROM fx_known
  UNION ALL SELECT project_id, 'i', key, target FROM fx_modindex),
fx_imp_res AS (
  SELECT i.project_id, i.rel_path AS source, b.target, i.module, i.line, i.ord FROM fx_imports i
  JOIN (SELECT c.project_id, c.rel_path, c.ord, arg_min(k.target, c.rank) AS target
        FROM fx_cands c JOIN fx_keyed k ON k.project_id = c.project_id AND k.tbl = c.tbl AND k.key = c.key
        GROUP BY c.project_id, c.rel_path, c.ord) b
    ON b.project_id = i.project_id AND b.rel_path = i.rel_path AND b.ord = i.ord
  WHERE b.target <> i.rel_path)"""

BASE.extend([FX_ROOTS, FX_MODKEYS, FX_IMPRES])

# project tree: generated sources + config files ----------------------------
FX_TREE = """fx_tree AS (
  SELECT project_id, rel_path, NULL AS content,
         CASE ext WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'java' THEN 'Java'
                  WHEN 'ts' THEN 'TypeScript' END AS language
  FROM fx_paths
  UNION ALL
  SELECT project_id, rel_path, content, NULL FROM (
    SELECT project_id, p, unnest([
      struct_pack(ok := p % 2 = 0, rel_path := 'README.md', content := 'x'),
      struct_pack(ok := p % 3 = 0, rel_path := '.gitignore', content := 'x'),
      struct_pack(ok := p % 5 = 0, rel_path := 'Dockerfile', content := 'x'),
      struct_pack(ok := p % 4 = 0, rel_path := 'requirements.txt', content := CASE p % 3 WHEN 0 THEN 'FastAPI==1' WHEN 1 THEN 'Django' ELSE 'flask' END),
      struct_pack(ok := p % 4 = 1, rel_path := 'backend/requirements.txt', content := 'numpy' || chr(10) || 'Flask'),
      struct_pack(ok := p % 3 = 1, rel_path := 'web/package.json', content := CASE WHEN p % 2 = 0 THEN '{"dependencies":{"react":"1"}}' ELSE '{"devDependencies":{"express":"4","typescript":"5"}}' END),
      struct_pack(ok := p % 3 = 1 AND p % 4 <> 2, rel_path := 'web/yarn.lock', content := 'x'),
      struct_pack(ok := p % 7 = 0, rel_path := 'tsconfig.json', content := '{}'),
      struct_pack(ok := p % 6 = 5, rel_path := 'pom.xml', content := 'x'),
      struct_pack(ok := p = 3, rel_path := 'go.mod', content := 'x'),
      struct_pack(ok := p = 2, rel_path := 'a/b/c/package.json', content := '{"dependencies":{"vue":"1"}}')], recursive := true)
    FROM (SELECT DISTINCT source AS project_id, CAST(substr(source, 4) AS INT) AS p FROM documents))
  WHERE ok),
fx_cfg AS (
  SELECT project_id, rel_path, content, regexp_extract(rel_path, '[^/]+$') AS fname,
         regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS dir, rel_path LIKE '%/%' AS nested
  FROM fx_tree WHERE len(string_split(rel_path, '/')) <= 3
    AND NOT regexp_matches(rel_path, '(^|/)(\\.|node_modules/|venv/|__pycache__/|dist/|build/)[^/]*/'
                                      )),
fx_langdist AS (
  SELECT project_id, language, count(*) AS files FROM fx_tree
  WHERE language IS NOT NULL AND rel_path NOT LIKE 'node_modules/%' GROUP BY ALL),
fx_fw AS (
  SELECT project_id, arg_max(fw, (kind, nested, rel_path)) AS framework FROM (
    SELECT project_id, rel_path, nested, 0 AS kind,
           CASE WHEN lower(content) LIKE '%fastapi%' THEN 'FastAPI' WHEN lower(content) LIKE '%django%' THEN 'Django'
                WHEN lower(content) LIKE '%flask%' THEN 'Flask' END AS fw
    FROM fx_cfg WHERE fname = 'requirements.txt'
    UNION ALL
    SELECT project_id, rel_path, nested, 1,
           CASE WHEN content LIKE '%"react"%' THEN 'React' WHEN content LIKE '%"next"%' THEN 'Next.js'
                WHEN content LIKE '%"express"%' THEN 'Express' WHEN content LIKE '%"vue"%' THEN 'Vue' END
    FROM fx_cfg WHERE fname = 'package.json')
  WHERE fw IS NOT NULL GROUP BY project_id),
fx_pm AS (
  SELECT project_id, arg_max(pm, (r, nested, rel_path)) AS package_manager FROM (
    SELECT project_id, rel_path, nested, 0 AS r, 'pip' AS pm FROM fx_cfg WHERE fname = 'requirements.txt'
    UNION ALL
    SELECT c.project_id, c.rel_path, c.nested, 2, 'Yarn' FROM fx_cfg c
      JOIN fx_tree t ON t.project_id = c.project_id AND t.rel_path = CASE WHEN c.dir = '' THEN 'yarn.lock' ELSE c.dir || '/yarn.lock' END
      WHERE c.fname = 'package.json'
    UNION ALL
    SELECT project_id, rel_path, nested, 3, 'go modules' FROM fx_cfg WHERE fname = 'go.mod')
  GROUP BY project_id),
fx_info AS (
  SELECT pr.project_id,
         CASE WHEN (ts.has_ts OR coalesce(d_ts.files, 0) > 0) AND coalesce(d_ts.files, 0) >= coalesce(d_js.files, 0)
              THEN 'TypeScript' ELSE dom.language END AS language,
         coalesce(fw.framework, 'Unknown') AS framework,
         coalesce(pm.package_manager, 'Unknown') AS package_manager,
         CASE WHEN bt.has_pom THEN 'Maven' ELSE 'Unknown' END AS build_tool,
         bt.has_readme, bt.has_docker, bt.has_gitignore
  FROM (SELECT DISTINCT project_id FROM fx_tree) pr
  LEFT JOIN (SELECT project_id, arg_max(language, (files, -ascii(language[1]), language)) AS language FROM (
               SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY files DESC, language) AS rn FROM fx_langdist)
             WHERE rn = 1 GROUP BY project_id) dom USING (project_id)
  LEFT JOIN (SELECT project_id, files FROM fx_langdist WHERE language = 'TypeScript') d_ts USING (project_id)
  LEFT JOIN (SELECT project_id, files FROM fx_langdist WHERE language = 'JavaScript') d_js USING (project_id)
  LEFT JOIN (SELECT project_id, bool_or(fname = 'tsconfig.json' OR (fname = 'package.json' AND content LIKE '%"typescript"%')) AS has_ts
             FROM fx_cfg GROUP BY project_id) ts USING (project_id)
  LEFT JOIN fx_fw fw USING (project_id)
  LEFT JOIN fx_pm pm USING (project_id)
  LEFT JOIN (SELECT project_id, bool_or(rel_path = 'pom.xml') AS has_pom, bool_or(rel_path IN ('README.md', 'readme.md')) AS has_readme,
                    bool_or(rel_path IN ('Dockerfile', 'docker-compose.yml')) AS has_docker,
                    bool_or(rel_path = '.gitignore') AS has_gitignore
             FROM fx_tree GROUP BY project_id) bt USING (project_id))"""

BASE.append(FX_TREE)

# generated file content and expected chunks ------------------------------
FX_CONTENT = """fx_code AS (
  SELECT project_id, rel_path, language, ext, d, k, n, has_class, array_to_string(
    (CASE WHEN NOT has_imports THEN ['', '', '', '']
          WHEN ext = 'py' THEN ['import os', 'from .doc_' || (d + 60) || ' import x',
                                'from src.m' || ((d + 20) % 3) || '.doc_' || (d + 20) || ' import y', '']
          WHEN ext = 'java' THEN ['import java.util.List;', 'import src.m' || ((d + 20) % 3) || '.doc_' || (d + 20) || ';',
                                  'import m' || (d % 3) || '.doc_' || (d + 60) || '.x;', '']
          ELSE ['import os from "os";', 'import { x } from "./doc_' || (d + 60) || '";',
                'import { y } from "../m' || ((d + 20) % 3) || '/doc_' || (d + 20) || '.js";', ''] END)
    || flatten(list_transform(range(1, n + 1), lambda i: CASE
         WHEN ext = 'py' THEN ['def f_' || ((k + i) % 7) || '_' || i || '(a, b=1):',
              '    v = f_' || ((3 * k + i) % 9) || '_' || i || '(a)', '    return print(v)', '']
         WHEN ext = 'java' THEN ['int f_' || ((k + i) % 7) || '_' || i || '(int a, int b) {',
              '  int v = f_' || ((3 * k + i) % 9) || '_' || i || '(a);', '  return print(v);', '}']
         ELSE ['function f_' || ((k + i) % 7) || '_' || i || '(a, b) {',
              '  const v = f_' || ((3 * k + i) % 9) || '_' || i || '(a);', '  return print(v);', '}'] END))
    || (CASE WHEN NOT has_class THEN []::VARCHAR[]
          WHEN ext = 'py' THEN ['class C_' || (k % 4) || ':', '    def run(self):', '        return self.f_' || (k % 7) || '_1(0)', '']
          WHEN ext = 'java' THEN ['class C_' || (k % 4) || ' {', '  int run() {', '    return this.f_' || (k % 7) || '_1(0);', '  }', '}']
          ELSE ['class C_' || (k % 4) || ' {', '  run() {', '    return this.f_' || (k % 7) || '_1(0);', '  }', '}'] END)
    || ['f_' || ((k + 1) % 7) || '_1(0)']
    || (CASE WHEN d % 3 = 1 THEN [CASE WHEN ext = 'py' THEN '\"\"\"' ELSE '/*' END] || string_split(body, chr(10))
                                 || [CASE WHEN ext = 'py' THEN '\"\"\"' ELSE '*/' END]
             ELSE list_transform(string_split(body, chr(10)), lambda x: CASE WHEN ext = 'py' THEN '# ' ELSE '// ' END
                                 || CASE WHEN d % 3 = 2 THEN '\"' ELSE '' END || x) END), chr(10)) AS content
  FROM fx_src),
fx_ranges AS (
  SELECT project_id, rel_path, 'function' AS chunk_type, name, line, end_line FROM fx_funcs
  UNION ALL SELECT project_id, rel_path, 'class', name, line, end_line FROM fx_classes),
fx_lines AS (
  SELECT project_id, rel_path, language, i AS line, string_split(content, chr(10))[i] AS text,
         len(string_split(content, chr(10))) AS n_lines
  FROM fx_code, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS u(i)),
fx_chunks AS (
  SELECT r.project_id, trim(regexp_replace(r.rel_path, '[^a-zA-Z0-9_\\-]', '_', 'g'), '_') || '_'
           || CASE r.chunk_type WHEN 'function' THEN 'func' ELSE 'class' END || '_' || r.name || '_' || r.line AS chunk_id,
         r.chunk_type, r.name, r.rel_path AS file_path, c.language, r.line, r.end_line,
         array_to_string(string_split(c.content, chr(10))[r.line:r.end_line], chr(10)) AS code,
         CASE r.chunk_type WHEN 'function' THEN 'Function: ' ELSE 'Class: ' END || r.name || chr(10) || 'File: '
           || r.rel_path || chr(10) || 'Language: ' || c.language || chr(10) || chr(10) || 'Code:' || chr(10)
           || array_to_string(string_split(c.content, chr(10))[r.line:r.end_line], chr(10)) AS content
  FROM fx_ranges r JOIN fx_code c USING (project_id, rel_path)
  UNION ALL
  SELECT project_id, trim(regexp_replace(rel_path, '[^a-zA-Z0-9_\\-]', '_', 'g'), '_') || '_file', 'file',
         regexp_extract(rel_path, '[^/]+$'), rel_path, language, 1, len(string_split(content, chr(10))),
         trim(content, ' ' || chr(10)),
         'File: ' || rel_path || chr(10) || 'Language: ' || language || chr(10) || chr(10) || 'Code:' || chr(10)
           || trim(content, ' ' || chr(10))
  FROM fx_code c WHERE NOT EXISTS (SELECT 1 FROM fx_ranges r WHERE r.project_id = c.project_id AND r.rel_path = c.rel_path)
  UNION ALL
  SELECT project_id, trim(regexp_replace(rel_path, '[^a-zA-Z0-9_\\-]', '_', 'g'), '_') || '_top_level', 'file',
         regexp_extract(rel_path, '[^/]+$') || ' (top-level)', rel_path, language, 1, max(n_lines),
         trim(string_agg(text, chr(10) ORDER BY line), ' ' || chr(10)),
         'File Setup / Top-Level: ' || rel_path || chr(10) || 'Language: ' || language || chr(10) || chr(10)
           || 'Code:' || chr(10) || trim(string_agg(text, chr(10) ORDER BY line), ' ' || chr(10))
  FROM fx_lines l
  WHERE EXISTS (SELECT 1 FROM fx_ranges r WHERE r.project_id = l.project_id AND r.rel_path = l.rel_path)
    AND NOT EXISTS (SELECT 1 FROM fx_ranges r WHERE r.project_id = l.project_id AND r.rel_path = l.rel_path
                    AND l.line BETWEEN r.line AND r.end_line)
  GROUP BY project_id, rel_path, language
  HAVING count(*) FILTER (WHERE trim(text) <> '') >= 3)"""

BASE.append(FX_CONTENT)

# vectors ------------------------------------------------------------------
FX_VEC = """fx_questions AS (
  SELECT conv_id * 100 + turn AS question_id, 'src' || (conv_id % 20) AS project_id, 1 + (conv_id % 25) AS top_k,
    CASE (conv_id + turn) % 6 WHEN 0 THEN 'What does this project do?' WHEN 1 THEN 'Explain the architecture of this project.'
      WHEN 2 THEN 'What does f_' || (conv_id % 7) || '_1() do?' WHEN 3 THEN 'Explain src/m' || (conv_id % 3) || '/doc_' || conv_id || '.py'
      WHEN 4 THEN 'How are values printed and returned? ' || coalesce(text, '') ELSE '   ' END AS question
  FROM conversations WHERE role = 'user'),
fx_q AS (
  SELECT question_id, project_id, greatest(1, least(top_k, 20)) AS top_k, trim(question) AS query
  FROM fx_questions WHERE trim(question) <> ''),
fx_qtok AS (
  SELECT question_id, ('0x' || substr(md5(t), 1, 8))::UBIGINT AS h
  FROM fx_q, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS u(t)),
fx_ev AS (
  SELECT 'src' || label AS project_id, 'c_' || vec_id AS id, embedding FROM embeddings)"""
BASE.append(FX_VEC)


def bucket_vec(dim: int, name: str) -> str:
    return f"""{name} AS (
  SELECT question_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY question_id)) AS w FROM (
    SELECT question_id, (h % {dim})::BIGINT AS b, count(*)::DOUBLE AS c FROM fx_qtok GROUP BY ALL))"""

# roll-up with the echo model -------------------------------------------------
FX_ROLLUP = """fx_fb AS (
  SELECT *, (rn - 1) // 10 + 1 AS batch_no, (rn - 1) % 10 + 1 AS pos, CAST(ceil(total / 10) AS BIGINT) AS n_batches,
         least(10, total - ((rn - 1) // 10) * 10) AS batch_count FROM (
    SELECT f.*, row_number() OVER (PARTITION BY project_id ORDER BY rel_path, ord) AS rn,
           count(*) OVER (PARTITION BY project_id) AS total FROM fx_funcs f)),
fx_fsum AS (
  SELECT project_id, rel_path, ord, name, line, batch_no, pos,
         CASE WHEN batch_no % 7 = 0 AND pos = 1 THEN 'revised summary of ' ELSE 'summary of ' END || name AS summary
  FROM fx_fb WHERE NOT (batch_no % 5 = 0 AND batch_count >= 2)),
fx_fctx AS (
  SELECT s.project_id, s.rel_path, s.language,
         coalesce((SELECT string_agg(name, ',' ORDER BY ord) FROM fx_fsum f WHERE f.project_id = s.project_id AND f.rel_path = s.rel_path), '') AS function_names,
         CASE WHEN s.has_class THEN 'C_' || (s.k % 4) ELSE '' END AS class_names,
         CASE WHEN s.has_imports THEN 3 ELSE 0 END AS imports_count,
         coalesce((SELECT 'Functions:' || chr(10) || string_agg('  - ' || name || ': ' || summary || chr(10), '' ORDER BY ord)
                   FROM fx_fsum f WHERE f.project_id = s.project_id AND f.rel_path = s.rel_path),
                  'No functions defined.' || chr(10)) AS function_context,
         CASE WHEN s.has_class THEN 'Classes: C_' || (s.k % 4) || chr(10) ELSE '' END AS class_context
  FROM fx_src s),
fx_flb AS (
  SELECT *, (rn - 1) // 10 + 1 AS batch_no, (rn - 1) % 10 + 1 AS pos,
         least(10, total - ((rn - 1) // 10) * 10) AS batch_count FROM (
    SELECT c.*, row_number() OVER (PARTITION BY project_id ORDER BY rel_path) AS rn,
           count(*) OVER (PARTITION BY project_id) AS total FROM fx_fctx c)),
fx_flsum AS (
  SELECT project_id, rel_path, function_names,
         CASE WHEN batch_no % 7 = 0 AND pos = 1 THEN 'revised summary of ' ELSE 'summary of ' END || rel_path AS summary
  FROM fx_flb WHERE NOT (batch_no % 5 = 0 AND batch_count >= 2)),
fx_mods AS (
  SELECT project_id, path, regexp_extract(path, '[^/]+$') AS name, count(*) AS file_count,
         min(rel_path) AS first_file,
         'Files:' || chr(10) || string_agg('  - ' || regexp_extract(rel_path, '[^/]+$') || ': '
           || coalesce(summary, 'No summary available.') || chr(10)
           || CASE WHEN summary IS NOT NULL AND function_names <> '' THEN '    Functions: ' || replace(function_names, ',', ', ') || chr(10) ELSE '' END,
           '' ORDER BY rel_path) AS file_context
  FROM (SELECT s.project_id, s.rel_path, regexp_extract(s.rel_path, '^(.*)/[^/]*$', 1) AS path, fs.summary, fs.function_names
        FROM fx_src s LEFT JOIN fx_flsum fs USING (project_id, rel_path))
  GROUP BY project_id, path)"""
BASE.append(FX_ROLLUP)

# ask ------------------------------------------------------------------------
FX_ASK = """fx_cls AS (
  SELECT conv_id * 100 + turn AS question_id, 'src' || (conv_id % 20) AS project_id,
         greatest(1, least(1 + (conv_id % 25), 20)) AS top_k, (conv_id + turn) % 6 AS kind,
         CASE (conv_id + turn) % 6 WHEN 0 THEN 'PROJECT_OVERVIEW' WHEN 1 THEN 'ARCHITECTURE' WHEN 2 THEN 'FUNCTION'
              WHEN 3 THEN 'FILE' WHEN 4 THEN 'SEMANTIC_SEARCH' END AS question_type,
         CASE (conv_id + turn) % 6 WHEN 2 THEN 'f_' || (conv_id % 7) || '_1'
              WHEN 3 THEN 'src/m' || (conv_id % 3) || '/doc_' || conv_id || '.py' END AS target_name,
         CASE WHEN (conv_id + turn) % 6 = 5 THEN 'Question must not be empty.' END AS error,
         CASE (conv_id + turn) % 6 WHEN 0 THEN 'What does this project do?' WHEN 1 THEN 'Explain the architecture of this project.'
           WHEN 2 THEN 'What does f_' || (conv_id % 7) || '_1() do?' WHEN 3 THEN 'Explain src/m' || (conv_id % 3) || '/doc_' || conv_id || '.py'
           WHEN 4 THEN 'How are values printed and returned? ' || coalesce(text, '') ELSE '   ' END AS question
  FROM conversations WHERE role = 'user'),
fx_fnmatch AS (
  SELECT c.question_id, f.rel_path, f.ord, f.name, f.line, f.end_line
  FROM fx_cls c JOIN fx_funcs f ON f.project_id = c.project_id AND lower(f.name) = lower(c.target_name)
  WHERE c.question_type = 'FUNCTION'),
fx_filematch AS (
  SELECT c.question_id, min(s.rel_path) AS rel_path
  FROM fx_cls c JOIN fx_src s ON s.project_id = c.project_id
   AND (lower(s.rel_path) = lower(c.target_name) OR lower(regexp_extract(s.rel_path, '[^/]+$')) = lower(regexp_extract(c.target_name, '[^/]+$')))
  WHERE c.question_type = 'FILE' GROUP BY c.question_id),
fx_keydeps AS (
  SELECT * FROM (SELECT project_id, source, target, row_number() OVER (PARTITION BY project_id ORDER BY source, ord) AS rn
                 FROM fx_imp_res) WHERE rn <= 15),
fx_found AS (
  SELECT c.question_id,
         CASE c.question_type WHEN 'FUNCTION' THEN EXISTS (SELECT 1 FROM fx_fnmatch m WHERE m.question_id = c.question_id)
              WHEN 'FILE' THEN EXISTS (SELECT 1 FROM fx_filematch m WHERE m.question_id = c.question_id)
              WHEN 'SEMANTIC_SEARCH' THEN EXISTS (SELECT 1 FROM fx_chunks k WHERE k.project_id = c.project_id)
              WHEN 'ARCHITECTURE' THEN true WHEN 'PROJECT_OVERVIEW' THEN true ELSE false END AS found
  FROM fx_cls c)"""
BASE.append(FX_ASK)
