"""What is stored and shuffled on the way to chunks: texts once, and only what is read again."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweave.operators import ask, chunks, entities, vectors
from codeweave.plans.corpus import corpus
from codeweave.sources.store import SharedTables, materialize
from conftest import SF_SMALL

FILES = "project_id string, file_path string, rel_path string, language string, content string"
FUNCTIONS = "project_id string, file_path string, ord int, name string, line int, end_line int"


def exchanges_with(df, column):
    """Exchanges that carry a column of this name."""
    n, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.initialPlan())
            continue
        if p.nodeName() == "Exchange":
            n += any(p.output().apply(i).name() == column for i in range(p.output().size()))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_stored_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {str(files.apply(i)) for i in range(files.size()) if "shuffle_" in str(files.apply(i))}
    before, was = shuffles(), spark.conf.get(key)
    rows = spark.range(50_000).selectExpr("id % 999 AS k", "sha2(string(id), 256) AS t").repartition(5, "k").groupBy("k").agg(F.max("t"))
    stored = materialize(rows, "stored")
    until = time.time() + 10  # executors remove them on their own
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == was
    assert stored.count() == 999 and all(x.endswith(".zstd.parquet") for x in stored.inputFiles())


@pytest.mark.parametrize("seed", range(3))
def test_chunks_by_brute_force(spark, seed):
    """Ranges that overlap, end before they begin or lie past the end; a path that two files share."""
    rng = random.Random(seed)
    files, functions = [], []
    for i in range(40):
        text = [rng.choice(["", "  ", f"a{i}", "b c", "d"]) for _ in range(rng.randrange(0, 14))]
        files.append(("p", f"f{i // 2 if i < 6 else i}", f"d/f{i}.py", "Python", "\n".join(text)))
    for path in {f[1] for f in files if rng.random() < 0.8}:
        functions += [("p", path, k, f"n{k}", rng.randrange(1, 16), rng.randrange(1, 16)) for k in range(rng.randrange(1, 5))]
    f, fn = spark.createDataFrame(files, FILES), spark.createDataFrame(functions, FUNCTIONS)
    got = sorted((r.chunk_id, r.line, r.end_line, r.code, r.content) for r in chunks.code_chunks(f, fn, fn.limit(0)).collect())

    def lines_of(text):
        return text.split("\n")[:-1] if text.endswith("\n") or not text else text.split("\n")
    want = []
    for _, path, rel, _, text in files:
        mine = [(x[4], x[5], x[3]) for x in functions if x[1] == path]
        lines, slug, tail = lines_of(text), rel.replace("/", "_").replace(".", "_"), f"{rel}\nLanguage: Python\n\nCode:\n"
        for a, b, name in mine:
            code = "\n".join(lines[a - 1:b])
            if a <= b and a <= len(lines) and code.strip():
                want.append((f"{slug}_func_{name}_{a}", a, b, code, f"Function: {name}\nFile: {tail}{code}"))
        if not mine and text and "\n".join(lines).strip():
            code = "\n".join(lines).strip()
            want.append((f"{slug}_file", 1, len(lines), code, f"File: {tail}{code}"))
        if mine and text:
            out = []
            for other in (x for x in files if x[1] == path and x[4]):
                out += [(k, t) for k, t in enumerate(lines_of(other[4]), 1)
                        if sum(a <= k for a, _, _ in mine) == sum(b + 1 <= k for _, b, _ in mine)]
            if sum(bool(t.strip()) for _, t in out) >= 3:
                code = "\n".join(t for _, t in sorted(out)).strip()
                want.append((f"{slug}_top_level", 1, len(lines), code, f"File Setup / Top-Level: {tail}{code}"))
    assert got == sorted(want)


def test_text_moves_once_to_its_chunks(spark):
    f = spark.createDataFrame([("p", "f", "f", "Python", "a\nb\nc\nd")], FILES)
    fn = spark.createDataFrame([("p", "f", 1, "g", 1, 2)], FUNCTIONS)
    made = chunks.code_chunks(f, fn, fn.limit(0))
    assert exchanges_with(made, "content") == 1 and exchanges_with(made, "text") == 0


def test_code_meets_its_summary_once(spark):
    rows = [("p", "i1", "function", "g", "a/f.py", "Python", 1, 2, "x", "x"), ("p", "i2", "function", "h", "b/f.py", "Python", 1, 2, "y", "y"),
            ("p", "i3", "file", "f.py", "a/f.py", "Python", 1, 9, "z", "z"), ("p", "i4", "class", "g", "a/f.py", "Python", 1, 9, "w", "w"),
            (None, "i5", "function", "g", "a/f.py", "Python", 1, 2, "v", "v"), ("p", "i1", "function", "g", "a/f.py", "Python", 1, 2, "x2", "x2")]
    c = spark.createDataFrame(rows, "project_id string, chunk_id string, chunk_type string, name string, file_path string, "
                                    "language string, line int, end_line int, code string, content string")
    fs = spark.createDataFrame([("p", "a/f.py", 1, "g", "old"), ("p", "a/f.py", 2, "g", "new"), ("p", "q/f.py", 1, "h", "by base")],
                               "project_id string, file_path string, ord int, name string, summary string")
    fl = spark.createDataFrame([("p", "z/f.py", "of z"), ("p", "a/f.py", "of a")], "project_id string, file_path string, summary string")
    made = chunks.enrich_chunks(c, fs, fl)
    assert sorted((r.chunk_id, r.code, r.summary) for r in made.collect()) == [
        ("i1", "x", "new"), ("i1", "x2", "new"), ("i2", "y", "by base"), ("i3", "z", "of a"), ("i4", "w", None), ("i5", "v", None)]
    assert exchanges_with(made, "code") <= 1


def test_extraction_stores_only_lines_that_are_read(spark, monkeypatch):
    kept = {}
    store = entities.materialize_all

    def note(tables):
        done = store(tables)
        kept.update(zip(tables, done, strict=True))
        return done
    monkeypatch.setattr(entities, "materialize_all", note)
    text = "\n".join(f"words {k}" for k in range(50))
    files = spark.createDataFrame([
        ("p", "a.js", "JavaScript", f"import {{ x }} from 'm';\n/*\n{text}\n*/\nfunction f(a,\n  b) {{\n  g(1);\n}}\n"),
        ("p", "b.py", "Python", f'"""\n{text}\n"""\ndef f(a,\n      b=(1, 2)):\n    return g(a)\n')],
        "project_id string, file_path string, language string, content string")
    e = entities.extract_entities(files)
    assert {(r.file_path, r["name"], tuple(r.parameters), r.line, r.end_line) for r in e.functions.collect()} == {
        ("a.js", "f", ("a", "b"), 54, 57), ("b.py", "f", ("a", "b=(1, 2)"), 53, 55)}
    assert [(r.module, r.line) for r in e.imports.collect()] == [("m", 1)]
    assert {r.line for r in kept["lines"].collect()} == {1, 54, 55}
    assert kept["python"].where("text LIKE 'words%'").count() == 0
    assert e.lines.count() == 57 + 55


def test_embedded_text_is_made_after_rows_are_dealt(spark):
    df = spark.createDataFrame([("p", i, f"a b_{i}") for i in range(30)], "project_id string, n long, code string")
    made = vectors.embed(df, "content", dim=4, by=("project_id", "n"), text=F.concat(F.lit("x "), F.col("code")))
    assert exchanges_with(made, "code") == 1 and exchanges_with(made, "content") == 0 and "content" not in made.columns
    want = vectors.HashedTokenEmbedder(4)
    assert {r.n: r.embedding for r in made.collect()} == {i: want([f"x a b_{i}"])[0].tolist() for i in range(30)}


def test_questions_are_stored_compressed(spark, tmp_path):
    table = pa.table({"question_id": [1, 2], "qvec": pa.array([[0.0] * 700 + [1.0], [0.5] * 701])})
    for compression in (None, "zstd"):
        SharedTables(str(tmp_path)).put(f"q-{compression}", table, compression)
        assert SharedTables(str(tmp_path)).get(f"q-{compression}").equals(table)
    assert (tmp_path / "q-zstd").stat().st_size < 0.3 * (tmp_path / "q-None").stat().st_size


def test_search_and_contexts_store_a_text_once(spark):
    c = corpus(spark, SF_SMALL)

    def stored(df):
        return {f.rpartition("/")[0] for f in df.inputFiles()}
    (at,) = stored(c.chunk_vectors)
    assert not {"content", "document"} & set(spark.read.parquet(at).columns)
    columns = {re.search(r"([\w-]+)-\w{12}$", x)[1]: spark.read.parquet(x).columns for x in stored(c.search_hits)}
    assert "code" not in columns["search_hits"] and columns["found_code"] == ["project_id", "id", "code"]
    code = c.search_hits.select("chunk_id", "code").distinct()
    assert code.count() == code.select("chunk_id").distinct().count() <= spark.read.parquet(
        *(x for x in stored(c.search_hits) if "found_code" in x)).count()
    for x in stored(c.contexts):
        if "/context" in x:
            assert spark.read.parquet(x).where("strategy = 'semantic_search'").isEmpty()
    hits = c.search_hits.groupBy("question_id").count().count()
    assert c.contexts.where("strategy = 'semantic_search' AND found").count() == hits > 0


def test_contexts_that_many_ask_for_are_dealt_over_tasks(spark, monkeypatch):
    """A hot context has a copy per so many questions, and the partitions follow the text that is handed on."""
    monkeypatch.setattr(ask, "COPY_QUESTIONS", 10, raising=False)
    monkeypatch.setattr(ask, "TASK_CONTEXTS", 500, raising=False)
    rows = [(i, "p", "q?", "ARCHITECTURE" if i < 400 else "PROJECT_OVERVIEW", None, None) for i in range(405)]
    rows += [(900, None, "q?", "ARCHITECTURE", None, None), (901, "p", " ", None, None, "empty"), (902, "p", "q?", "FILE", "f", None),
             (1, "p", "q?", "ARCHITECTURE", None, None)]
    q = spark.createDataFrame(rows, "question_id long, project_id string, question string, question_type string, target_name string, error string")
    contexts = spark.createDataFrame([("ARCHITECTURE|p", "architecture", True, "x" * 100), ("PROJECT_OVERVIEW|p", "project_overview", True, "y"),
                                      ("ARCHITECTURE", "architecture", True, "none")],
                                     "context_key string, strategy string, found boolean, context string")
    key = lambda r: (r.question_id, r.question_type or "", r.strategy or "", r.found, r.context or "")
    got, want = (ask.retrieve(q, None, contexts, **x) for x in ({"shared": True}, {}))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() == len(rows)
    sizes = got.select(F.spark_partition_id().alias("p"), "context").where("context LIKE 'x%'").groupBy("p").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 100
