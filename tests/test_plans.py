"""Plan shape checks: the joins of resolution, graphs and chunking are hash
or sort-merge equi-joins (never nested loops or cartesian products), they
run without Python workers, and scans prune columns."""

import pytest

from codeweave.plans.corpus import corpus
from conftest import SF_SMALL

BAD_JOINS = ["BroadcastNestedLoopJoin", "CartesianProduct"]
PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def c(spark):
    return corpus(spark, SF_SMALL)


def _operator_outputs(c):
    from codeweave.operators import chunks as CH
    from codeweave.operators import graphs as G
    from codeweave.operators import resolve as R
    files = c.files.select("project_id", "file_path")
    rc = R.resolve_calls(c.calls, c.functions)
    ri = R.resolve_imports(c.imports, files)
    return {"resolve_calls": rc, "call_nodes": G.call_graph_nodes(rc, c.functions),
            "call_edges": G.call_graph_edges(rc), "resolve_imports": ri,
            "dep_nodes": G.dependency_graph_nodes(files), "chunks": CH.code_chunks(c.files, c.functions, c.classes)}


@pytest.mark.parametrize("name", ["resolve_calls", "call_nodes", "call_edges", "resolve_imports", "dep_nodes",
                                  "chunks"])
def test_no_nested_loops_or_python(c, name):
    p = plan_of(_operator_outputs(c)[name])
    assert "Join" in p or name in ("dep_nodes",)
    for bad in BAD_JOINS + PYTHON_NODES:
        assert bad not in p, f"{name}: {bad} in plan"


def test_entity_job_has_no_python_and_no_nested_loop(spark):
    from codeweave.operators.entities import extract_entities
    from codeweave.operators.files import source_files
    from codeweave.sources.fixtures import corpus_files
    e = extract_entities(source_files(corpus_files(spark, SF_SMALL)), materialize=False)
    for df in (e.functions, e.classes, e.calls, e.imports):
        p = plan_of(df)
        for bad in BAD_JOINS + PYTHON_NODES:
            assert bad not in p


def test_per_file_windows_reuse_partitioning(spark):
    """After the one repartition of file rows, the per-line windows of the
    extraction add no exchange of their own."""
    from codeweave.operators.lines import file_lines, line_features, partition_files
    from codeweave.operators.files import source_files
    from codeweave.sources.fixtures import corpus_files
    files = source_files(corpus_files(spark, SF_SMALL)).select("project_id", "file_path", "language", "content")
    lf = line_features(file_lines(partition_files(files)))
    assert plan_of(lf).count("Exchange") == 1


def test_scan_prunes_columns(spark):
    from codeweave.session import read_table
    df = read_table(spark, SF_SMALL, "documents").select("doc_id", "source").where("doc_id > 5")
    p = plan_of(df)
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p
    assert "PushedFilters" in p


def test_search_leaves_vectors_where_they_are(spark, c):
    """Vectors go from their scan straight into the scoring task; no exchange, no pairs as rows."""
    from codeweave.operators.vectors import search
    from codeweave.plans.queries import _embedding_store_rows, _question_vectors
    q = _question_vectors(spark, SF_SMALL, 64)
    p = plan_of(search(q, _embedding_store_rows(spark, SF_SMALL), unit_vectors=False))
    assert "MapInArrow" in p and "CartesianProduct" not in p and "NestedLoop" not in p and "CoGroup" not in p
    below = p[p.index("MapInArrow"):].splitlines()
    scan = next(i for i, line in enumerate(below) if "FileScan" in line or "Scan parquet" in line)
    assert "embeddings.parquet" in below[scan] and not any("Exchange" in line for line in below[:scan])


def test_context_texts_move_by_context_key_only(spark, c):
    """No exchange keyed by question_id carries a text, and a text is stored once per key."""
    import re
    t = c.ask_tables
    from codeweave.operators.ask import context_table, retrieve
    made = context_table(c.classified, t)
    for df in (made, retrieve(c.classified, t, c.context_table)):
        for exchange in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df)):
            assert not exchange.startswith("question_id")
    keys = made.select("context_key").collect()
    assert len({k.context_key for k in keys}) == len(keys) < c.classified.count()
