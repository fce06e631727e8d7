"""Structural properties of the pipeline outputs."""

from pyspark.sql import functions as F

from codeweave.plans.corpus import corpus
from conftest import SF_SMALL


def test_call_edge_endpoints_are_nodes(spark):
    c = corpus(spark, SF_SMALL)
    ids = c.call_nodes.select("project_id", F.col("id").alias("x"))
    for end in ("source", "target"):
        e = c.call_edges.select("project_id", F.col(end).alias("x"))
        assert e.join(ids, ["project_id", "x"], "left_anti").count() == 0


def test_dependency_targets_are_files(spark):
    c = corpus(spark, SF_SMALL)
    files = c.files.select("project_id", F.col("file_path").alias("target"))
    assert c.resolved_imports.join(files, ["project_id", "target"], "left_anti").count() == 0
    assert c.resolved_imports.where(F.col("source") == F.col("target")).count() == 0


def test_chunk_ids_unique(spark):
    c = corpus(spark, SF_SMALL)
    assert c.chunks.groupBy("project_id", "chunk_id").count().where("count > 1").count() == 0


def test_projects_never_mix(spark):
    """Per-project runs equal the corpus run (resolution stays inside a project)."""
    from codeweave.operators import entities as EN
    from codeweave.operators import graphs as G
    from codeweave.operators import resolve as R
    c = corpus(spark, SF_SMALL)
    whole = c.call_edges.where(F.col("project_id") == "src3")
    one = c.files.where(F.col("project_id") == "src3")
    e = EN.extract_entities(one, materialize=False)
    alone = G.call_graph_edges(R.resolve_calls(e.calls, e.functions))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, alone.collect()))


def test_every_line_is_covered_or_top_level(spark):
    from codeweave.operators.chunks import top_level_lines
    c = corpus(spark, SF_SMALL)
    top = top_level_lines(c.files, c.functions, c.classes).select("project_id", "file_path", "line")
    f = c.functions.select("project_id", "file_path", "line", "end_line").unionByName(
        c.classes.select("project_id", "file_path", "line", "end_line"))
    covered = (f.select("project_id", "file_path", F.explode(F.sequence("line", "end_line")).alias("line")))
    all_lines = c.entities.lines.select("project_id", "file_path", "line")
    missing = all_lines.join(top, ["project_id", "file_path", "line"], "left_anti") \
        .join(covered, ["project_id", "file_path", "line"], "left_anti")
    assert missing.count() == 0
