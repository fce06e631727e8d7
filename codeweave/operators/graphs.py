"""Graph builders E14-E19: node and edge tables of the function call graph
and the file dependency graph.

Edges are bags (multi-edges kept, never ``distinct``).  Node tables are one
row per id, chosen with a priority struct in a single partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import EXTERNAL_FILE
from .resolve import project_roots

FILE_KEY = ["project_id", "file_path"]


def call_graph_edges(resolved_calls: DataFrame) -> DataFrame:
    """(project_id, source, target, type, line) per resolved call."""
    return resolved_calls.select(
        "project_id",
        F.concat_ws("::", "caller_info.file", "caller_info.name").alias("source"),
        F.concat_ws("::", "callee_info.file", "callee_info.name").alias("target"),
        F.lit("calls").alias("type"),
        F.col("call_line").alias("line"))


def call_graph_nodes(resolved_calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Every indexed function (the LAST definition of a name in a file
    gives the line), then callers and callees not yet present (first
    appearance in call order wins); type 'external' only for callees in the
    'external' file."""
    idx = (functions.groupBy(*FILE_KEY, "name")
           .agg(F.max_by("line", "ord").alias("line"))
           .select("project_id", F.concat_ws("::", "file_path", "name").alias("id"),
                   F.lit("function").alias("type"), F.col("name").alias("label"),
                   "file_path", "line",
                   F.struct(F.lit(0).alias("tier"), F.lit("").alias("f"), F.lit(0).alias("o"),
                            F.lit(0).alias("side")).alias("prio")))

    def from_calls(info, side, typ):
        return resolved_calls.select(
            "project_id", F.concat_ws("::", f"{info}.file", f"{info}.name").alias("id"),
            typ.alias("type"), F.col(f"{info}.name").alias("label"),
            F.col(f"{info}.file").alias("file_path"), F.col(f"{info}.line").alias("line"),
            F.struct(F.lit(1).alias("tier"), F.col("file_path").alias("f"), F.col("ord").alias("o"),
                     F.lit(side).alias("side")).alias("prio"))

    callers = from_calls("caller_info", 0, F.lit("function"))
    callees = from_calls("callee_info", 1, F.when(F.col("callee_info.file") == EXTERNAL_FILE,
                                                  F.lit("external")).otherwise(F.lit("function")))
    allnodes = idx.unionByName(callers).unionByName(callees)
    best = (allnodes.groupBy("project_id", "id")
            .agg(F.min_by(F.struct("type", "label", "file_path", "line"), "prio").alias("n")))
    return best.select("project_id", "id", "n.type", "n.label", "n.file_path", "n.line")


def dependency_graph_edges(resolved_imports: DataFrame) -> DataFrame:
    """(project_id, source, target, type, line) per resolved import."""
    return resolved_imports.select(
        "project_id", P.normpath(F.col("source")).alias("source"),
        P.normpath(F.col("target")).alias("target"), F.lit("imports").alias("type"), "line")


def dependency_graph_nodes(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One node per analyzed file, label relative to the project root.
    Import endpoints are analyzed files, so they add no node."""
    roots = roots if roots is not None else project_roots(files)
    return (files.select("project_id", "file_path").join(roots, "project_id")
            .withColumn("_norm", P.normpath("file_path"))
            .select("project_id", F.col("_norm").alias("id"), F.lit("file").alias("type"),
                    P.strip_root("_norm", "root").alias("label"), F.col("_norm").alias("file_path"))
            .dropDuplicates(["project_id", "id"]))


def graphs(call_nodes: DataFrame, call_edges: DataFrame, dep_nodes: DataFrame,
           dep_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both graphs of every project as one node and one edge table with
    a ``graph`` column."""
    nodes = (call_nodes.withColumn("graph", F.lit("function_calls"))
             .unionByName(dep_nodes.withColumn("line", F.lit(None).cast("int"))
                          .withColumn("graph", F.lit("dependencies"))))
    edges = (call_edges.withColumn("graph", F.lit("function_calls"))
             .unionByName(dep_edges.withColumn("graph", F.lit("dependencies"))))
    return nodes, edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts per (project_id, graph)."""
    n = nodes.groupBy("project_id", "graph").agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy("project_id", "graph").agg(F.count(F.lit(1)).alias("edge_count"))
    return (n.join(e, ["project_id", "graph"], "full")
            .select("project_id", "graph", F.coalesce("node_count", F.lit(0)).alias("node_count"),
                    F.coalesce("edge_count", F.lit(0)).alias("edge_count")))
