"""Pipeline stages over one dataset directory, built lazily and shared.

``Corpus(spark, sf_dir)`` exposes the stage tables (files, entities,
resolved calls/imports, graphs, ...) of the generated code corpus.  The
expensive per-line stage is checkpointed once per (session, dataset) so that
every query built on it reads the small entity tables.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import entities as E
from ..operators import files as FL
from ..operators import graphs as G
from ..operators import resolve as R
from ..session import ensure_checkpoint_dir, ship_code
from ..sources import fixtures as FX
from ..sources.store import materialize
from ..sources.store import materialize as store_table

_CACHE: dict[tuple, "Corpus"] = {}


def corpus(spark: SparkSession, sf_dir: str) -> "Corpus":
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    c = _CACHE.get(key)
    if c is None or c.spark is not spark:  # stored tables belong to the session that made them
        c = _CACHE[key] = Corpus(spark, sf_dir)
    return c


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        ensure_checkpoint_dir(spark)
        ship_code(spark)

    # ------------------------------------------------------------ sources
    @cached_property
    def all_files(self) -> DataFrame:
        """Every file of every project tree: the stored source files plus the
        config files."""
        from ..operators.files import files_from_paths
        cfg = FX.fx_config(self.spark, self.sf_dir).withColumn("file_path", F.col("rel_path"))
        return self.source_tree.unionByName(files_from_paths(cfg))

    @cached_property
    def source_tree(self) -> DataFrame:
        """The generated source files (no config files), stored once."""
        return materialize(FX.corpus_files(self.spark, self.sf_dir), "source_tree")

    @cached_property
    def discovered(self) -> DataFrame:
        """A1/B1/B2: discovered source files."""
        return FL.discover_source_files(self.source_tree)

    @cached_property
    def files(self) -> DataFrame:
        """Analyzed files (with content)."""
        return FL.analyzable(self.discovered)

    # ----------------------------------------------------------- entities
    @cached_property
    def entities(self) -> E.Entities:
        return E.extract_entities(self.files)

    @property
    def functions(self) -> DataFrame:
        return self.entities.functions

    @property
    def classes(self) -> DataFrame:
        return self.entities.classes

    @property
    def imports(self) -> DataFrame:
        return self.entities.imports

    @property
    def calls(self) -> DataFrame:
        return self.entities.calls

    # --------------------------------------------------------- resolution
    @cached_property
    def roots(self) -> DataFrame:
        return store_table(R.project_roots(self.files.select("project_id", "file_path")), "roots")

    @cached_property
    def resolved_calls(self) -> DataFrame:
        """D1/D2 output, stored (the call graph and several strategies read it)."""
        return store_table(R.resolve_calls(self.calls, self.functions), "resolved_calls")

    @cached_property
    def resolved_imports(self) -> DataFrame:
        """D7 output, stored."""
        return store_table(R.resolve_imports(self.imports, self.files.select("project_id", "file_path"),
                                             self.roots), "resolved_imports")

    @cached_property
    def call_edges(self) -> DataFrame:
        return G.call_graph_edges(self.resolved_calls)

    @cached_property
    def call_nodes(self) -> DataFrame:
        return store_table(G.call_graph_nodes(self.resolved_calls, self.functions), "call_nodes")

    @cached_property
    def dep_edges(self) -> DataFrame:
        return G.dependency_graph_edges(self.resolved_imports)

    @cached_property
    def chunks(self) -> DataFrame:
        """H1, stored; ``content`` repeats the code and is put together when it is read."""
        from ..operators.chunks import code_chunks, with_content
        return with_content(store_table(code_chunks(self.files, self.functions, self.classes).drop("content"), "chunks"))

    @cached_property
    def enriched_chunks(self) -> DataFrame:
        from ..operators.chunks import enrich_chunks
        return enrich_chunks(self.chunks)

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        """K1 over the enriched chunk documents (768 dims), stored once, a project's side
        by side: a task of the search meets few projects and their questions.  The documents,
        which repeat the code, are put together when they are read."""
        from ..operators.chunks import document_text
        from ..operators.vectors import embed
        c = self.enriched_chunks.drop("content")
        stored = store_table(embed(c, "content", by=("project_id", "chunk_id"), text=document_text()), "chunk_vectors")
        return stored.withColumn("content", document_text())

    @cached_property
    def chunk_records(self) -> DataFrame:
        """A5 input: flat vector records with store ids, one per id (see
        ``duplicate_chunk_ids`` for the records left out)."""
        from ..operators.vectors import dedupe_records, vector_records
        kept, self._duplicates = dedupe_records(vector_records(self.chunk_vectors))
        return kept

    @property
    def duplicate_chunk_ids(self) -> DataFrame:
        self.chunk_records
        return self._duplicates

    # ------------------------------------------------------------ roll-up
    model = "echo"

    @cached_property
    def function_run(self):
        from ..operators.rollup import summarize_functions
        return summarize_functions(self.files, self.functions, self.model)

    @cached_property
    def function_summaries(self) -> DataFrame:
        return store_table(self.function_run.summaries, "function_summaries")

    @cached_property
    def file_context(self) -> DataFrame:
        from ..operators.rollup import file_context
        return file_context(self.files, self.function_summaries, self.classes, self.imports)

    @cached_property
    def file_run(self):
        from ..operators.rollup import summarize_files
        return summarize_files(self.file_context, self.model)

    @cached_property
    def file_summaries(self) -> DataFrame:
        return store_table(self.file_run.summaries, "file_summaries")

    @cached_property
    def modules(self) -> DataFrame:
        from ..operators.project import detect_modules
        return detect_modules(self.files)

    @cached_property
    def module_files(self) -> DataFrame:
        from ..operators.project import module_files
        return module_files(self.files)

    @cached_property
    def module_context(self) -> DataFrame:
        from ..operators.rollup import module_context
        return module_context(self.modules, self.module_files, self.file_summaries)

    @cached_property
    def module_run(self):
        from ..operators.rollup import summarize_modules
        return summarize_modules(self.module_context, self.model)

    @cached_property
    def module_summaries(self) -> DataFrame:
        return store_table(self.module_run.summaries, "module_summaries")

    @cached_property
    def config_files(self) -> DataFrame:
        """Candidate config files (the generated sources have code suffixes
        only, so the config-file table holds all of them)."""
        return FX.fx_config(self.spark, self.sf_dir)

    @cached_property
    def project_info(self) -> DataFrame:
        from ..operators.project import project_info
        tree = self.all_files.select("project_id", "rel_path", "ext", "language")
        return store_table(project_info(tree, self.config_files), "project_info")

    @cached_property
    def graph_stats(self) -> DataFrame:
        nodes, edges = G.graphs(self.call_nodes, self.call_edges, self.dep_nodes, self.dep_edges)
        return store_table(G.graph_stats(nodes, edges), "graph_stats")

    @cached_property
    def project_summary(self) -> DataFrame:
        from ..operators.rollup import summarize_projects
        ms = self.module_summaries.select("project_id", "pos", "name", "file_count", "summary")
        return store_table(summarize_projects(ms, self.project_info, self.graph_stats, self.model),
                           "project_summary")

    # ---------------------------------------------------------------- ask
    @cached_property
    def questions(self) -> DataFrame:
        return FX.fx_questions(self.spark, self.sf_dir)

    @cached_property
    def classified(self) -> DataFrame:
        from ..operators.ask import classify_rules
        return store_table(classify_rules(self.questions), "classified")

    @cached_property
    def search_hits(self) -> DataFrame:
        """K7 for the SEMANTIC_SEARCH questions of the batch (B9 projection)."""
        from ..operators.vectors import embed, prepare_questions, search, search_results
        sem = self.classified.where(F.col("question_type") == "SEMANTIC_SEARCH")
        q = prepare_questions(sem).select("question_id", "project_id", "top_k", "query")
        qv = store_table(embed(q, "query", out_col="qvec"), "question_vectors")  # one model call per question
        hits = store_table(search(qv, self.chunk_records, extra_cols=[
            "project_id", "file_path", "chunk_type", "name", "summary", "line", "end_line"]), "search_hits")
        # of the code, what was found is kept, each once
        key = ["project_id", "id"]
        code = store_table(self.chunk_records.select(*key, "code").join(hits.select(*key).distinct(), key, "left_semi"), "found_code")
        return search_results(hits.join(code, key))

    @cached_property
    def totals(self) -> DataFrame:
        from ..operators.project import project_totals
        return project_totals(self.discovered, self.functions, self.classes)

    @cached_property
    def code_tables(self):
        """What answers need of the code; without search hits."""
        from ..functions import paths as P
        from ..operators.ask import AskTables
        dep = self.resolved_imports.select(
            "project_id", F.col("source").alias("file_path"), "ord",
            P.normpath("source").alias("source"), P.normpath("target").alias("target"))
        return AskTables(files=self.files, functions=self.functions, classes=self.classes, imports=self.imports,
                         modules=self.modules, project_info=self.project_info, totals=self.totals,
                         dep_edges=dep, call_edges=self.call_edges)

    @cached_property
    def ask_tables(self):
        return replace(self.code_tables, search_hits=self.search_hits)

    @cached_property
    def shared_contexts(self) -> DataFrame:
        """Each context text that many questions may ask for once, by key; stored
        one strategy after the other, as each moves texts of its own."""
        from ..operators.ask import shared_context_tables
        parts = [store_table(part, f"context-{name}") for name, part in
                 shared_context_tables(self.classified, self.ask_tables).items()]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def semantic_contexts(self) -> DataFrame:
        """A text per question, which is read once: not stored."""
        from ..operators.ask import semantic_contexts
        return semantic_contexts(self.classified, self.ask_tables)

    @property
    def context_table(self) -> DataFrame:
        """Each context text once, by key."""
        return self.shared_contexts.unionByName(self.semantic_contexts)

    @cached_property
    def contexts(self) -> DataFrame:
        """The questions with their context texts, joined by key (not stored: the texts are,
        those of semantic search as far as the code that was found)."""
        from ..operators.ask import retrieve
        semantic = F.coalesce(F.col("question_type") == "SEMANTIC_SEARCH", F.lit(False))
        return retrieve(self.classified.where(~semantic), self.ask_tables, self.shared_contexts, shared=True).unionByName(
            retrieve(self.classified.where(semantic), self.ask_tables, self.semantic_contexts))

    @cached_property
    def source_table(self) -> DataFrame:
        """Each list of citations once, by context key."""
        from ..operators.ask import source_table
        return store_table(source_table(self.classified, self.ask_tables), "source_table")

    @cached_property
    def answer_sources(self) -> DataFrame:
        from ..operators.ask import answer_sources
        return answer_sources(self.classified, self.ask_tables, self.source_table)

    @cached_property
    def answers(self) -> DataFrame:
        from ..operators.ask import answer
        return store_table(answer(self.contexts, self.model), "answers")

    @cached_property
    def dep_nodes(self) -> DataFrame:
        return store_table(G.dependency_graph_nodes(self.files.select("project_id", "file_path"), self.roots),
                           "dep_nodes")


def as_bigint(df: DataFrame) -> DataFrame:
    """Cast INT/SMALLINT to BIGINT and FLOAT to DOUBLE at the output edge, so
    results compare with SQL engines that widen integers."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
