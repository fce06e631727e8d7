"""What must not grow with questions times code: steps that shuffle, pack or repeat too much."""

from pyspark.sql import functions as F

from codeweave.operators import ask, entities, rollup, vectors
from codeweave.plans.corpus import Corpus


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_vectors_are_made_in_small_pieces_and_kept_by_project(spark):
    df = spark.createDataFrame([(f"p{i % 3}", i, f"a b_{i}") for i in range(90)], "project_id string, n long, text string")
    made = vectors.embed(df, "text", dim=4, batch_size=7, by=("project_id", "n"))
    p = plan_of(made)
    assert "MapInArrow" in p and "rangepartitioning(project_id" in p
    want = vectors.HashedTokenEmbedder(4)
    assert {r.n: r.embedding for r in made.collect()} == {i: want([f"a b_{i}"])[0].tolist() for i in range(90)}


def test_records_are_not_grouped_again_to_leave_out_repeated_ids(spark):
    rows = [("p", f"i{i // 2 if i < 4 else i}", "f", i, "n", [float(i)]) for i in range(20)]
    records = spark.createDataFrame(rows, "project_id string, id string, file_path string, line int, name string, embedding array<double>")
    kept, dups = vectors.dedupe_records(records)
    assert "Aggregate" not in plan_of(kept)
    assert sorted(r.line for r in kept.collect()) == [0, 2, *range(4, 20)] and sorted(r.line for r in dups.collect()) == [1, 3]


def test_code_tables_need_no_search():
    class Parts(Corpus):
        files = functions = classes = imports = modules = project_info = totals = call_edges = None

        def __init__(self, edges):
            self.resolved_imports = edges

        @property
        def search_hits(self):
            raise AssertionError("searched")

    class Edges:
        def select(self, *_):
            return None

    assert Parts(Edges()).code_tables.search_hits is None


def test_matches_meet_questions_after_their_code(spark):
    files = spark.createDataFrame([("p", f"f{i}", f"f{i}", "a\nb\nc") for i in range(4)],
                                  "project_id string, file_path string, rel_path string, content string")
    functions = spark.createDataFrame([("p", f"f{i}", 1, "Go", "x", 2, 3, ["a"]) for i in range(4)],
                                      "project_id string, file_path string, ord int, name string, language string, line int, "
                                      "end_line int, parameters array<string>")
    asked = spark.createDataFrame([(i, "p", "FUNCTION", " gO ") for i in range(3)],
                                  "question_id long, project_id string, question_type string, target_name string")
    t = ask.AskTables(files, functions, None, None, None, None, None, None, None)
    got = ask.function_matches(asked, t)
    assert sorted((r.question_id, r.file_path, r.code) for r in got.collect()) == [
        (q, f"f{i}", "b\nc") for q in range(3) for i in range(4)]
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "_key" in joins[0] and "file_path" not in joins[0], "the questions are joined last"


def test_citations_meet_questions_as_lists(spark):
    ctx = spark.createDataFrame([(i, "p", "q", "ARCHITECTURE", None, None, "architecture") for i in (0, 1, 2, 5, 5)],
                                "question_id long, project_id string, question string, question_type string, "
                                "target_name string, error string, strategy string")
    answers = spark.createDataFrame([(i, "a", i == 2, None) for i in (0, 1, 2, 5)],
                                    "question_id long, answer string, insufficient boolean, error string")
    sources = spark.createDataFrame([("ARCHITECTURE|p", k, f"f{k}", "n", "file", None, None) for k in (2, 1)],
                                    "context_key string, pos int, file_path string, name string, chunk_type string, line int, end_line int")
    got = ask.answer_records(ctx, answers, sources)
    assert {r.question_id: [s.file_path for s in r.sources] for r in got.collect()} == {
        0: ["f1", "f2"], 1: ["f1", "f2"], 2: [], 5: ["f1", "f1", "f2", "f2"]}


def test_partitions_of_the_extraction_follow_the_text(spark, monkeypatch):
    files = spark.createDataFrame([("p", f"f{i}.py", "Python", "def f(a):\n    return g(a)\n") for i in range(40)],
                                  "project_id string, file_path string, language string, content string")
    monkeypatch.setattr(entities, "TASK_TEXT", 50, raising=False)
    e = entities.extract_entities(files, materialize=False)
    assert "REPARTITION_BY_NUM" in e.lines._jdf.queryExecution().executedPlan().toString()
    assert e.lines.rdd.getNumPartitions() >= 20


def test_items_of_prompts_are_made_once(spark):
    items = spark.createDataFrame([("p", f"f{i}", 0, f"n{i}") for i in range(12)],
                                  "project_id string, file_path string, ord int, name string")
    text = F.concat(F.lit("### "), F.col("pos").cast("string"), F.lit(". "), F.col("name"))
    run = rollup.run_batches(items, "file", "Each {kind}.", text, None, 10)
    assert {r.summary for r in run.summaries.collect()} == {f"summary of n{i}" for i in range(12)}
    assert "items-file" in "".join(run.summaries.inputFiles())


def test_recall_searches_once(spark):
    """What is found is read twice, from where it is stored."""
    from codeweave.plans.queries import k6_recall
    made = k6_recall(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in plan_of(made)
    assert all(r.recall_reached and r.within_top_k for r in made.collect())
