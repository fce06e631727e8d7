"""Goldens for question rules, JSON extraction, target clean-up, answer
parsing and provider resolution (I11-I16, L1, N1)."""

import json

import pytest
from pyspark.sql import functions as F

from codeweave.operators import ask as A
from codeweave.operators import infer as N
from codeweave.operators import rollup as R


def test_sanitize_function_targets(spark):
    df = spark.createDataFrame([("`loginUser()`",), ("def load it",), ("N/A",)], "t string")
    got = [r[0] for r in df.select(A.sanitize_target(F.col("t"), F.lit("FUNCTION"))).collect()]
    assert got == ["loginUser", "it", None]


def test_sanitize_file_targets(spark):
    df = spark.createDataFrame([(".\\src\\a.py",), ("/src/a.py",)], "t string")
    got = [r[0] for r in df.select(A.sanitize_target(F.col("t"), F.lit("FILE"))).collect()]
    assert got == ["src/a.py", "src/a.py"]


def test_extract_json(spark):
    texts = ['```json\n{"question_type": "FILE", "target_name": "a.py"}\n```',
             'Sure! {"question_type": "FUNCTION", "target_name": "f"} hope it helps',
             "no json here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(A.extract_json_object(F.col("t")).alias("o")).collect()]
    assert got[0]["question_type"] == "FILE" and got[0]["target_name"] == "a.py"
    assert got[1]["question_type"] == "FUNCTION"
    assert got[2] is None


def test_classify_rules(spark):
    qs = [(1, "p", "What does loginUser() do?", 5), (2, "p", "Explain src/app/main.py please", 5),
          (3, "p", "Describe the architecture", 5), (4, "p", "Give me an overview", 5),
          (5, "p", "Where do we hash passwords?", 5), (6, "p", "  ", 5),
          (7, "p", "what does the parse_config function do", 5)]
    df = spark.createDataFrame(qs, "question_id long, project_id string, question string, top_k int")
    got = {r.question_id: (r.question_type, r.target_name, r.error is not None)
           for r in A.classify_rules(df).collect()}
    assert got[1] == ("FUNCTION", "loginUser", False)
    assert got[2] == ("FILE", "src/app/main.py", False)
    assert got[3][0] == "ARCHITECTURE" and got[4][0] == "PROJECT_OVERVIEW"
    assert got[5][0] == "SEMANTIC_SEARCH"
    assert got[6] == (None, None, True)
    assert got[7] == ("FUNCTION", "parse_config", False)


def test_classify_with_model(spark):
    answers = {"q1": json.dumps({"question_type": "function", "target_name": "`run()`"}),
               "q2": "I think {\"question_type\": \"BOGUS\"}", "q3": "nothing"}

    def fake(prompts):
        return [answers[p] for p in prompts]

    df = spark.createDataFrame([(1, "p", "q1", 5), (2, "p", "q2", 5), (3, "p", "q3", 5), (4, "p", " ", 5)],
                               "question_id long, project_id string, question string, top_k int")
    got = {r.question_id: r for r in A.classify_with_model(df, fake, lambda q: q).collect()}
    assert got[1].question_type == "FUNCTION" and got[1].target_name == "run" and got[1].error is None
    assert got[2].question_type is None and "BOGUS" in got[2].error
    assert got[3].error is not None and got[4].error is not None


def test_parse_numbered(spark):
    df = spark.createDataFrame([("p", 1, 2, "[1] a\njunk\n[2] b\n[1] c"), ("p", 2, 2, "[1]\n[2] x")],
                               "project_id string, batch_no int, n int, response string")
    parsed = {(r.batch_no, r.idx): r.text for r in R.parse_numbered(df).collect()}
    assert parsed[(1, 1)] == "c" and parsed[(1, 2)] == "b"
    assert parsed[(2, 1)] == "[2] x"
    missing = {(r.batch_no, r.pos) for r in R.missing_positions(df, R.parse_numbered(df), "function").collect()}
    assert missing == {(2, 2)}


def test_parse_project_answer(spark):
    df = spark.createDataFrame([("p", "SUMMARY: old\nSUMMARY:  new one \nTECHNOLOGIES: Py, , Spark\nFEATURES: a")],
                               "project_id string, response string")
    r = R.parse_project_answer(df).collect()[0]
    assert r.summary == "new one" and r.main_technologies == ["Py", "Spark"] and r.main_features == ["a"]


def test_provider_resolution(monkeypatch):
    assert isinstance(N.resolve_provider(" ECHO "), N.EchoModel)
    monkeypatch.setenv("CODEWEAVE_PROVIDER", "echo")
    assert isinstance(N.resolve_provider(None), N.EchoModel)
    with pytest.raises(ValueError):
        N.resolve_provider("nope")
