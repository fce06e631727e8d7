import numpy as np
"""Goldens for the column-expression helpers (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from codeweave.functions import paths as P
from codeweave.functions import text as X


def one(spark, col, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(col(F.col("v")).alias("o")).collect()[0][0]


def test_normpath(spark):
    assert one(spark, P.normpath, "a/./b//c") == "a/b/c"
    assert one(spark, P.normpath, "a/../../x") == "../x"
    assert one(spark, P.normpath, "src/m1/../m2/doc") == "src/m2/doc"
    assert one(spark, P.normpath, "") == "."
    assert one(spark, P.normpath, "/a/../../b") == "/b"


def test_drop_suffix_and_suffix(spark):
    assert one(spark, P.drop_suffix, "src/user.controller.js") == "src/user.controller"
    assert one(spark, P.drop_suffix, "src/.env") == "src/.env"
    assert one(spark, P.suffix, "a/b.tar.gz") == ".gz"
    assert one(spark, P.suffix, ".bashrc") == ""


def test_basename_dirname(spark):
    assert one(spark, P.basename, "a/b/c.py") == "c.py"
    assert one(spark, P.dirname, "a/b/c.py") == "a/b"
    assert one(spark, P.dirname, "c.py") == ""


def test_suffix_keys(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "p array<string>")
    assert df.select(P.suffix_keys(F.col("p"), ".")).collect()[0][0] == ["b.c", "c"]


def test_slug(spark):
    assert one(spark, X.slug, "__a b/c.py_") == "a_b_c_py"


def test_split_lines_and_slice(spark):
    assert one(spark, X.split_lines, "a\nb\n") == ["a", "b"]
    assert one(spark, X.split_lines, "a\r\n\nb") == ["a", "", "b"]
    assert one(spark, X.split_lines, "") == []
    df = spark.createDataFrame([("1\n2\n3\n4\n5",)], "t string")
    arr = X.split_lines(F.col("t"))
    got = df.select(X.slice_lines(arr, F.lit(0), F.lit(2)), X.slice_lines(arr, F.lit(3), F.lit(2)),
                    X.slice_lines(arr, F.lit(6), F.lit(7)), X.slice_lines(arr, F.lit(4), F.lit(10))).collect()[0]
    assert tuple(got) == (None, None, None, "4\n5")


def test_truncate(spark):
    text = "\n".join(str(i) for i in range(1, 101))
    out = one(spark, X.truncate_code, text)
    assert out.startswith("1\n2") and "... [CODE TRUNCATED] ..." in out and out.endswith("100")
    assert out.split("\n\n... [CODE TRUNCATED] ...\n\n")[1].split("\n")[0] == "71"
    assert one(spark, X.truncate_code, "a\nb") == "a\nb"


def test_py_strip(spark):
    assert one(spark, X.py_strip, " \t\n x y \n") == "x y"


def test_url_parts(spark):
    assert one(spark, X.url_owner, "https://github.com/own/repo.git/") == "own"
    assert one(spark, X.url_repo_name, "https://github.com/own/repo.git/") == "repo"


def test_decode(spark):
    from codeweave.operators.files import decode_lenient, decode_strict
    df = spark.createDataFrame([(bytearray(b"a\xff"),)], "b binary")
    got = df.select(decode_strict(F.col("b")), decode_lenient(F.col("b"))).collect()[0]
    assert got[0] is None and got[1] == "a"


def test_score_rounding(spark):
    from codeweave.operators.vectors import score
    df = spark.createDataFrame([(-0.2,), (0.123456,)], "s double")
    assert [r[0] for r in df.select(score(F.col("s"))).collect()] == [0.0, 0.1235]


def test_hashing_tf_embedding(spark):
    """K1 JVM variant (Spark ML): unit vectors of the requested dimension."""
    from codeweave.operators.vectors import embed_hashing_tf
    df = spark.createDataFrame([(1, "def load_user(uid): return db.get(uid)"), (2, "")], "id int, t string")
    out = {r.id: r.embedding for r in embed_hashing_tf(df, "t", dim=64).collect()}
    assert len(out[1]) == 64 and abs(sum(x * x for x in out[1]) - 1.0) < 1e-9
    assert sum(out[2]) == 0.0


def test_search_passes(spark):
    """Many small passes over many partitions give what one pass gives; ties go by id and
    at most top_k rows per question and task leave the scoring."""
    import codeweave.operators.vectors as V
    vec = spark.createDataFrame([(f"p{i % 2}", f"c{i:02}", [float(i % 7), 1.0, float(i % 3)]) for i in range(60)],
                                "project_id string, id string, embedding array<double>")
    qs = spark.createDataFrame([(j, f"p{j % 2}", 1 + j % 6, [1.0, float(j % 4), 0.5]) for j in range(25)],
                               "question_id long, project_id string, top_k int, qvec array<double>")
    one = sorted(map(tuple, V.search(qs, vec, unit_vectors=False).collect()))
    want = []
    for j in range(25):
        q = np.array([1.0, float(j % 4), 0.5])
        scored = []
        for i in range(j % 2, 60, 2):
            v = np.array([float(i % 7), 1.0, float(i % 3)])
            scored.append((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 4), f"c{i:02}"))
        want += [(j, c, -s, r + 1) for r, (s, c) in enumerate(sorted(scored)[:1 + j % 6])]
    assert one == sorted(want)
    assert sorted(map(tuple, V.search(qs, vec.repartition(9), unit_vectors=False, most=4).collect())) == one
    zero = vec.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    scored = V._score_in_place(qs, zero.repartition(6), "qvec", "embedding", "id", False, 100).groupBy("question_id").count()
    assert scored.join(qs, "question_id").where("count > top_k * 6").count() == 0 and scored.count() == 25


def test_dedupe_records(spark):
    from codeweave.operators.vectors import dedupe_records
    df = spark.createDataFrame([("p", "p::a_b_py_file", "a/b.py", 1, "x"), ("p", "p::a_b_py_file", "a_b.py", 1, "y"),
                                ("p", "p::c", "c.py", 2, "z")],
                               "project_id string, id string, file_path string, line int, name string")
    kept, dups = dedupe_records(df)
    assert sorted((r.id, r.file_path) for r in kept.collect()) == [("p::a_b_py_file", "a/b.py"), ("p::c", "c.py")]
    assert [(r.id, r.file_path) for r in dups.collect()] == [("p::a_b_py_file", "a_b.py")]
    same = df.unionAll(df.where("id = 'p::c'")).unionAll(df.withColumn("project_id", F.lit("other")))
    kept, dups = dedupe_records(same)
    assert kept.count() == 4 and dups.count() == 3  # equal rows are repeats, equal ids of two projects are not


def test_infer_passes_budget_model_and_key(spark):
    from codeweave.operators.infer import infer, resolve_model
    df = spark.createDataFrame([("a", 500), ("b", 700)], "prompt string, max_tokens int")

    def model(prompts, max_tokens, model, api_key=None):
        return [f"{p}/{n}/{model}/{api_key}" for p, n in zip(prompts, max_tokens)]
    got = sorted(r.response for r in infer(df, model, "prompt", max_tokens_col="max_tokens", model="m", api_key="k").collect())
    assert got == ["a/500/m/k", "b/700/m/k"]
    assert sorted(r.response for r in infer(df, lambda p: p, "prompt", max_tokens_col="max_tokens", model="m").collect()) == ["a", "b"]
    import os
    os.environ["CODEWEAVE_MODEL"] = "env"
    try:
        assert resolve_model() == "env" and resolve_model("echo") is None and resolve_model("echo", "x") == "x"
    finally:
        del os.environ["CODEWEAVE_MODEL"]
