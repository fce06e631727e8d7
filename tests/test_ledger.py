"""A model is asked each prompt once, whatever happens to the tasks."""

import os

import pytest

from codeweave.operators.infer import infer


def test_a_task_that_fails_half_way_asks_nothing_twice(spark, tmp_path):
    log, broken = str(tmp_path / "asked"), str(tmp_path / "broken")
    open(broken, "w").close()
    df = spark.range(200).selectExpr("id", "concat('prompt ', id) AS prompt").coalesce(1)

    def model(prompts, max_tokens=None):
        if os.path.exists(broken) and os.path.exists(log) and len(open(log).read().splitlines()) >= 100:
            raise OSError("the model went away")
        with open(log, "a") as f:
            f.write("".join(p + "\n" for p in prompts))
        return [f"answer to {p}" for p in prompts]

    out = infer(df, model, "prompt")
    with pytest.raises(Exception, match="the model went away"):
        out.collect()
    half = open(log).read().splitlines()
    assert 90 <= len(half) < 200
    os.remove(broken)
    rows = out.select("*").collect()
    assert sorted((r.id, r.response) for r in rows) == [(i, f"answer to prompt {i}") for i in range(200)]
    asked = open(log).read().splitlines()
    assert sorted(asked) == sorted(f"prompt {i}" for i in range(200)), "each prompt once"
    assert out.select("id", "response").count() == 200 and len(open(log).read().splitlines()) == 200, "a second action asks nothing"


def test_budgets_and_nulls_are_part_of_the_prompt(spark):
    df = spark.createDataFrame([(1, "p", 5), (2, "p", 6), (3, "p", 5), (4, None, 5)], "id long, prompt string, n int")
    out = infer(df, lambda prompts, max_tokens: [f"{p}/{t}" for p, t in zip(prompts, max_tokens)], "prompt", max_tokens_col="n")
    assert sorted((r.id, r.response) for r in out.collect()) == [(1, "p/5"), (2, "p/6"), (3, "p/5"), (4, "None/5")]
