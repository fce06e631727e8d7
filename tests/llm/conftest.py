import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, rid string, _rid string, kept string, score string, "
          "key string, n string, bucket string, topic string, n_tokens string")


@pytest.fixture(scope="session")
def make(spark):
    """Documents with further columns whose names clash with inner ones."""
    def table(rows):
        return spark.createDataFrame(
            [(d, t, "en", f"src{i % 3}", "x", "x", "x", "x", "x", "x", "x", "x", "x") for i, (d, t) in enumerate(rows)],
            SCHEMA)
    return table


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def some(n, seed):
        r = random.Random(seed)
        return [r.choice(vocabulary) for _ in range(n)]
    return some


@pytest.fixture(scope="session")
def corpus(words):
    """Rows of many kinds: copies, near copies, shared passages, odd white
    space, empty, null, short, long, repeated ids."""
    rng = random.Random(9)
    passage = words(80, "p")
    rows = [(None, "no id at all"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "One  two"),
            (7, "one two three"), (8, "ONE two three"), (9, "x\x1cy\x85z\xa0q"), (10, "a b " * 400), (11, "ab" * 700)]
    for i in range(20, 60):
        text = words(rng.randint(1, 160), i)
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            near = list(text)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = "edit"
            rows.append((i + 100, ("\n" if i % 2 else "  ").join(near)))
        if i % 4 == 0:
            rows.append((i + 200, " ".join(words(30, -i) + passage + words(20, i * 7))))
        if i % 10 == 0:
            rows.append((i, " ".join(text)))
    rows.append((900, " ".join(words(30_000, 900))))
    rng.shuffle(rows)
    return rows
