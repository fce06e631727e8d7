"""Unit tests of the window helpers behind block extents and callers."""

from codeweave.operators.lines import innermost_enclosing, next_close
from codeweave.sources.store import spread


def test_next_close_same_level(spark):
    opens = spark.createDataFrame([("p", "f", 0, 1, 10), ("p", "f", 1, 2, 20), ("p", "f", 0, 6, 30)],
                                  "project_id string, file_path string, level int, line int, open_id long")
    closes = spark.createDataFrame([("p", "f", 1, 4, 4), ("p", "f", 0, 5, 5), ("p", "f", 0, 8, 8),
                                    ("p", "f", 0, 6, 99)],
                                   "project_id string, file_path string, level int, line int, close_at int")
    got = {r.open_id: r.close_at for r in next_close(opens, closes).collect()}
    # a close on the opening line itself never closes that block
    assert got == {10: 5, 20: 4, 30: 8}


def test_innermost_enclosing(spark):
    ranges = spark.createDataFrame([("p", "f", 1, 1, 10), ("p", "f", 2, 3, 6), ("p", "f", 3, 8, 9)],
                                   "project_id string, file_path string, range_id long, line int, end_line int")
    points = spark.createDataFrame([("p", "f", 100, 4), ("p", "f", 101, 7), ("p", "f", 102, 9), ("p", "f", 103, 12),
                                    ("p", "f", 104, 3)],
                                   "project_id string, file_path string, point_id long, line int")
    got = {r.point_id: (r.range_id, r.coverage) for r in innermost_enclosing(ranges, points).collect()}
    assert got == {100: (2, 2), 101: (1, 1), 102: (3, 2), 103: (None, 0), 104: (2, 2)}


def test_spread_small_inputs(spark):
    small = spark.range(10).coalesce(1)
    assert small.rdd.getNumPartitions() == 1
    assert spread(small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
