"""Batch numbering without a per-project window (F1)."""

from codeweave.operators.rollup import group_offsets, number_batches


def test_group_offsets_hot_project(spark):
    rows = [("hot", f"f{i:05d}", (i % 7) + 1) for i in range(3000)] + \
           [("cold", f"g{i:03d}", 2) for i in range(40)]
    per = spark.createDataFrame(rows, "project_id string, file_path string, _n int").repartition(16)
    off = {(r.project_id, r.file_path): (r._off, r._total) for r in group_offsets(per, "file_path").collect()}
    for proj in ("hot", "cold"):
        files = sorted((f, n) for p, f, n in rows if p == proj)
        total = sum(n for _, n in files)
        run = 0
        for f, n in files:
            assert off[(proj, f)] == (run, total)
            run += n


def test_number_batches(spark):
    items = spark.createDataFrame([("p", f"f{i // 3}", i % 3) for i in range(25)],
                                  "project_id string, file_path string, ord int")
    nb = {(r.file_path, r.ord): (r.batch_no, r.pos, r.n_batches, r.batch_count)
          for r in number_batches(items, size=10).collect()}
    assert nb[("f0", 0)] == (1, 1, 3, 10)
    assert nb[("f3", 0)] == (1, 10, 3, 10)
    assert nb[("f8", 0)] == (3, 5, 3, 5)
