"""Benchmark: the headline pipelines on $BENCH_SF_DIR (default sf0.1).

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each pipeline starts from the source tables, with a ``Corpus`` of its own (no
stage stored by another pipeline is read), and is forced with the ``noop`` sink
(full computation, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from codeweave.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    from codeweave.plans.corpus import Corpus

    def force(df):
        df.write.format("noop").mode("overwrite").save()

    times, extract = {}, []

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    def run_all(sf, record):
        record("load_corpus", lambda: force(Corpus(spark, sf).source_tree))

        def p1():
            c = Corpus(spark, sf)
            t0 = time.time()
            c.entities
            extract.append(round(time.time() - t0, 3))  # part of p1, and again of p2 to p4
            force(c.call_edges)
            force(c.call_nodes)
            force(c.dep_edges)
            force(c.dep_nodes)
        record("p1_graphs", p1)

        def p2():
            # index = re-index of every project in the batch (A7: dynamic
            # partition overwrite of the project partitions)
            from codeweave.sources.store import VectorStore, scratch_path
            recs = Corpus(spark, sf).chunk_records
            VectorStore(spark, scratch_path(recs, "bench-store")).replace_projects(recs)
        record("p2_index", p2)

        def p3():
            c = Corpus(spark, sf)
            force(c.contexts)
            force(c.answer_sources)
            force(c.answers)
        record("p3_ask", p3)
        record("p4_rollup", lambda: force(Corpus(spark, sf).project_summary))

        def p5():
            c = Corpus(spark, sf)
            force(c.project_info)
            force(c.modules)
        record("p5_project_info", p5)

    # warm-up: every pipeline once on the smallest data, so JVM JIT and
    # generated code are not billed to the measured run
    run_all("/root/testdata/sf0.001", lambda name, fn: fn())

    run_all(sf_dir, timed)

    total = round(sum(v for k, v in times.items()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "pipelines_total_time", "value": total, "unit": "sec",
                      "queries": times, "extract_in_p1": extract[-1], "sf": sf}))


if __name__ == "__main__":
    main()
