"""Print the formatted physical plans of the main operators.

    python tools/show_plans.py [sf_dir] [name ...]

names: features, resolve_calls, resolve_imports, call_nodes, chunks, search
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("/")]
    from codeweave.operators import chunks as CH
    from codeweave.operators import graphs as G
    from codeweave.operators import resolve as R
    from codeweave.operators.lines import file_lines, line_features, partition_files
    from codeweave.operators.vectors import search
    from codeweave.plans.corpus import corpus
    from codeweave.plans.queries import _embedding_store_rows, _question_vectors
    from codeweave.session import get_spark
    spark = get_spark()
    c = corpus(spark, sf_dir)
    files = c.files.select("project_id", "file_path")
    plans = {
        "features": lambda: line_features(file_lines(partition_files(
            c.files.select("project_id", "file_path", "language", "content")))),
        "resolve_calls": lambda: R.resolve_calls(c.calls, c.functions),
        "resolve_imports": lambda: R.resolve_imports(c.imports, files),
        "call_nodes": lambda: G.call_graph_nodes(c.resolved_calls, c.functions),
        "chunks": lambda: CH.code_chunks(c.files, c.functions, c.classes),
        "search": lambda: search(_question_vectors(spark, sf_dir, 64), _embedding_store_rows(spark, sf_dir),
                                 unit_vectors=False),
    }
    for name, build in plans.items():
        if wanted and name not in wanted:
            continue
        print(f"===================== {name} =====================")
        build().explain("formatted")


if __name__ == "__main__":
    main()
