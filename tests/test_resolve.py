"""Goldens for project roots (E3) and module-key precedence."""

from collections import Counter

from codeweave.operators.resolve import module_key_index, project_roots


def test_project_roots(spark):
    df = spark.createDataFrame([("p1", "r/src/a/x.py"), ("p1", "r/src/b.py"), ("p2", "r/z/only.py")],
                               "project_id string, file_path string")
    got = {r.project_id: r.root for r in project_roots(df).collect()}
    assert got == {"p1": "r/src", "p2": "r/z"}


def test_module_keys_suffix_first_then_exact(spark):
    two = spark.createDataFrame([("p", "a/u.py"), ("p", "b/u.py")], "project_id string, file_path string")
    idx = {r.key: r.target for r in module_key_index(two).collect()}
    assert idx["u"] == "a/u.py"            # suffix key: first file in order
    three = two.unionByName(spark.createDataFrame([("p", "u.py")], "project_id string, file_path string"))
    idx3 = {r.key: r.target for r in module_key_index(three).collect()}
    assert idx3["u"] == "u.py"             # an exact key beats any suffix key
    assert idx3["a.u"] == "a/u.py" and idx3["b/u"] == "b/u.py"


def test_package_key(spark):
    df = spark.createDataFrame([("p", "src/pkg/__init__.py"), ("p", "src/pkg/mod.py"), ("p", "src/other.py")],
                               "project_id string, file_path string")
    idx = {r.key: r.target for r in module_key_index(df).collect()}
    assert idx["pkg"] == "src/pkg/__init__.py"
    assert idx["pkg.mod"] == "src/pkg/mod.py" and idx["src.pkg.mod"] == "src/pkg/mod.py"


def test_resolve_imports(spark):
    from codeweave.operators.resolve import resolve_imports
    files = spark.createDataFrame([("p", f) for f in [
        "src/app/main.py", "src/app/util.py", "src/pkg/__init__.py", "src/lib/helpers.py",
        "web/user.controller.js", "web/index.js", "web/db/index.js"]], "project_id string, file_path string")
    imports = spark.createDataFrame([
        ("p", "src/app/main.py", 1, ".util", 1), ("p", "src/app/main.py", 2, "..pkg", 2),
        ("p", "src/app/main.py", 3, "..lib.helpers", 3), ("p", "src/app/main.py", 4, "os", 4),
        ("p", "src/app/main.py", 5, "src.lib.helpers", 5), ("p", "src/app/main.py", 6, "lib.helpers.thing", 6),
        ("p", "src/app/util.py", 1, ".util", 1),
        ("p", "web/index.js", 1, "./user.controller", 1), ("p", "web/index.js", 2, "./db", 2)],
        "project_id string, file_path string, ord int, module string, line int")
    got = {(r.source, r.module): r.target for r in resolve_imports(imports, files).collect()}
    assert got == {
        ("src/app/main.py", ".util"): "src/app/util.py",
        ("src/app/main.py", "..pkg"): "src/pkg/__init__.py",
        ("src/app/main.py", "..lib.helpers"): "src/lib/helpers.py",
        ("src/app/main.py", "src.lib.helpers"): "src/lib/helpers.py",
        ("src/app/main.py", "lib.helpers.thing"): "src/lib/helpers.py",
        ("web/index.js", "./user.controller"): "web/user.controller.js",
        ("web/index.js", "./db"): "web/db/index.js",
    }


def test_import_paths_of_a_hot_module_go_to_all_partitions(spark, monkeypatch):
    """Partitions follow files and imports, and the rows of one module and one
    project are dealt evenly; twice given rows and nulls count as ever."""
    from pyspark.sql import functions as F
    from codeweave.operators import resolve as R
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    names = ["a.py", "sub/__init__.py", "sub/b.py"]
    paths = [f"d{i}/{name}" for i in range(300) for name in names]
    files = spark.createDataFrame([("p", f) for f in paths + paths[:3]] + [("p", None), (None, "d0/a.py")],
                                  "project_id string, file_path string")
    rows = [(f"d{i}/sub/b.py", 1, "..a", f"d{i}/a.py") for i in range(300)]
    rows += [(f"d{i}/sub/b.py", 2, "b", "d0/sub/b.py") for i in range(300)]
    rows += [(f"d{i}/sub/b.py", 3, "os", None) for i in range(300)]
    given = [("p", f, o, m, o) for f, o, m, _ in rows]
    # a row that shares file and number gets the better target, a null key gets none
    given += [given[0], ("p", "d7/sub/b.py", 1, None, 9), ("p", None, 1, ".a", 1), (None, "d0/sub/b.py", 1, "..a", 1),
              ("p", "d0/sub/b.py", None, "..a", 1)]
    imports = spark.createDataFrame(given, "project_id string, file_path string, ord int, module string, line int")
    out = R.resolve_imports(imports, files).withColumn("at", F.spark_partition_id()).collect()
    want = sorted([(f, t, m, o) for f, o, m, t in rows if t and t != f] + [("d0/sub/b.py", "d0/a.py", "..a", 1),
                                                                          ("d7/sub/b.py", "d7/a.py", "", 9)])
    assert sorted((r.source, r.target, r.module or "", r.line) for r in out) == want
    n = -(-(len(given) + 905) // 100)
    sizes = Counter(r["at"] for r in out).values()
    assert len(sizes) > n // 2 and max(sizes) < 5 * len(want) / n


def test_keys_have_the_partitions_they_are_given(spark):
    from codeweave.operators.resolve import known_file_keys, module_key_index
    files = spark.createDataFrame([("p", f"d{i}/a.py") for i in range(500)], "project_id string, file_path string")
    index, known = module_key_index(files, partitions=5), known_file_keys(files, 5)
    assert index.rdd.getNumPartitions() == known.rdd.getNumPartitions() == 5
    assert index.where("key = 'a'").first().target == "d0/a.py"
    assert index.count() == 500 * 3 + 1 and known.count() == 500 * 2
