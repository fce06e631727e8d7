"""Goldens for the line-rule entity extraction."""

import pytest

from codeweave.operators.entities import extract_entities
from codeweave.operators.files import files_from_paths


def make_files(spark, items):
    df = spark.createDataFrame([("p", path, path, code) for path, code in items],
                               "project_id string, file_path string, rel_path string, content string")
    return files_from_paths(df)


@pytest.fixture(scope="module")
def ents(spark):
    py = "\n".join([
        "import a, b",
        "import a as b",
        "from ..x import y",
        "",
        "def outer(",
        "    a,",
        "    b: int = 2,",
        ") -> int:",
        "    def inner(c):",
        "        return helper(c)",
        "    return inner(a)",
        "",
        "TEXT = '''",
        "def not_a_function():",
        "'''",
        "",
        "class K(Base):",
        "    def m(self, *args, **kw):",
        "        self.go(1).done()",
        "",
        "outer(1)",
    ])
    js = "\n".join([
        "import { q } from './m';",
        "const add = (a, b) => {",
        "  return sum(a, b);",
        "};",
        "function top(x) { return x; }",
        "class W {",
        "  run(v) {",
        "    return this.add(v);",
        "  }",
        "}",
    ])
    cpp = "\n".join(['#include <v.h>', '#include "w.hpp"', "int main(int argc, char** argv) {",
                     "  return run(argc);", "}"])
    java = "\n".join(["import java.util.List;", "class A {", "  public int f(int x) {", "    return g(x);",
                      "  }", "}"])
    files = make_files(spark, [("a.py", py), ("b.js", js), ("c.cpp", cpp), ("D.java", java)])
    return extract_entities(files)


def by_file(df, path):
    return sorted([r.asDict() for r in df.where(df.file_path == path).collect()], key=lambda r: r["ord"])


def test_python_functions(ents):
    f = by_file(ents.functions, "a.py")
    assert [(x["name"], x["line"], x["end_line"]) for x in f] == [
        ("outer", 5, 11), ("inner", 9, 10), ("m", 18, 19)]
    assert f[0]["parameters"] == ["a", "b: int = 2"]
    assert f[2]["parameters"] == ["self", "*args", "**kw"]


def test_python_class_and_methods(ents):
    c = by_file(ents.classes, "a.py")
    assert [(x["name"], x["line"], x["end_line"], x["methods"]) for x in c] == [("K", 17, 19, ["m"])]


def test_python_imports(ents):
    i = by_file(ents.imports, "a.py")
    assert [x["module"] for x in i] == ["a", "import a as b", "..x"]


def test_python_calls(ents):
    k = by_file(ents.calls, "a.py")
    got = [(x["caller"], x["callee"], x["line"]) for x in k]
    assert ("inner", "helper", 10) in got
    assert ("outer", "inner", 11) in got
    assert ("m", "go", 19) in got and ("m", "done", 19) in got
    assert (None, "outer", 21) in got
    assert all(x[1] != "Base" for x in got)


def test_js(ents):
    f = by_file(ents.functions, "b.js")
    assert [(x["name"], x["line"], x["end_line"]) for x in f] == [("add", 2, 4), ("top", 5, 5), ("run", 7, 9)]
    assert [x["module"] for x in by_file(ents.imports, "b.js")] == ["./m"]
    assert by_file(ents.classes, "b.js")[0]["methods"] == ["run"]


def test_cpp_and_java(ents):
    assert [x["module"] for x in by_file(ents.imports, "c.cpp")] == ["v.h", "w.hpp"]
    assert [(x["name"], x["line"], x["end_line"]) for x in by_file(ents.functions, "c.cpp")] == [("main", 3, 5)]
    assert [(x["name"], x["line"], x["end_line"]) for x in by_file(ents.functions, "D.java")] == [("f", 3, 5)]
    calls = [(x["caller"], x["callee"]) for x in by_file(ents.calls, "D.java")]
    assert calls == [("f", "g")]
