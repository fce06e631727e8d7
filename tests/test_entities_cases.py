"""Entities of code that is not laid out one definition per line, and of very
long literals and lines."""

import pytest

from codeweave.operators.entities import extract_entities
from codeweave.operators.files import files_from_paths

CASES = {
    "strings.js": 'const a = "' + "x" * 100_000 + '";\nconst b = "' + r"\n\"" * 20_000 + '";\nfunction one() { two(); }',
    "glob.js": "function one() {\n  a();\n}\n// glob src/**/*.js\nfunction two() {\n  b();\n}\n"
               "const re = /[\"'`]/g; /* x */ class K {\n  run() { c(); }\n}\n*/\nfunction three() { d(); }",
    "quote.py": 'def f():\n    g()\n    # a """ in a comment\n    return 1\n\ndef g():\n    h("it\'s # not")\n',
    "callees.js": 'fetch(u).then(ok).catch(err); Array.from(xs); db.delete(k); if (x) { catch_it(); }',
    "holes.py": 'def f():\n    return f"{foo(1)} and {bar(x)} {{no(1)}}" + "no(2)"\n',
    "holes.js": "const s = `a ${bar(2)} no(3) ${`x`} ${baz({a: 1})}`;\n",
    "imports.js": 'import {\n  a,\n  b\n} from "./util";\nimport x from "./x";\nimport "./side";\nimport {\n c } from \'./c\';\n',
    "arrows.js": "export const load = async (\n  a,\n  b = {x: 1}\n) => {\n  go();\n};\nconst sum = (\n  1 +\n  2\n);\n"
                 "const View = ({\n  p,\n  q\n}) => {\n  show();\n};\nconst id = x => x;\n",
    "minified.js": "function a(){x()} function b(){y()} function c(){z()} class P{m(){w()}n(q){v()}}",
    "deep.py": 'def f(a, b=g(h(i(j(k(l(m(n(1)))))))), c=(1, [2, {"x, y": ")"}]), *d, e="a,b)"):\n    pass\n'
               'def t(\n    a,  # first, one\n    b: str = "x(",\n) -> int:\n    return 1\n',
    "Gen.java": 'class Gen {\n  Map<String, List<Integer>> m(Map<String, Integer> a, int b) {\n    return x(a);\n  }\n'
                '  int one() { return 1; } int two(int q) { return p(q); }\n  String s = "/*";\n  void last() { z(); }\n}\n',
    "raw.cpp": '#include <v.h>\nint main() {\n  auto s = R"x(no(1) ")x";\n  int n = 1\'000;\n  return go(s);\n}\n',
    "many.js": "\n".join("f(" + ");f(".join("1" for _ in range(5000)) + ")" for _ in range(2)),
    "long.js": "function big(a,b){return " + "+".join("h(a)" for _ in range(3000)) + "}" + "var q='" + "y" * 900_000 + "';",
}


@pytest.fixture(scope="module")
def ent(spark):
    rows = [("p", name, name, text) for name, text in CASES.items()]
    files = files_from_paths(spark.createDataFrame(rows, "project_id string, file_path string, rel_path string, content string"))
    e = extract_entities(files)
    return {k: [r.asDict() for r in getattr(e, k).orderBy("file_path", "ord").collect()]
            for k in ("functions", "classes", "imports", "calls")}


def of(ent, kind, name, *columns):
    rows = [r for r in ent[kind] if r["file_path"] == name]
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows]


def test_long_literals_and_lines(ent):
    assert of(ent, "functions", "strings.js", "name", "line") == [("one", 3)]
    assert of(ent, "calls", "strings.js", "caller", "callee") == [("one", "two")]
    assert of(ent, "functions", "long.js", "name", "parameters") == [("big", ["a", "b"])]
    assert len(of(ent, "calls", "long.js", "callee")) == 3000
    assert len(of(ent, "calls", "many.js", "callee")) == 10_000


def test_comments_hide_nothing_but_themselves(ent):
    assert of(ent, "functions", "glob.js", "name", "line", "end_line") == [
        ("one", 1, 3), ("two", 5, 7), ("run", 9, 9), ("three", 12, 12)]
    assert of(ent, "classes", "glob.js", "name", "line", "end_line", "methods") == [("K", 8, 10, ["run"])]
    assert of(ent, "calls", "glob.js", "callee") == ["a", "b", "c", "d"]
    assert of(ent, "functions", "quote.py", "name", "line", "end_line") == [("f", 1, 4), ("g", 6, 7)]
    assert of(ent, "calls", "quote.py", "caller", "callee") == [("f", "g"), ("g", "h")]
    assert of(ent, "functions", "Gen.java", "name")[-1] == "last"


def test_callees(ent):
    assert of(ent, "calls", "callees.js", "callee") == ["fetch", "then", "catch", "from", "delete", "catch_it"]
    assert of(ent, "calls", "holes.py", "callee") == ["foo", "bar"]
    assert of(ent, "calls", "holes.js", "callee") == ["bar", "baz"]
    assert of(ent, "calls", "raw.cpp", "caller", "callee") == [("main", "go")]


def test_imports_over_lines(ent):
    assert of(ent, "imports", "imports.js", "module", "line") == [("./util", 1), ("./x", 5), ("./side", 6), ("./c", 7)]
    assert of(ent, "imports", "raw.cpp", "module") == ["v.h"]


def test_several_definitions_on_a_line(ent):
    assert sorted(of(ent, "functions", "minified.js", "name")) == ["a", "b", "c", "m", "n"]
    assert of(ent, "classes", "minified.js", "name") == ["P"]
    assert [n for n in of(ent, "functions", "Gen.java", "name")] == ["m", "one", "two", "last"]


def test_arrows_and_parameters(ent):
    assert of(ent, "functions", "arrows.js", "name", "line", "end_line") == [("load", 1, 6), ("View", 11, 16), ("id", 17, 17)]
    assert of(ent, "calls", "arrows.js", "caller", "callee") == [("load", "go"), ("View", "show")]
    assert of(ent, "functions", "arrows.js", "parameters")[0] == ["a", "b = {x: 1}"]
    deep = of(ent, "functions", "deep.py", "parameters")
    assert deep[0] == ["a", "b=g(h(i(j(k(l(m(n(1))))))))", 'c=(1, [2, {"x, y": ")"}])', "*d", 'e="a,b)"']
    assert len(deep[1]) == 2 or deep[1][0] == "a"
    assert of(ent, "functions", "Gen.java", "parameters")[0] == ["Map<String, Integer> a", "int b"]
