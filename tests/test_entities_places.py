"""Entities by place: several on a line, bodies that are expressions, arrows
inside calls, C++ declarators, several imports on a line."""

import pytest

from codeweave.operators.entities import extract_entities
from codeweave.operators.files import files_from_paths

CASES = {
    "min.js": "function a(){x()} function b(){y()} z();",
    "multi.java": "import a.B; import c.D;\nimport static e.F.g;\nimport h.*;\nclass X {\n  int f() { return g(); } int h() { return k(); }\n}\n",
    "body.js": "const m = 1;\nfunction big(\n  a,\n  b) { return m(a); }\ninit();\nconst s = rows.reduce((x) => ({\n  a: f(x),\n}));\n"
               "function later() { bar(); }\n",
    "body.java": "class A {\n  int big(\n    int a,\n    int b\n  ) { return m(a); }\n  void init() { bar(); }\n}\n",
    "expr.js": "const view = (p) => (\n  h(p)\n);\nconst sum = a => a\n  + g(a)\nconst list = x => [\n  one(x),\n  two(x)\n], other = y =>\n"
               "  three(y);\nconst nest = a => b => c => deep(a, b, c);\nfour();\n",
    "wrap.js": "const getUser = asyncHandler(async (req, res) => {\n  send(res);\n});\nconst ids = rows.map(r => pick(r));\n"
               "const { data, error } = useQuery(() => fetchIt());\nlist.forEach(q => show(q));\n"
               "const outer = () => {\n  items.forEach((i) => visit(i));\n  const inner = () => deep();\n};\nexports.save = (x) => store(x);\n"
               "function f(a = () => dflt(), b = 2) { body(); }\n",
    "a.cpp": "#include <v>\n#include \"w.h\"\nclass A : public B, public C {\n public:\n  A(int x) : x_(x), y_{one(x)} { start(); }\n  ~A() { stop(); }\n"
             "  bool operator==(const A& o) const { return same(o); }\n  A& operator=(const A&) = default;\n  int get() const noexcept;\n private:\n"
             "  int x_;\n};\n\nA::A() { init(); }\n\nunsigned long long big(int n) {\n  return n ? twice(n) : other(n);\n}\n\n"
             "template <typename T, typename U>\nstd::vector<T> A::all(std::map<T, U> m) {\n  A a(1);\n  return run(m);\n}\nstruct D;\nenum class E { p, q };\n",
    "m.py": "import a; import b\ntry: import z\nexcept ImportError: z = None\nif x: from y.q import w\nimport os as o, sys\nfrom . import (\n  k,\n)\n"
            "def f(): return g()\nx = h(1)\n",
    "m.js": 'import a from "a"; import b from \'b\';\nimport {\n  c, d\n} from "./c"\nimport "side"\nconst lazy = import("./no");\n',
    "asi.js": "const a = () => one()\nconst b = function () { return two() }\nlet c = x =>\n  x.map(y => three(y))\n   .filter(four)\n\nfive()\n"
              "class K {\n  handle = (e) => { six(e) }\n  static async run() {\n    seven()\n  }\n  get size() { return eight() }\n}\n",
    "types.js": "export async function load(id: string, opts: { a: number }): Promise<void> {\n  await go(id);\n}\n"
                "export const pick = (a: string): string => trim(a);\n",
    "tpl.js": "const s = (n) => `a ${bar(n)} no(3) ${`x`} ${baz({a: 1})}`;\nconst t = `${one(1)}`; function g(a = \"x, (\", b) { two(`)`); }\n",
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


def test_callers_on_one_line(ent):
    assert of(ent, "calls", "min.js", "caller", "callee") == [("a", "x"), ("b", "y"), (None, "z")]
    assert of(ent, "calls", "multi.java", "caller", "callee") == [("f", "g"), ("h", "k")]
    assert of(ent, "classes", "multi.java", "name", "methods") == [("X", ["f", "h"])]


def test_bodies_that_close_on_the_last_line_of_a_signature(ent):
    assert of(ent, "functions", "body.js", "name", "line", "end_line") == [("big", 2, 4), ("s", 6, 8), ("later", 9, 9)]
    assert of(ent, "calls", "body.js", "caller", "callee") == [
        ("big", "m"), (None, "init"), (None, "reduce"), ("s", "f"), ("later", "bar")]
    assert of(ent, "functions", "body.java", "name", "line", "end_line") == [("big", 2, 5), ("init", 6, 6)]
    assert of(ent, "calls", "body.java", "caller", "callee") == [("big", "m"), ("init", "bar")]


def test_expressions_end_where_they_end(ent):
    assert of(ent, "functions", "expr.js", "name", "line", "end_line") == [
        ("view", 1, 3), ("sum", 4, 5), ("list", 6, 9), ("other", 9, 10), ("nest", 11, 11), ("nest", 11, 11), ("nest", 11, 11)]
    assert of(ent, "calls", "expr.js", "caller", "callee") == [
        ("view", "h"), ("sum", "g"), ("list", "one"), ("list", "two"), ("other", "three"), ("nest", "deep"), (None, "four")]
    assert of(ent, "functions", "asi.js", "name", "line", "end_line") == [
        ("a", 1, 1), ("c", 3, 5), ("c", 4, 4), ("run", 10, 12), ("size", 13, 13)]
    assert of(ent, "calls", "asi.js", "caller", "callee") == [
        ("a", "one"), (None, "two"), ("c", "map"), ("c", "three"), ("c", "filter"), (None, "five"), (None, "six"),
        ("run", "seven"), ("size", "eight")]


def test_arrows_take_the_name_of_their_declarator(ent):
    assert of(ent, "functions", "wrap.js", "name", "line", "parameters") == [
        ("getUser", 1, ["req", "res"]), ("ids", 4, []), ("{ data, error }", 5, []), ("outer", 7, []), ("outer", 8, ["i"]),
        ("inner", 9, []), ("f", 12, ["a = () => dflt()", "b = 2"])]
    assert of(ent, "calls", "wrap.js", "caller", "callee") == [
        (None, "asyncHandler"), ("getUser", "send"), (None, "map"), ("ids", "pick"), (None, "useQuery"),
        ("{ data, error }", "fetchIt"), (None, "forEach"), (None, "show"), ("outer", "forEach"), ("outer", "visit"),
        ("inner", "deep"), (None, "store"), ("f", "dflt"), ("f", "body")]


def test_cpp_declarators(ent):
    assert of(ent, "functions", "a.cpp", "name", "line", "end_line", "parameters") == [
        ("A", 5, 5, ["int x"]), ("~A", 6, 6, []), ("operator==", 7, 7, ["const A& o"]), ("operator=", 8, 8, ["const A&"]),
        ("A", 14, 14, []), ("big", 16, 18, ["int n"]), ("all", 21, 24, ["std::map<T, U> m"])]
    assert of(ent, "classes", "a.cpp", "name", "line", "end_line", "methods") == [("A", 3, 12, ["A", "~A", "operator==", "operator="])]
    assert of(ent, "calls", "a.cpp", "caller", "callee") == [
        ("A", "one"), ("A", "start"), ("~A", "stop"), ("operator==", "same"), ("A", "init"), ("big", "twice"), ("big", "other"),
        ("all", "run")]
    assert of(ent, "imports", "a.cpp", "module", "line") == [("v", 1), ("w.h", 2)]


def test_imports_are_statements(ent):
    assert of(ent, "imports", "m.py", "module", "line") == [("a", 1), ("b", 1), ("z", 2), ("y.q", 4), ("sys", 5), (".", 6)]
    assert of(ent, "calls", "m.py", "caller", "callee") == [("f", "g"), (None, "h")]
    assert of(ent, "imports", "multi.java", "module", "line") == [("a.B", 1), ("c.D", 1), ("e.F.g", 2), ("import h.*;", 3)]
    assert of(ent, "imports", "m.js", "module", "line") == [("a", 1), ("b", 1), ("./c", 2), ("side", 5)]


def test_types_and_templates(ent):
    assert of(ent, "functions", "types.js", "name", "line", "end_line", "parameters") == [
        ("load", 1, 3, ["id: string", "opts: { a: number }"]), ("pick", 4, 4, ["a: string"])]
    assert of(ent, "calls", "types.js", "caller", "callee") == [("load", "go"), ("pick", "trim")]
    assert of(ent, "functions", "tpl.js", "name", "parameters") == [("s", ["n"]), ("g", ['a = "x, ("', "b"])]
    assert of(ent, "calls", "tpl.js", "caller", "callee") == [("s", "bar"), ("s", "baz"), (None, "one"), ("g", "two")]
