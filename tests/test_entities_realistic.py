"""Realistic code in the four languages: decorators, async, docstrings,
nested classes, multi-line imports, template literals, constructors,
generics, namespaces and qualified method names."""

import pytest

from codeweave.operators.entities import extract_entities
from codeweave.operators.files import files_from_paths

PY = '''import os
from typing import (
    List,
    Dict,
)

@decorator(arg=1)
async def fetch(url: str, *, timeout: int = 5) -> Dict[str, int]:
    """Fetch things.

    def fake(): not a function
    """
    async with session() as s:
        return await s.get(url, timeout=timeout)

class Outer:
    class Inner:
        def deep(self):
            pass

    def method(self, x):  # comment with ( paren
        y = [i for i in range(x)]
        return len(y)

def single(): return 1

lambda_var = lambda q: q + 1
'''

JS = '''import React, { useState } from "react";
import "./styles.css";
const api = require('./api');

export default class App extends React.Component {
  constructor(props) {
    super(props);
    this.state = { n: 0 };
  }
  async load(id) {
    const r = await api.get(`/items/${id}`);
    if (r.ok) {
      this.setState({ n: r.n });
    }
    return r;
  }
}

export const handler = async (req, res) => {
  res.json(await load(req.params.id));
};

function outer() {
  function inner() { return 1; }
  return inner();
}
'''

JAVA = '''package a.b;
import static org.junit.Assert.assertEquals;
import java.util.*;

public class Service<T> extends Base implements Api {
    private final Map<String, List<T>> cache = new HashMap<>();

    public Service(Repo repo) {
        super(repo);
    }

    @Override
    public List<T> find(String key, int limit) throws IOException {
        if (cache.containsKey(key)) {
            return cache.get(key);
        }
        return repo.query(key).limit(limit);
    }

    static <K> void helper(K k) { System.out.println(k); }
}

interface Api {
    List<String> names(int limit) throws IOException;
    void close();
}
'''

CPP = '''#include <vector>
#include "util.h"

namespace ns {
class Shape {
 public:
  virtual double area() const = 0;
  int sides() const { return n_; }
};

struct Point { int x; int y; };

static int add(int a, int b) {
  return helper(a) + b;
}

double Shape::scale(double f) {
  return area() * f;
}
}  // namespace ns
'''


def _s(items):
    return sorted(items, key=lambda t: tuple(str(x) for x in t))


def ln(src, marker):
    for i, line in enumerate(src.split("\n"), 1):
        if marker in line:
            return i
    raise AssertionError(marker)


@pytest.fixture(scope="module")
def ents(spark):
    df = spark.createDataFrame([("p", n, n, c) for n, c in
                                [("a.py", PY), ("b.js", JS), ("S.java", JAVA), ("c.cpp", CPP)]],
                               "project_id string, file_path string, rel_path string, content string")
    return extract_entities(files_from_paths(df))


def rows(df, path, *cols):
    out = [tuple(r[c] for c in cols) for r in df.where(df.file_path == path).collect()]
    return sorted(out, key=lambda t: tuple(str(x) for x in t))


def test_python(ents):
    f = rows(ents.functions, "a.py", "name", "line", "end_line")
    assert f == _s([("fetch", ln(PY, "async def fetch"), ln(PY, "return await s.get")),
                        ("deep", ln(PY, "def deep"), ln(PY, "pass")),
                        ("method", ln(PY, "def method"), ln(PY, "return len(y)")),
                        ("single", ln(PY, "def single"), ln(PY, "def single"))])
    c = rows(ents.classes, "a.py", "name", "line", "end_line", "methods")
    assert c == [("Inner", ln(PY, "class Inner"), ln(PY, "pass"), ["deep"]),
                 ("Outer", ln(PY, "class Outer"), ln(PY, "return len(y)"), ["method"])]
    assert rows(ents.imports, "a.py", "module", "line") == [("os", 1), ("typing", 2)]
    calls = rows(ents.calls, "a.py", "caller", "callee")
    assert (None, "decorator") in [(c[0], c[1]) for c in calls]
    for pair in [("fetch", "session"), ("fetch", "get"), ("method", "range"), ("method", "len")]:
        assert pair in calls
    assert all(c[1] not in ("fake", "Dict", "lambda") for c in calls)
    params = {r["name"]: r["parameters"] for r in ents.functions.where("file_path = 'a.py'").collect()}
    assert params["fetch"] == ["url: str", "*", "timeout: int = 5"]


def test_javascript(ents):
    f = rows(ents.functions, "b.js", "name", "line", "end_line")
    assert f == _s([("constructor", ln(JS, "constructor(props)"), ln(JS, "this.state") + 1),
                        ("load", ln(JS, "async load"), ln(JS, "return r;") + 1),
                        ("handler", ln(JS, "export const handler"), ln(JS, "res.json") + 1),
                        ("outer", ln(JS, "function outer"), ln(JS, "return inner();") + 1),
                        ("inner", ln(JS, "function inner"), ln(JS, "function inner"))])
    assert rows(ents.classes, "b.js", "name", "methods") == [("App", ["constructor", "load"])]
    assert rows(ents.imports, "b.js", "module") == [("./styles.css",), ("react",)]
    calls = rows(ents.calls, "b.js", "caller", "callee")
    for pair in [(None, "require"), ("constructor", "super"), ("load", "get"), ("load", "setState"),
                 ("handler", "json"), ("handler", "load"), ("outer", "inner")]:
        assert pair in calls, pair


def test_java(ents):
    f = rows(ents.functions, "S.java", "name", "line", "end_line")
    assert f == _s([("Service", ln(JAVA, "public Service(Repo"), ln(JAVA, "super(repo)") + 1),
                        ("find", ln(JAVA, "public List<T> find"), ln(JAVA, "repo.query") + 1),
                        ("helper", ln(JAVA, "static <K>"), ln(JAVA, "static <K>")),
                        ("names", ln(JAVA, "List<String> names"), ln(JAVA, "List<String> names")),
                        ("close", ln(JAVA, "void close()"), ln(JAVA, "void close()"))])
    assert rows(ents.classes, "S.java", "name", "methods") == [("Service", ["Service", "find", "helper"])]
    assert rows(ents.imports, "S.java", "module") == [("java.util",), ("org.junit.Assert.assertEquals",)]
    calls = rows(ents.calls, "S.java", "caller", "callee")
    for pair in [("find", "containsKey"), ("find", "get"), ("find", "query"), ("find", "limit"),
                 ("helper", "println")]:
        assert pair in calls, pair
    assert all(c[1] not in ("super", "HashMap") for c in calls)


def test_cpp(ents):
    f = rows(ents.functions, "c.cpp", "name", "line", "end_line")
    assert f == _s([("sides", ln(CPP, "int sides"), ln(CPP, "int sides")),
                        ("add", ln(CPP, "static int add"), ln(CPP, "return helper") + 1),
                        ("scale", ln(CPP, "Shape::scale"), ln(CPP, "return area()") + 1)])
    assert rows(ents.classes, "c.cpp", "name", "line", "end_line", "methods") == [
        ("Point", ln(CPP, "struct Point"), ln(CPP, "struct Point"), []),
        ("Shape", ln(CPP, "class Shape"), ln(CPP, "};"), ["sides"])]
    assert rows(ents.imports, "c.cpp", "module") == [("util.h",), ("vector",)]
    calls = rows(ents.calls, "c.cpp", "caller", "callee")
    assert ("add", "helper") in calls and ("scale", "area") in calls
