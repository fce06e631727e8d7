"""A1/A2 over a real directory tree read with the binaryFile source."""

import os
import tempfile

from codeweave.operators.files import discover_source_files, source_files
from codeweave.sources.filesystem import read_config_files, read_corpus


def test_read_corpus(spark):
    root = tempfile.mkdtemp(prefix="cw-tree-", dir="/tmp")
    files = {
        "projA/src/app.py": "def a():\n    return b()\n",
        "projA/src/b.PY": "x = 1\n",
        "projA/node_modules/m/x.js": "function z() {}\n",
        "projA/README.md": "hello\n",
        "projB/lib/u.js": "function u(q) {\n  return q;\n}\n",
        "projB/bad.py": None,
        "projB/web/package.json": '{"dependencies": {"react": "1"}}',
        "projB/pkg/__init__.py": "", "projB/pkg/_util.py": "y = 2\n", "projB/__tests__/t.js": "t()\n",
        "projB/_internal/z.py": "z = 3\n", "projB/.gitignore": "*.pyc\n",
    }
    for rel, text in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(b"ok = '\xff'\n" if text is None else text.encode())
    df = read_corpus(spark, root)
    got = {(r.project_id, r.rel_path): r.content for r in df.collect()}
    # case-sensitive suffix: b.PY is not listed; README.md is not a source file
    assert set(got) == {("projA", "src/app.py"), ("projA", "node_modules/m/x.js"),
                        ("projB", "lib/u.js"), ("projB", "bad.py"), ("projB", "pkg/__init__.py"),
                        ("projB", "pkg/_util.py"), ("projB", "__tests__/t.js"), ("projB", "_internal/z.py")}
    assert {(r.project_id, r.rel_path) for r in read_corpus(spark, "file:" + root + "/").collect()} == set(got)
    assert got[("projB", "bad.py")] is None                      # strict decoding
    disc = {(r.project_id, r.rel_path) for r in discover_source_files(df).collect()}
    assert ("projA", "node_modules/m/x.js") not in disc
    assert {r.language for r in source_files(df).collect()} == {"Python", "JavaScript"}
    everything = read_corpus(spark, root, source_only=False, strict=False)
    assert ("projA", "README.md") in {(r.project_id, r.rel_path) for r in everything.collect()}

    cfg = {(r.project_id, r.rel_path) for r in read_config_files(spark, root).collect()}
    assert cfg == {("projB", "web/package.json")}
    from codeweave.operators.project import project_info
    info = {r.project_id: r for r in project_info(everything.select("project_id", "rel_path", "ext", "language"),
                                                   read_config_files(spark, root)).collect()}
    assert info["projB"].framework == "React" and info["projA"].has_readme and info["projB"].has_gitignore


def test_decode_lenient_keeps_a_genuine_replacement_character(spark):
    from codeweave.operators.files import decode_lenient
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("a\ufffdb".encode()),),
                                (bytearray("\ufffd".encode() + b"\xfe"),)], "b binary")
    assert [r[0] for r in df.select(decode_lenient(F.col("b"))).collect()] == ["ab", "a\ufffdb", "\ufffd"]


def test_listing_level_by_level(spark, tmp_path):
    import os

    from codeweave.sources import filesystem as FS
    for p in ("one", "two", ".hidden"):
        for d in range(30):
            folder = tmp_path / p / f"d{d % 7}" / "_x" / f"e{d}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"f{d}.py").write_text("x = 1")
            (folder / ".env").write_text("y")
    (tmp_path / "empty").mkdir()
    (tmp_path / "stray.py").write_text("in no project")
    (tmp_path / "one" / "top.py").write_text("")
    want = sorted((os.path.relpath(folder, tmp_path).split(os.sep)[0], os.path.join(folder, f),
                   os.path.relpath(os.path.join(folder, f), tmp_path).split(os.sep, 1)[1])
                  for folder, _, names in os.walk(tmp_path) for f in names if folder != str(tmp_path))
    got = FS.list_corpus(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == want
    page, FS.LIST_ROWS = FS.LIST_ROWS, 2
    try:
        again = FS.list_corpus(spark, str(tmp_path), suffixes=[".py"])
        assert sorted(tuple(r) for r in again.collect()) == [w for w in want if w[1].endswith(".py")]
    finally:
        FS.LIST_ROWS = page
    assert FS.list_corpus(spark, str(tmp_path / "empty")).count() == 0
