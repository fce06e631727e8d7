"""The driver contract, with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r} or name.startswith({gone!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
"""
LIST = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len(q), sum(n.startswith("op") or n == "pipeline" for n in q), len(set(o) - set(q)))
"""


def run(code):
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    return out.returncode, out.stdout.split(), out.stderr


def test_queries_without_the_training_data_subpackage():
    code, out, err = run(BLOCK.format(gone="codeweave.llm") + LIST)
    assert code == 0, err
    n, own, unknown = map(int, out)
    assert n >= 69 and own == 0 and unknown == 0


def test_other_import_errors_are_not_swallowed():
    code, _, err = run(BLOCK.format(gone="numpy") + LIST)
    assert code != 0 and "numpy" in err


def test_nothing_else_imports_the_subpackage():
    for base, _, names in os.walk(os.path.join(ROOT, "codeweave")):
        for name in names:
            if name.endswith(".py") and os.path.basename(base) != "llm":
                with open(os.path.join(base, name)) as f:
                    assert "llm" not in f.read(), name
