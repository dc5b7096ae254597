"""The entry module without a session, and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("sparkburst.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, No())
"""


def names(prelude: str) -> set[str]:
    code = prelude + "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())


def test_without_subpackage():
    left = names(BLOCK)
    assert len(left) > 100 and not any(n.startswith("op") or n == "pipeline" for n in left)


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "sparkburst")):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "llm" not in text.read()
