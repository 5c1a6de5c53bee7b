"""The library without the optional subpackage: the driver deletes both of its folders and leaves the pipeline's file."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as registry
names = set(registry.queries())
assert set(registry.oracle_sql()) <= names and len(names) > 100, len(names)
assert not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
assert registry.__file__.startswith({copy!r}), registry.__file__
"""


def test_registry_without_the_subpackage(tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    assert os.path.exists(f"{copy}/corpus_pipeline.py") and not os.path.exists(f"{copy}/returnlens/llm")
    done = subprocess.run([sys.executable, "-c", PROBE.format(copy=copy)], cwd=copy, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": copy})
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_names_the_subpackage():
    for top in ("returnlens", "tests"):
        for folder, _, files in os.walk(os.path.join(ROOT, top)):
            if os.sep + "llm" in folder or "__pycache__" in folder:
                continue
            for name in files:
                if name.endswith(".py") and name != os.path.basename(__file__):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "returnlens.llm" not in f.read(), name
