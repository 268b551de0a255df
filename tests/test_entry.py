"""The driver's entry stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOADS = """
import __spark_entry__ as entry
names = set(entry.queries())
assert {"detected_alerts", "track_windows"} <= names and set(entry.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""


def copied(to):
    shutil.copytree(os.path.join(ROOT, "contrail"), to / "contrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), to)
    return to


def test_without_the_subpackage(tmp_path):
    """With the pipeline's file left behind, and without it."""
    place = copied(tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), place)
        subprocess.run([sys.executable, "-c", LOADS], cwd=place, env=env, check=True)
        os.remove(place / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", LOADS], cwd=place, env=env, check=True)
