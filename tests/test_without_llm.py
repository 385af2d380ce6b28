"""The library without the training-data operators: it imports and answers."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = """
import __spark_entry__ as registry
from tidewire.plans.session import local_session
assert not any(name.startswith("op") or name == "pipeline" for name in registry.queries())
spark = local_session(2, app="without")
print("rows", registry.queries()["clean_full"](spark, {tables!r}).count())
"""


def test_entry_without_the_subpackage(tmp_path, tables):
    """The subpackage and its tests are gone; the pipeline's file is there or not."""
    copy = tmp_path / "copy"
    ignore = shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache")
    shutil.copytree(ROOT, copy, ignore=ignore)
    assert not (copy / "tidewire" / "llm").exists()
    for there in (True, False):
        if not there and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").rename(copy / "corpus_pipeline.txt")
        done = subprocess.run(
            [sys.executable, "-c", ASK.format(tables=tables)], cwd=copy, capture_output=True, text=True
        )
        assert done.returncode == 0, done.stderr[-2000:]
        assert int(done.stdout.split("rows ")[1].split()[0]) > 0
