"""The registry of queries without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from siltstone.sources.workspace import shared_root

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q = e.queries(); assert e.oracle_sql().keys() <= q.keys(); print(sorted(q))"


def names(root):
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=root, capture_output=True, text=True, check=True)
    return eval(out.stdout)  # noqa: S307


def test_queries_without_the_optional_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    left = names(copy)
    assert "hybrid_search" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    pipeline = ROOT / "corpus_pipeline.py"
    if pipeline.exists():
        shutil.copy(pipeline, copy)
    assert names(copy) == left


class Session:
    """As much of a session as the shared folder asks."""

    def __init__(self, master, root=None):
        self.sparkContext = self.conf = self
        self.master, self.root = master, root

    def get(self, key, default):
        return self.root

    def getCheckpointDir(self):  # noqa: N802
        return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session("spark://host:7077"))
    assert shared_root(Session("spark://host:7077", "s3a://b/c/")) == "s3a://b/c"
