import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(n.startswith('op') or n == 'pipeline' for n in q), set(s) <= set(q))"


@pytest.mark.parametrize("without", [("casejobs/llm", "tests/llm", "corpus_pipeline.py"), ("casejobs/llm", "tests/llm")])
def test_entry_without_the_corpus_operators(tmp_path, without):
    """A fresh Python on a copy of the repository without these folders has all queries of the case library."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in without:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    seen = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert seen.returncode == 0, seen.stderr
    from casejobs import oracle, queries

    assert seen.stdout.split() == [str(len(queries.queries())), str(len(oracle.oracle_sql())), "0", "True"]
