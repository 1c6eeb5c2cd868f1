"""The driver contract with and without the optional subpackage."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1') for k in e.queries()))"


def copied(tmp_path, *without):
    shutil.copytree(ROOT, tmp_path / "tree", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or str(Path(d).relative_to(ROOT) / n) in without])
    return subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "tree", capture_output=True, text=True)


@pytest.mark.parametrize("without", [("attestor/llm", "tests/llm"), ("attestor/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_lives_without_the_subpackage(tmp_path, without):
    run = copied(tmp_path, *without)
    assert run.returncode == 0, run.stderr
    n, n_sql, has_op = run.stdout.split()
    assert int(n) > 150 and int(n_sql) > 140
    assert has_op == str("attestor/llm" not in without and (ROOT / "attestor" / "llm").exists())
