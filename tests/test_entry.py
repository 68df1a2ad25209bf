"""The driver's entry, also where the training-data subpackage can't be imported."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("harm", ["none", "gone", "left over", "broken"])
def test_core_queries_stay(tmp_path, harm):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    llm = tmp_path / "r" / "lociloom" / "llm"
    if harm in ("gone", "left over"):
        if llm.exists():
            shutil.rmtree(llm)
        (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    if harm == "left over":
        (llm / "__pycache__").mkdir(parents=True)
    if harm == "broken":
        llm.mkdir(exist_ok=True)
        (llm / "queries.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, check=True)
    n, more, fits = done.stdout.split()
    import jobs.queries
    from lociloom.plans.queries import QUERIES

    assert int(n) - int(more) == len(QUERIES) + len(jobs.queries.QUERIES) and fits == "True"
    if harm != "none":
        assert more == "0" and "left out" in done.stderr
