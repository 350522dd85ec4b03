from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder: Path) -> list[list[str]]:
    out = subprocess.run(
        [sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True, env={"PYTHONPATH": str(folder)}
    )
    return [line.split() for line in out.stdout.splitlines()[-2:]]


@pytest.mark.parametrize("gone", [["scorebook/llm"], ["scorebook/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_the_training_data_operators(tmp_path, gone):
    from scorebook.plans.catalog import ORACLES, QUERIES

    copy = tmp_path / "copy"
    without = [str(ROOT / g) for g in gone]
    shutil.copytree(
        ROOT, copy,
        ignore=lambda folder, found: [f for f in found if f in (".git", "tests") or str(Path(folder) / f) in without],
    )
    assert names(copy) == [sorted(QUERIES), sorted(ORACLES)]


def test_an_absent_package_costs_only_the_queries_that_need_it(tmp_path):
    from scorebook.plans.catalog import QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "llm"))
    (copy / "scorebook" / "llm").mkdir()
    (copy / "scorebook" / "llm" / "__init__.py").write_text("")
    (copy / "scorebook" / "llm" / "queries.py").write_text("import a_package_that_is_not_there\n")
    assert names(copy)[0] == sorted(QUERIES)
