"""The entry point passes over absent training-data operators, and over nothing else."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(REPO / "tidewater", tmp_path / "tidewater")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    return tmp_path


def test_operators_may_be_absent(copy):
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    shutil.rmtree(copy / "tidewater" / "llm", ignore_errors=True)
    done = names(copy)
    assert done.returncode == 0, done.stderr
    assert "'forecast_ar'" in done.stdout and "'op1_" not in done.stdout and "'pipeline'" not in done.stdout


@pytest.mark.skipif(not (REPO / "tidewater" / "llm").exists(), reason="operators are absent")
def test_broken_imports_are_raised(copy):
    module = copy / "tidewater" / "llm" / "mixing.py"
    module.write_text(module.read_text() + "\nfrom tidewater.sesion import nothing  # noqa\n")
    done = names(copy)
    assert done.returncode != 0 and "tidewater.sesion" in done.stderr


def test_package_need_not_be_on_the_executors(tmp_path):
    """Queries with functions in tasks, from a foreign folder with the package on the driver's path only."""
    script = tmp_path / "run.py"
    script.write_text(
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from tidewater.session import build_session\n"
        "import __spark_entry__ as e\n"
        "s = build_session('foreign', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "from tidewater.forecast import trees\n"
        "from tidewater.workloads.score_queries import suppliers\n"
        "sf = '/root/testdata/sf0.001'\n"
        "made = [e.queries()[q](s, sf).count() for q in ('forecast_es', 'forecast_arma', 'fit_linear_l2')]\n"
        "specs = (('xgb', {'loss': 'quantile', 'n_estimators': 2}), ('rf', {'loss': 'l1', 'n_estimators': 2}))\n"
        "print('rows', made, [trees.forecast_trees(suppliers(s, sf), *x).count() for x in specs])\n"
    )
    done = subprocess.run([sys.executable, str(script), str(REPO)], cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert "rows [" in done.stdout, done.stderr[-2000:]
