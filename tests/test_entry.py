"""The driver contract, also without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())


def test_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(k for k in q if not k.startswith('q_')), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("[] True"), out.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/plumbline"):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(f"{folder}/{name}") as f:
                        assert "plumbline.llm" not in f.read()
