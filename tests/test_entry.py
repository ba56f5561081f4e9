"""The entry works with and without the llm folders."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_llm(tmp_path):
    shutil.copytree(os.path.join(HERE, "latticework"), tmp_path / "latticework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'segment' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(HERE, "latticework")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "latticework.llm" not in open(os.path.join(folder, n)).read()
