import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent


def test_the_library_stands_without_llm():
    for path in (ROOT / "nodeloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_each_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_the_entry_module_without_llm(tmp_path):
    """A copy without both folders and the pipeline imports and lists its queries."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "nodeloom", tmp_path / "nodeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']; print(e.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and str(tmp_path) in out.stdout, out.stderr
