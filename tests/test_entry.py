import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_operators(tmp_path):
    """With their folders and the pipeline away, everything else is still there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; n = set(e.queries()); assert set(e.oracle_sql()) <= n and 'verdict_counts' in n and not any(x.startswith('op1') or x == 'pipeline' for x in n)"
    for missing in (("llm",), ("llm", "corpus_pipeline.py")):
        if "corpus_pipeline.py" not in missing and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", copy)
        elif (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        env = {**os.environ, "PYTHONPATH": str(copy)}
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
