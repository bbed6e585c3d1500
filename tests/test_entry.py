"""The entry file stands without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOWN = "import __spark_entry__ as e; print(sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()), len(e.queries()) > 50, set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder: str) -> list[str]:
    return subprocess.run([sys.executable, "-c", SHOWN], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_imports_with_and_without_corpus_folders(tmp_path):
    for name, gone in (("no_folder", ("llm",)), ("no_file", ("llm", "corpus_pipeline.py"))):
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", *gone))
        assert shown(str(copy)) == ["0", "True", "True"]
