"""The entry point without the training-data subpackage, or without a library that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("blocked", ["ahocorasick", "fairshare.llm", "corpus_pipeline"])
def test_other_queries_stay_when_an_import_fails(blocked, tmp_path):
    code = (
        f"import sys\nsys.path.insert(0, {ROOT!r})\n"
        "class Blocked:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {blocked!r}:\n            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Blocked())\n"
        "import __spark_entry__ as entry\n"
        "from checks.oracle import SQL\nfrom checks.queries import QUERIES\n"
        "assert entry.queries() == QUERIES and entry.oracle_sql() == SQL\nprint('done')\n"
    )
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert ran.stdout.strip() == "done", ran.stderr
