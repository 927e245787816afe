"""The entry module must load before any session exists."""

import os
import subprocess
import sys


def test_import_without_session():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=top).returncode == 0
