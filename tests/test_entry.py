import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_is_imported_without_a_session():
    """The queries and their SQL can be listed before any Spark session exists, and every SQL has its query."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr


def test_flagship_query(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
