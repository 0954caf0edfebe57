"""The driver contract, and that the library stands without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15


def test_nothing_imports_the_training_data_subpackage():
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('chronoloom.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'pacing_summary' in e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
