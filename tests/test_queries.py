"""Every registered query runs, and agrees with its SQL where it has one."""

import pytest

from kifu_spark import catalog
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    names, rows = spark_rows(df)
    if name in catalog.oracle_sql():
        assert (names, rows) == duck_rows(catalog.oracle_sql()[name], sf_dir)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "user_id" in df.columns


def test_entry_without_training_operators():
    """The entry point still imports and lists the other queries when the llm folders are gone."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(os.path.join(root, "kifu_spark"), os.path.join(folder, "kifu_spark"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), folder)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'move_stats' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=folder, check=True)
