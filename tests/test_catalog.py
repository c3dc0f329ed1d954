"""Every registered query with SQL gives the rows of its SQL; the others run."""

from __future__ import annotations

import pytest

from tessella import catalog
from tests.comparing import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf).toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert_same(got, con.sql(sql).to_arrow_table())
    else:
        assert got.num_rows > 0


def test_entry_imports_without_the_llm_folders(tmp_path):
    """With the subpackage, its tests and the pipeline gone the rest still registers."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
