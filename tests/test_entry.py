import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    got = entry.entry(spark)
    assert got.columns == ["feature", "rank", "community", "score"] and got.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p3_found"} <= set(entry.queries())


def test_nothing_else_imports_the_llm_package():
    for path in (ROOT / "kithloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\s+kithloom\.llm", path.read_text(), re.M), path


def test_no_local_checkpoints():
    for path in (ROOT / "kithloom").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path
