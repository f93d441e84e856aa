"""The driver's contract."""

import __spark_entry__


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_the_training_data_operators():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "siltstone"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "siltstone.llm" not in f.read_text() and "from ..llm" not in f.read_text() and "from .llm" not in f.read_text()
