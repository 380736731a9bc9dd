import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_needs_no_extras():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "spanlens"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "spanlens.llm" not in path.read_text()
