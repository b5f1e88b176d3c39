"""The driver's contract: names, SQL for known queries, no dependency of the library on the training-data subpackage."""

import pathlib
import re

import __spark_entry__


def test_contract(spark):
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 40
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_imports_the_training_data_subpackage():
    root = pathlib.Path(__file__).resolve().parent.parent / "scriptorium"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|scriptorium\.llm|corpus_pipeline", path.read_text()), path
