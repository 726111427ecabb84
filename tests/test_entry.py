import pathlib
import re

import __spark_entry__ as e


def test_names():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80 and {"p1_found", "p4_found", "knn_cosine"} <= set(q)


def test_core_does_not_import_llm():
    root = pathlib.Path(e.__file__).parent / "vectorloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+\S*llm", p.read_text()), p


def test_flagship(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["id"] == 0
