import os
from collections import Counter
from pathlib import Path

import pytest

from quillstone.plans import catalogue

NAMES = sorted(catalogue.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v.isoformat() if hasattr(v, "isoformat") else v


def compare(spark, data, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{data}/{f}'")
    df = query(spark, data)
    cols = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == cols
    mine = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    theirs = Counter(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, data, name):
    compare(spark, data, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_no_query_leaves_out_the_subpackage_by_import():
    """Nothing but the entry point names the subpackage, and that only if it is there."""
    root = Path(__file__).resolve().parent.parent
    for p in (root / "quillstone").rglob("*.py"):
        if "llm" not in p.relative_to(root / "quillstone").parts:
            assert "quillstone.llm" not in p.read_text()
