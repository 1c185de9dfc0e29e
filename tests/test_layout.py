import ast
import importlib.util
import os
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path(os.environ.get("TESTDATA", "/root/testdata/sf0.001"))


def test_nothing_outside_llm_imports_it():
    for path in (ROOT / "vocspan").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("vocspan.llm") for n in names), path


def test_queries_and_sql_belong_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    numbers = {4, 7} | (set(range(1, 11)) if importlib.util.find_spec("vocspan.llm") else set())
    assert {int(n[1:].split("_")[0]) for n in queries if n[0] == "p" and n[1].isdigit()} == numbers


def plain(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return "-"
    if isinstance(value, (bool, str)):
        return str(value)
    try:
        return f"{float(value):.7g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in DATA.iterdir():
        con.execute(f"create view {table.stem} as select * from '{table}'")
    got = entry.queries()[name](spark, str(DATA))
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    assert {r["slice"] for r in entry.entry(spark).collect()} >= {"all"}
