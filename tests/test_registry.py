import os
import re

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 55


def test_core_never_imports_the_llm_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "leafstack")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"leafstack[. ](import )?llm", open(os.path.join(folder, n), encoding="utf-8").read()), n


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["caption_assignment", "block_kinds", "html_table", "markdown_page", "table_absorb", "p4_found"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
