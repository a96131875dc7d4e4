"""Round trips of packages: results equal SQL, and no frame of keys is joined."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

LINES = [(k, p, s, n) for k, p, s, n in ((0, 1, 2, 1), (0, 3, 4, 2), (0, 5, 6, 3), (0, 5, 6, 4), (5, 7, 8, 1), (17, 9, 10, 1), (17, 9, 11, 2), (31, 12, 13, 1), (None, 14, 15, 1), (None, 16, 17, 2))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    rows = [(k, p, s, n, float(n), 1.5 * n, "A", datetime.datetime(1995, 3, n)) for k, p, s, n in LINES]
    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


def check(spark, tables, name):
    got = entry.queries()[name](spark, tables)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tables}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_docx_tables_join_no_keys(spark, tables):
    check(spark, tables, "docx_tables_roundtrip")


def test_pptx_tables_join_no_keys(spark, tables):
    check(spark, tables, "pptx_tables_roundtrip")


def test_slide_parts_are_parsed_once(monkeypatch):
    from leafstack.sources import package, reader, writer

    seen = []
    parse = package.ET.fromstring
    monkeypatch.setattr(package.ET, "fromstring", lambda data: seen.append(data) or parse(data))
    reader.parse("a.pptx", writer.pptx(["one", "two"]))
    assert len(seen) == len(set(seen))


def test_plain_cells_read_as_marked_ones():
    import xml.etree.ElementTree as ET

    from leafstack.sources import pptx, writer

    for body in ("<a:p><a:r><a:t> a </a:t></a:r><a:r><a:t>b</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>c</a:t></a:r></a:p>", "<a:p><a:r><a:rPr b='1'/><a:t>a</a:t></a:r><a:r><a:t>bcdefghi</a:t></a:r></a:p>", "<a:p><a:br/><a:r><a:t>x</a:t></a:r></a:p>"):
        paragraphs = list(ET.fromstring(f"<a:b {writer.A}>{body}</a:b>"))
        assert pptx._body_texts(paragraphs) == (pptx.bulleted(paragraphs), pptx.formatted(paragraphs, html=True))


def test_hwpx_tables_join_no_keys(spark, tables):
    check(spark, tables, "hwpx_tables_roundtrip")


def test_xlsx_values_read_packages_once(spark, tables):
    check(spark, tables, "xlsx_values_roundtrip")


def test_pptx_markdown_moves_no_cells_for_nothing(spark, tables, tmp_path, monkeypatch):
    """Tables alone on their slide take nothing in: their cells meet no elements and aren't written a second time."""
    from leafstack import common
    from leafstack.operators import layout
    from leafstack.plans import pipeline

    seen = []
    write = common.written
    for module in (layout, pipeline):
        monkeypatch.setattr(module, "written", lambda df, label: seen.append((label, out := write(df, label))) or out)
    got = entry.queries()["pptx_markdown_roundtrip"](spark, tables)
    found = {label: df for label, df in seen}
    assert [label for label, _ in seen].count("cells") == 1
    assert found["tables"].count() == found["absorbed"].count() == 0 and found["cells"].count() > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tables}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['pptx_markdown_roundtrip']})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_deflated_parts_are_read_directly_and_broken_ones_refused(monkeypatch):
    import zipfile

    from leafstack.sources import reader, writer
    from leafstack.sources.package import Package

    content = writer.pptx(["one", "two"])
    opened = []
    open_ = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(name) or open_(self, name, *a, **k))
    assert [e["text"] for e in reader.parse("a.pptx", content).elements] == ["one\ntwo"] and not opened
    part = Package(content).zip.getinfo("ppt/slides/slide1.xml")
    at = part.header_offset + 30 + len(part.filename) + part.compress_size // 2
    with pytest.raises(Exception, match="CRC|invalid|Error"):
        reader.parse("a.pptx", content[:at] + bytes([content[at] ^ 0xFF]) + content[at + 1 :])


def test_cells_of_one_run_read_as_others():
    import xml.etree.ElementTree as ET

    from leafstack.sources import pptx, writer

    run, tail = "<a:txBody><a:p><a:r><a:t> a </a:t></a:r></a:p></a:txBody>", "<a:tcPr/>"
    for marks in ("", ' gridSpan="2"', ' hMerge="1"', ' vMerge="1"', ' rowSpan="3"', ' gridSpan=""', ' gridSpan="x" vMerge="0"'):
        first = "<a:tc><a:txBody><a:p><a:r><a:t>f</a:t></a:r></a:p></a:txBody></a:tc>"
        # Without the empty properties a cell goes the long way.
        fast, slow = (ET.fromstring(f"<a:tr {writer.A}>{first}<a:tc{marks}>{run}{end}</a:tc></a:tr>") for end in (tail, ""))
        assert pptx._one_run(fast[1]) == "a" and pptx._one_run(slow[1]) is None
        assert pptx._row_slots(fast) == pptx._row_slots(slow)
