import json
import os

import pytest
from pyspark.sql import functions as F

from leafstack import cli
from leafstack.common import Scratch, at_once, written
from leafstack.config import ParserConfig
from leafstack.operators import evaluate, nested, ordering, relations, tables
from leafstack.plans import pipeline
from leafstack.schema import CELLS
from leafstack.sources import reader, writer


def a_deck() -> bytes:
    """A title, a table with an image on its second cell, and an image with a label on it."""
    box = lambda x, y, w, h: f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm>'
    head = lambda kind: f'<p:nv{kind}Pr><p:cNvPr id="2" name="N"/><p:nvPr/></p:nv{kind}Pr>'
    text = lambda t, *b: f'<p:sp>{head("Sp")}<p:spPr>{box(*b)}</p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    pic = lambda *b: f'<p:pic>{head("Pic")}<p:blipFill><a:srcRect l="50000"/></p:blipFill><p:spPr>{box(*b)}</p:spPr></p:pic>'
    row = "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>" for t in ("one", "two"))
    grid = '<a:tblGrid><a:gridCol w="1000"/><a:gridCol w="3000"/></a:tblGrid>'
    table = f'<p:graphicFrame>{head("GraphicFrame")}<p:xfrm><a:off x="0" y="2000000"/><a:ext cx="4000000" cy="1000000"/></p:xfrm><a:graphic><a:graphicData><a:tbl>{grid}<a:tr h="1">{row}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    return writer.deck([text("A title", 0, 0, 4000000, 500000) + table + pic(2000000, 2200000, 500000, 500000) + pic(5000000, 3500000, 3000000, 2500000) + text("label", 5500000, 4000000, 500000, 300000)])


@pytest.fixture
def packages(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pptx").write_bytes(a_deck())
    (tmp_path / "in" / "b.docx").write_bytes(writer.docx(["only text"]))
    return tmp_path / "in"


def test_json_holds_cells_labels_and_scores(spark, packages):
    frames = reader.read_packages(spark, str(packages))
    got = pipeline.parse(frames.pages, frames.elements.drop("extra"), frames.cells)
    docs = {r.doc_id[-6:]: json.loads(r.json) for r in got.json().collect()}
    elements = docs["a.pptx"]["pages"][0]["elements"]
    table = next(e for e in elements if e["element_type"] == "table")["metadata"]
    assert [c["text"] for c in table["table_cells"]] == ["one", "two"] and table["col_widths"] == [1000, 3000] and table["row_heights"] == [1]
    (inside,) = table["table_cells"][1]["absorbed_elements"]
    assert inside["type"] == "image" and inside["containment"] == pytest.approx(1) and "cell_bbox" in table["table_cells"][1]
    image = next(e for e in elements if e["element_type"] == "image")["metadata"]
    assert [a["text"] for a in image["annotations"]] == ["label"] and image["crop"] == [0.5, 0, 0, 0]
    assert {e["element_type"] for e in elements} == {"text", "table", "image"} and len(elements) == 3
    md = {r.doc_id[-6:]: r.markdown for r in got.markdown().collect()}
    assert '<colgroup>\n<col style="width:25.0%"/>\n<col style="width:75.0%"/>\n</colgroup>' in md["a.pptx"] and "*label*" in md["a.pptx"]


def test_captions_carry_their_scores(elements, pages):
    page = elements(dict(element_type="image", box=(0.1, 0.1, 0.5, 0.4)), dict(text="Figure 1: a lamp", box=(0.1, 0.52, 0.5, 0.05)))
    ordered = page.withColumn("read_ord", F.col("ordinal") + 1)
    (caption,) = relations.relations(ordered, ParserConfig())[0].filter("relation_type = 'caption_of'").collect()
    assert caption.rule_score == caption.confidence and 0 < caption.score_breakdown.proximity < 1
    flat = {"raw": 1.0, "score": 0.9, "proximity": 0.1, "alignment": 0.1, "size_ratio": 0.1, "position": 0.1, "text_hint": 0.1, "bullet_penalty": 0.0}
    fixed = relations.relations(ordered, ParserConfig(), scorer=lambda *a: {k: F.lit(v) for k, v in flat.items()})[0]
    assert fixed.filter("relation_type = 'caption_of'").first().confidence == 0.9
    assert [tuple(r)[2:] for r in relations.title_scores(ordered, ParserConfig()).collect()] == [(1, 0, 0.7)]


def test_a_structure_of_ones_own(spark, elements, pages):
    seen = []

    def build(p, ordered, titles):
        from leafstack.operators import structure

        seen.append(titles.columns)
        return structure.blocks(p, ordered, titles).filter("kind = 'heading'")

    got = pipeline.parse(pages({}), elements(dict(text="Head", is_heading=True, heading_level=1), dict(text="body")), spark.createDataFrame([], CELLS), structure=build)
    assert [b.kind for b in got.blocks.collect()] == ["heading"] and seen


def test_intermediate_tables_go(spark, packages, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    count = lambda: sum(len(names) for _, _, names in os.walk(shared))
    before = count()
    cli.run(spark, [str(packages), "--output-md", str(tmp_path / "md"), "--output-rag-json", str(tmp_path / "rag")])
    assert count() == before and spark.read.json(str(tmp_path / "md")).count() == 2
    with Scratch(spark) as scratch:
        kept, other = at_once(lambda: written(spark.range(3), "x"), lambda: written(spark.range(4), "y"))
        assert (kept.count(), other.count()) == (3, 4) and count() > before
    scratch.remove()
    assert count() == before


def test_golden_labels(spark, packages, tmp_path):
    (tmp_path / "gold").mkdir()
    label = {"source": "a.pptx", "pages": [{"page_number": 1, "expected_reading_order": ["E_001_0001", "E_001_0002", "E_001_0004"], "expected_relations": [{"type": "title_of", "source": "E_001_0001", "target": "E_001_0002"}]}, {"page_number": 9}]}
    (tmp_path / "gold" / "a.golden.json").write_text(json.dumps(label))
    (tmp_path / "gold" / "z.golden.json").write_text(json.dumps({"source": "gone.pptx", "pages": [{"page_number": 1}]}))
    out = tmp_path / "eval.json"
    cli.run(spark, [str(packages), "--golden-dir", str(tmp_path / "gold"), "--output-eval-json", str(out)])
    report = json.loads(out.read_text())
    assert report["summary"] == {"num_golden_files": 2, "num_evaluated": 1, "avg_kendall_tau": 1.0, "avg_normalised_edit_distance": 1.0}
    first, second = sorted(report["results"], key=lambda r: r["status"], reverse=True)
    assert (first["pages"], first["pages_not_found"], first["recall"]) == (1, 1, 1.0) and 0 < first["precision"] <= 1
    assert second["status"] == "missing" and second["pages"] == 0
    assert evaluate.review_sample(spark.createDataFrame([("d", 1, 1, "caption_of", "a", "b", 0.8)], "doc_id string, page_number int, rel_idx int, relation_type string, source_element_id string, target_element_id string, confidence double"), 5).count() == 1


def test_data_source_tables(spark, packages):
    spark.dataSource.register(reader.OfficeDataSource)
    read = lambda t: spark.read.format("officedoc").option("table", t).option("batch_bytes", 1).load(str(packages))
    assert (read("elements").count(), read("pages").count(), read("cells").count()) == (6, 2, 2)
    with pytest.raises(Exception, match="table must be"):
        read("rows").count()


def cells(spark, *places):
    rows = [("d", 1, 0, i, r, c, t, None, False, 1, 1, False) for i, (r, c, t) in enumerate(places)]
    return spark.createDataFrame(rows, "doc_id string, page_number int, ordinal int, cell_idx int, row_idx int, col_idx int, text string, formatted_text string, is_spanned boolean, span_width int, span_height int, is_merge_origin boolean")


def test_tables_with_gaps(spark):
    show = lambda *places: tables.pipe_tables(cells(spark, *places)).first().markdown.split("\n")
    assert show((0, 0, "a"), (0, 2, "c"), (3, 1, "x"), (3, 1, "later")) == ["| a |  | c |", "| --- | --- | --- |", "|  |  |  |", "|  |  |  |", "|  | later |  |"]
    assert show((2, 1, "x")) == ["|  |  |", "| --- | --- |", "|  |  |", "|  | x |"]
    assert show((0, 0, None)) == ["|  |", "| --- |"]
    html = tables.html_tables(cells(spark, (1, 0, "a"), (3, 0, "b"))).first().html.split("\n")
    assert html == ["<table>", "<tbody>", "<tr></tr>", "<tr><td>a</td></tr>", "<tr></tr>", "<tr><td>b</td></tr>", "</tbody>", "</table>"]
    assert tables.pipe_tables(cells(spark, (0, 0, "a")).limit(0)).count() == 0


def test_a_large_table_is_linear(spark):
    n = 40_000
    big = spark.range(n).selectExpr("'d' AS doc_id", "1 AS page_number", "0 AS ordinal", "cast(id AS int) AS cell_idx", "cast(id div 4 AS int) AS row_idx", "cast(id % 4 AS int) AS col_idx", "'t' AS text", "cast(null AS string) AS formatted_text", "false AS is_spanned", "1 AS span_width", "1 AS span_height")
    assert tables.pipe_tables(big).first().markdown.count("\n") == n // 4
    assert tables.html_tables(big).first().html.count("<tr>") == n // 4


def test_a_stray_cell_costs_one_cell():
    sheet = f'<worksheet {writer.S}><sheetData><row r="1"><c r="A1"><v>1</v></c></row><row r="1000000"><c r="XFD1000000"><v>2</v></c></row></sheetData></worksheet>'
    got = reader.parse("x.xlsx", writer.book({"S": sheet}))
    assert [(c["row_idx"], c["col_idx"], c["text"]) for c in got.cells] == [(0, 0, "1"), (999_999, 16_383, "2")]


def test_elements_without_a_box_stand_last(elements):
    page = elements(dict(element_id="a"), dict(element_id="b", box=(0, 0.5, 0.1, 0.1)), dict(element_id="c", box=(0, 0.1, 0.1, 0.1)))
    page = page.withColumn("x", F.when(F.col("element_id") != "a", F.col("x"))).withColumn("y", F.when(F.col("element_id") != "a", F.col("y")))
    got = ordering.composite(page, ParserConfig()).orderBy("read_ord").collect()
    assert [(r.element_id, r.spatial_group) for r in got] == [("c", "0.h0"), ("b", "0.h1"), ("a", None)]


def test_all_levels_from_one_parse(spark):
    inner = json.dumps({"table_cells": [{"row": 0, "absorbed_elements": {"type": "text"}}, None]})
    payload = json.dumps({"pages": [{"page_number": 1, "elements": {"element_id": "t", "metadata": inner}}, None]})
    rows = [(1, payload, "x"), (1, payload, "x"), (1, '{"pages": []}', "x"), (2, None, "x"), (3, "broken", "x"), (None, payload, "x")]
    records = spark.createDataFrame(rows, "record_id long, payload string, page_pos string")
    both = nested.flatten_all(records)
    for level in nested.LEVELS:
        one = sorted(map(str, nested.flatten_records(records, level).collect()))
        assert sorted(map(str, both[level].collect())) == one and len(one) == {"pages": 4, "elements": 2, "cells": 4, "absorbed": 2}[level]
    assert nested.flatten_all(records.limit(0))["cells"].count() == 0


