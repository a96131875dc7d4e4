import json
import os

import pytest

from leafstack import cli
from leafstack.sources import docx, pptx, reader, writer, xlsx
from leafstack.sources.package import Options
from leafstack.sources.writer import A, P, W

PNG = bytes.fromhex("89504e470d0a1a0a")


def parse(name, data, **options):
    return reader.parse(name, data, Options(**options))


DOCX_BODY = """
<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr><w:spacing w:before="720" w:line="480" w:lineRule="exact"/><w:ind w:left="1224"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>[x] bold</w:t></w:r><w:r><w:t xml:space="preserve"> rest</w:t></w:r></w:p>
<w:p><w:r><w:drawing><wp:anchor behindDoc="0"><wp:positionH relativeFrom="page"><wp:posOffset>914400</wp:posOffset></wp:positionH><wp:positionV relativeFrom="page"><wp:posOffset>1828800</wp:posOffset></wp:positionV><wp:extent cx="1828800" cy="914400"/><wps:txbx><w:txbxContent><w:p><w:r><w:t>Box label</w:t></w:r></w:p></w:txbxContent></wps:txbx></wp:anchor></w:drawing></w:r></w:p>
<w:p><w:r><w:drawing><wp:inline><wp:extent cx="914400" cy="914400"/><a:blip r:embed="rId7"/></wp:inline></w:drawing></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p><w:r><w:t>lost</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:left="720" w:right="720" w:top="720" w:bottom="720"/></w:sectPr><w:p><w:r><w:t>Next section</w:t></w:r></w:p>"""


def docx_file():
    ns = f'{W} {A} xmlns:wp="urn:wp" xmlns:wps="urn:wps" xmlns:r="urn:r"'
    return writer.zipped({"word/document.xml": f"<w:document {ns}><w:body>{DOCX_BODY}</w:body></w:document>", "word/_rels/document.xml.rels": writer.relations({"rId7": ("image", "media/pic.png")}), "word/media/pic.png": PNG})


def test_docx():
    got = parse("a.DOCM", docx_file(), keep_assets=True, assets_name="assets")
    e = got.elements
    assert [(x["page_number"], x["element_type"], x["text"]) for x in e] == [(1, "text", "Head"), (1, "text", "  - [x] bold rest"), (1, "text", "Box label"), (1, "image", None), (1, "table", "A | B"), (2, "text", "Next section")]
    assert e[0]["heading_level"] == 2 and e[0]["is_heading"] and e[1]["formatted_text"] == "**[x] bold** rest" and e[1]["line_pattern"] == "bracket_leading" and e[1]["is_mostly_bold"]
    assert e[2]["layout"] == "floating_textbox" and e[2]["z_order"] == 104 and abs(e[2]["x"] - 914400 / (12240 * 635)) < 1e-9
    assert e[3]["image_ref"] == "assets/pic.png" and got.assets == [{"name": "pic.png", "data": PNG}] and e[3]["layout"] == "inline"
    top, inner = 720 / 15840, 14400
    first = max(240 / inner, 0.025)
    assert abs(e[0]["y"] - top) < 1e-12 and abs(e[1]["y"] - (top + first + 720 / inner)) < 1e-9 and abs(e[1]["height"] - 480 / inner) < 1e-9 and abs(e[1]["x"] - (720 + 1224) / 12240) < 1e-9
    assert [(c["row_idx"], c["col_idx"], c["text"], c["is_spanned"]) for c in got.cells] == [(0, 0, "A", False), (0, 1, "B", False), (1, 0, None, False), (1, 1, None, True)]
    assert got.cells[3]["cx"] is None and abs(got.cells[1]["cw"] - e[4]["width"] / 2) < 1e-12
    assert parse("e.docx", writer.zipped({"word/document.xml": f"<w:document {W}/>"})).pages == []
    assert docx.sections([])[0] == ([], None)


def sp(text, box=(0, 0, 100, 100), ph="", name="S", body=""):
    frame = f'<a:xfrm><a:off x="{box[0]}" y="{box[1]}"/><a:ext cx="{box[2]}" cy="{box[3]}"/></a:xfrm>' if box else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{frame}</p:spPr><p:txBody>{body or f"<a:p><a:r><a:t>{text}</a:t></a:r></a:p>"}</p:txBody></p:sp>'


TABLE = """<a:tbl><a:tblGrid><a:gridCol w="1000"/><a:gridCol w="3000"/></a:tblGrid><a:tr h="500"><a:tc gridSpan="2" rowSpan="2"><a:txBody><a:p><a:r><a:rPr b="1"/><a:t>HE</a:t></a:r><a:r><a:t>ADER x</a:t></a:r></a:p></a:txBody></a:tc><a:tc hMerge="1"/></a:tr>
<a:tr h="500"><a:tc vMerge="1"/><a:tc vMerge="1"/></a:tr></a:tbl>"""


def pptx_file():
    body = '<a:p><a:pPr><a:buAutoNum type="romanUcPeriod" startAt="3"/></a:pPr><a:r><a:t>one</a:t></a:r></a:p><a:p><a:pPr><a:buAutoNum type="romanUcPeriod"/></a:pPr><a:r><a:rPr i="1"/><a:t>two</a:t></a:r></a:p><a:p><a:pPr lvl="1"><a:buChar char="*"/></a:pPr><a:r><a:t>sub plain text</a:t></a:r></a:p>'
    math = '<a:p xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:oMath><m:r><m:t>x</m:t></m:r><m:r><m:t>+ y</m:t></m:r></m:oMath></a:p>'
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="5" name="G"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="914400" y="0"/><a:ext cx="914400" cy="914400"/></a:xfrm></p:grpSpPr>{sp("inside", (914400, 685800, 10, 10))}</p:grpSp>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="6" name="I"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rId9"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="952500" cy="952500"/></a:xfrm></p:spPr></p:pic>'
    frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="7" name="T"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="4572000" y="3429000"/><a:ext cx="4572000" cy="3429000"/></p:xfrm><a:graphic><a:graphicData>{TABLE}</a:graphicData></a:graphic></p:graphicFrame>'
    slide = sp("Title", None, '<p:ph type="title"/>') + sp("", body=body + math) + group + pic + frame
    layer = lambda tag, shapes: f"<p:{tag} {P} {A}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{tag}>"
    more = {
        "ppt/slideLayouts/slideLayout1.xml": layer("sldLayout", sp("Click to edit Master title", (914400, 685800, 4572000, 685800), '<p:ph type="title"/>') + sp("Click to edit Master text", ph='<p:ph idx="7"/>') + sp("Confidential", name="C")),
        "ppt/media/image1.png": PNG,
    }
    rels = {i: {"rId1": ("slideLayout", "../slideLayouts/slideLayout1.xml"), "rId9": ("image", "../media/image1.png")} for i in (1, 2)}
    return writer.deck([slide, sp("Second slide")], more, rels)


def test_pptx():
    got = parse("deck.pptx", pptx_file(), keep_assets=True)
    e = got.elements
    assert [(x["page_number"], x["element_type"], x["text"]) for x in e] == [
        (1, "text", "Title"), (1, "text", "III. one\nIV. two\n* sub plain text\n[MATH] x + y"), (1, "group", None), (1, "text", "inside"), (1, "image", None), (1, "table", "HEADER x"), (1, "text", "Confidential"), (2, "text", "Second slide"),
    ]
    assert e[0]["is_placeholder"] and (e[0]["x"], e[0]["y"], e[0]["width"]) == (0.1, 0.1, 0.5)
    assert e[1]["formatted_text"] == "III. one\nIV. *two*\n* sub plain text"
    assert (e[3]["x"], e[3]["y"]) == (0.2, 0.1) and e[4]["image_ref"] == "slide001_shape0005.png" and e[4]["image_width"] == 100
    assert [(c["text"], c["is_spanned"], c["span_width"], c["span_height"], c["is_merge_origin"]) for c in got.cells] == [("HEADER x", False, 2, 2, True)] + [(None, True, 1, 1, False)] * 3
    assert got.cells[0]["formatted_text"] == "<b>HE</b>ADER x" and (got.cells[0]["cw"], got.cells[0]["ch"]) == (0.5, 0.5) and abs(got.cells[1]["cx"] - 0.625) < 1e-12
    assert [x["text"] for x in parse("deck.pptx", pptx_file(), include_master_shapes=False).elements].count("Confidential") == 0
    assert [x["text"] for x in parse("deck.pptx", pptx_file(), deduplicate_master_shapes=False).elements].count("Confidential") == 2
    assert pptx.auto_number("circleNumDbPlain", 21) == "(21) " and pptx.auto_number("alphaLcParenR", 27) == "a) "


def test_hwpx():
    body = '<hp:p><hp:run><hp:t>Hello HWPX</hp:t></hp:run></hp:p><hp:tbl><hp:tr><hp:tc colSpan="2"><hp:p><hp:t>H</hp:t></hp:p></hp:tc></hp:tr><hp:tr><hp:tc><hp:p><hp:t>a</hp:t></hp:p></hp:tc><hp:tc><hp:p><hp:t>b</hp:t></hp:p></hp:tc></hp:tr></hp:tbl><hp:pic><hp:img binaryItemIDRef="image1"/></hp:pic>'
    data = writer.zipped({"Contents/section10.xml": f"<hp:sec {writer.H}/>", "Contents/section2.xml": f"<hp:sec {writer.H}>{body}</hp:sec>", "BinData/image1.png": PNG})
    got = parse("x.hwpx", data)
    assert [(x["element_type"], x["text"], round(x["y"], 2)) for x in got.elements] == [("text", "Hello HWPX", 0.0), ("table", "H\na | b", 0.08), ("image", None, 0.16)] and len(got.pages) == 2
    assert [(c["text"], c["is_spanned"], c["span_width"]) for c in got.cells] == [("H", False, 2), (None, True, 1), ("a", False, 1), ("b", False, 1)]
    assert len(parse("y.hwpx", writer.zipped({"other.xml": "<x/>"})).pages) == 1


def test_xlsx():
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>0.95</v></c><c r="B2" s="1"><v>45000.5</v></c></row><row r="4"><c r="B4" t="b"><v>1</v></c><c r="C4"><v>7</v></c></row>'
    sheet = f'<worksheet {writer.S}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    more = {"xl/sharedStrings.xml": f"<sst {writer.S}><si><r><t>Na</t></r><r><t>me</t></r><rPh><t>x</t></rPh></si></sst>", "xl/styles.xml": f'<styleSheet {writer.S}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'}
    got = parse("b.XLSM", writer.book({"Demo": sheet, "Empty": f"<worksheet {writer.S}/>"}, more))
    assert got.elements[0]["text"] == "Name |  | \n0.95 | 2023-03-15 12:00:00 | \n | True | 7" and got.elements[1]["text"] is None
    assert [p["sheet_name"] for p in got.pages] == ["Demo", "Empty"] and len(got.cells) == 4 * 3 + 1
    assert (got.cells[0]["span_width"], got.cells[0]["is_merge_origin"], got.cells[1]["is_spanned"]) == (2, True, True)
    assert xlsx.place("AB12") == (11, 27) and xlsx.is_date("yyyy-mm-dd") and not xlsx.is_date('0.0"days"')


def test_registry():
    assert reader.find_reader("X.PPTX") is pptx.read
    with pytest.raises(ValueError):
        reader.find_reader("x.pdf")


def test_corpus_datasource_cli_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in {"a.docx": docx_file(), "b.pptx": pptx_file(), "c.xlsx": writer.xlsx(["x", "y"]), "bad.hwpx": b"no zip", "note.txt": b"-"}.items():
        (folder / name).write_bytes(data)
    frames = reader.read_packages(spark, str(folder))
    assert [r.doc_id.rpartition("/")[2] for r in frames.errors.collect()] == ["bad.hwpx"] and frames.elements.select("doc_id").distinct().count() == 3
    with pytest.raises(Exception, match="BadZipFile|zip"):
        reader.parse_packages(spark.createDataFrame([("bad.hwpx", bytearray(b"no"))], "path string, content binary"), strict=True).collect()
    spark.dataSource.register(reader.OfficeDataSource)
    direct = spark.read.format("officedoc").option("path", str(folder)).load()
    assert direct.count() == frames.elements.count()
    out = {k: str(tmp_path / f"out.{k}") for k in ("json", "md", "rag", "debug")}
    cli.run(spark, [str(folder / "b.pptx"), "--output-json", out["json"], "--output-md", out["md"], "--output-rag-json", out["rag"], "--output-debug-json", out["debug"], "--assets-dir", str(tmp_path / "assets"), "--reading-order", "xy_cut"])
    doc, debug = json.load(open(out["json"])), json.load(open(out["debug"]))
    assert [p["page_number"] for p in doc["pages"]] == [1, 2] and debug["num_pages"] == 2 and os.listdir(tmp_path / "assets") == ["slide001_shape0005.png"]
    assert "# Title" in open(out["md"]).read() and json.load(open(out["rag"]))[0]["chunk_id"] == "CH_00001"
    with pytest.raises(ValueError):
        cli.run(spark, [str(folder / "note.txt")])

    from leafstack.streaming import packages as stream

    for _ in range(2):  # the second run finds nothing new
        stream.run_pipeline(spark, str(folder), str(tmp_path / "lake"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lake/markdown")).count() == 3 and spark.read.parquet(str(tmp_path / "lake/errors")).count() >= 1
