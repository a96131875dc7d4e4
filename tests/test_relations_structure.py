from pyspark.sql import functions as F

from leafstack.config import ParserConfig
from leafstack.operators import markdown, rag, relations, structure, tables


def stored(e):
    return e.withColumn("read_ord", F.col("ordinal") + 1).withColumn("spatial_group", F.lit(None).cast("string"))


def test_caption_found_and_verified(elements):
    e = stored(elements({"element_id": "IMG1", "element_type": "image", "box": (0.1, 0.2, 0.3, 0.2)}, {"element_id": "TXT1", "text": "Figure caption", "box": (0.1, 0.42, 0.3, 0.05)}))
    rels, log = relations.relations(e, ParserConfig(caption_max_gap=0.08, alignment_tolerance=0.2))
    row = rels.filter("relation_type = 'caption_of'").collect()
    assert [(r.source_element_id, r.target_element_id) for r in row] == [("TXT1", "IMG1")] and log.filter("proximity IS NOT NULL").count() == 1
    strict = ParserConfig(caption_max_gap=0.3, caption_rule_threshold=0.95, caption_vlm_threshold=0.2)
    yes = F.struct(F.lit(True).alias("is_caption"), F.lit(0.91).alias("confidence"))
    row = relations.relations(e, strict, yes)[0].filter("relation_type = 'caption_of'").first()
    assert row.method == "vlm_fallback" and row.confidence == 0.91
    assert relations.relations(e, strict, relations.no_op_verifier())[0].filter("method = 'vlm_rejected'").count() == 1


def test_one_visual_per_text_and_log(elements):
    e = stored(elements({"element_type": "image", "box": (0.1, 0.2, 0.2, 0.2)}, {"element_type": "image", "box": (0.5, 0.2, 0.2, 0.2)}, {"text": "Figure", "box": (0.1, 0.42, 0.6, 0.05)}, {"element_type": "table", "box": (0.9, 0.9, 0.05, 0.05)}))
    rels, log = relations.relations(e, ParserConfig(caption_max_gap=0.3, alignment_tolerance=0.2))
    assert rels.filter("relation_type <> 'title_of'").count() == 1
    assert sorted(r.rejected_reason or "-" for r in log.collect()) == ["-", "caption_already_assigned", "no_candidate"]


def test_title_scope(elements):
    cases = [((0.1, 0.05, 0.3, 0.05), (0.1, 0.15, 0.3, 0.1), 0.5, 1), ((0.1, 0.5, 0.3, 0.05), (0.1, 0.1, 0.3, 0.1), 0.5, 0), ((0.1, 0.05, 0.3, 0.05), (0.1, 0.8, 0.3, 0.1), 0.3, 0), ((0.1, 0.1, 0.3, 0.05), (0.1, 0.15, 0.3, 0.1), 0.01, 1)]
    for title, target, most, n in cases:
        e = stored(elements({"text": "Title", "box": title}, {"element_type": "image", "box": target}))
        assert relations.title_relations(e, ParserConfig(title_max_y_distance=most)).count() == n


def test_outline_nesting(elements, pages):
    e = stored(elements(
        {"element_id": "h1", "text": "One", "is_heading": True, "heading_level": 1}, {"element_id": "h3", "text": "Deep", "is_heading": True, "heading_level": 3}, {"element_id": "p", "text": "para"},
        {"element_id": "h2", "text": "Two", "is_heading": True, "heading_level": 2}, {"element_id": "t", "element_type": "table"}, {"element_id": "h9", "text": "", "is_heading": True, "heading_level": 9},
    ))
    got = {r.block_idx: r for r in structure.blocks(pages({"source_format": "xlsx", "sheet_name": "S"}), e).collect()}
    assert [(got[i].kind, got[i].level, got[i].parent_block_id, got[i].section_path) for i in sorted(got)] == [
        ("container", 1, None, []), ("heading", 1, "B_001_0001", ["One"]), ("heading", 3, "B_001_0002", ["One", "Deep"]), ("heading", 2, "B_001_0002", ["One", "Two"]),
        ("table", 0, "B_001_0004", ["One", "Two"]), ("heading", 6, "B_001_0004", ["One", "Two", "heading"]),
    ]
    assert got[3].element_ids == ["h3", "p"]


def test_title_keeps_its_targets(elements, pages):
    e = stored(elements({"element_id": "t", "text": "Title", "is_heading": True, "heading_level": 2}, {"element_id": "h", "text": "Later", "is_heading": True, "heading_level": 2}, {"element_id": "p", "text": "para"}))
    links = e.select("doc_id", "page_number").distinct().withColumn("source_ordinal", F.lit(0)).withColumn("target_ordinal", F.lit(2))
    got = {r.block_idx: r.element_ids for r in structure.blocks(pages({}), e, links).collect()}
    assert got == {1: ["t", "p"], 2: ["h"]}


def cell_frame(spark, rows):
    from leafstack.schema import CELLS

    return spark.createDataFrame([("d", 1, 0, i, r, c, t, None, s, w, h, None, None, None, None, None) for i, (r, c, t, s, w, h) in enumerate(rows)], CELLS)


def test_tables(spark):
    cells = cell_frame(spark, [(0, 0, "H", False, 2, 1), (0, 1, None, True, 1, 1), (1, 0, "a\nb ", False, 1, 1), (1, 1, None, False, 1, 1), (3, 1, "z", False, 1, 1)])
    widths = spark.createDataFrame([("d", 1, 0, [1000.0, 3000.0])], "doc_id string, page_number int, ordinal int, col_widths array<double>")
    assert tables.html_tables(cells, widths=widths).first().html == (
        '<table>\n<colgroup>\n<col style="width:25.0%"/>\n<col style="width:75.0%"/>\n</colgroup>\n<thead>\n<tr><th colspan="2">H</th></tr>\n</thead>\n<tbody>\n'
        "<tr><td>a<br/>b</td><td></td></tr>\n<tr></tr>\n<tr><td>z</td></tr>\n</tbody>\n</table>"
    )
    assert tables.pipe_tables(cells).first().markdown == "| H |  |\n| --- | --- |\n| a\nb |  |\n|  |  |\n|  | z |"
    assert tables.nested_html(cells).first().html.startswith('<table>\n<tr><td colspan="2">H</td></tr>')


def test_header_rows(spark):
    for first, rows, want in (((1, 2), 3, 2), ((1, 1), 3, 1), ((1, 5), 2, 2)):
        cells = cell_frame(spark, [(0, 0, "H", False, *first), *((r, 1, "x", False, 1, 1) for r in range(rows))])
        head = tables.header_rows(tables.usable(cells).withColumn("content", tables.cell_content(False))).first()
        assert head.header_rows == want


def test_absorbed_content_around_the_middle(spark):
    df = spark.sql(f"""SELECT 'base' AS text, CAST(NULL AS string) AS formatted_text, cy, ch, CAST(array(named_struct('y', 0.1D, 'x', 0D, 'ordinal', 1, 'content', '![I](i.png)', 'width', 7, 'element_id', 'I', 'type', 'image', 'containment', 1D), named_struct('y', 0.9D, 'x', 0D, 'ordinal', 2, 'content', 'low', 'width', NULL, 'element_id', 'J', 'type', 'text', 'containment', 1D)) AS {tables.ABSORBED}) AS absorbed_elements
        FROM VALUES (0.0D, 1.0D), (CAST(NULL AS double), CAST(NULL AS double)) AS t(cy, ch)""")
    got = [r[0] for r in df.select(tables.cell_content(True, True)).collect()]
    assert got == ['<img src="i.png" alt="I" width="7"/><br/>base<br/>low', 'base<br/><img src="i.png" alt="I" width="7"/><br/>low']


def test_column_break(spark):
    df = spark.createDataFrame([("0.v0", "0.v1", True), ("0.h0", "0.h1", False), ("0.h0.v1", "0.h1.v0", False), ("0", "0.v1", True), ("0.v1", "0", False), ("a", "a", False), (None, "0.v1", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", markdown.column_break(F.col("a"), F.col("b")).alias("got")).collect())


def test_page_markdown(elements, pages):
    e = stored(elements({"text": "Deck\ttitle", "is_placeholder": True}, {"text": "Second", "is_placeholder": True}, {"text": "a \nb"}, {"element_id": "I", "element_type": "image", "image_ref": "i.png", "image_width": 5}, {"element_type": "chart"}))
    got = markdown.render_documents(markdown.render_pages(pages({}), e, ParserConfig())).first().markdown
    assert got == '<!-- Page 1 -->\n\n# Deck · title\n\nSecond\n\na  \nb\n\n<img src="i.png" alt="I" width="5"/>\n\n> [chart]\n'


def test_rag_split_and_chunks(elements, pages):
    assert rag.split_parts("A" * 800 + "\n\n" + "B" * 800, 900) == ["A" * 800, "B" * 800]
    assert rag.split_parts("", 5) == [""] and "".join(rag.split_parts("x" * 23, 5)) == "x" * 23
    e = stored(elements({"element_id": "h", "text": "Head", "is_heading": True, "heading_level": 1}, {"element_id": "p", "text": "body"}, {"element_id": "i", "element_type": "image"}))
    blocks = structure.blocks(pages({}), e)
    captions = e.sparkSession.createDataFrame([("d", "i", "cap")], "doc_id string, target_element_id string, caption string")
    got = rag.chunks_from_blocks(blocks, e, ParserConfig(), captions).orderBy("chunk_idx").collect()
    assert [(r.chunk_id, r.text) for r in got] == [("CH_00001", "Head\n\nbody"), ("CH_00002", "[CAPTION] cap")]
