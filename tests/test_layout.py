import random

import pytest
from pyspark.sql import functions as F

from leafstack.config import ParserConfig
from leafstack.operators import layout, ordering

CFG = ParserConfig(containment_threshold=0.5)


def rows(df, key="element_id"):
    return {r[key]: r for r in df.collect()}


def test_text_in_text_merges(elements):
    e = elements({"element_id": "OUTER", "box": (0.1, 0.1, 0.5, 0.4), "text": "outer"}, {"element_id": "INNER", "box": (0.15, 0.15, 0.3, 0.2), "text": "inner"})
    got = rows(layout.resolve_containment(e, CFG))
    assert got["INNER"].absorbed_by == "OUTER" and got["OUTER"].text == "outer\ninner" and got["OUTER"].merged_children == ["INNER"]


def test_shape_group_gathers_children(elements):
    e = elements(
        {"element_id": "BOX", "element_type": "unknown", "box": (0.05, 0.05, 0.6, 0.6), "text": ""},
        {"element_id": "T1", "box": (0.1, 0.1, 0.4, 0.1), "text": "one"},
        {"element_id": "T2", "box": (0.1, 0.25, 0.4, 0.1), "text": "two"},
        {"element_id": "I1", "element_type": "image", "box": (0.1, 0.4, 0.2, 0.15)},
    )
    got = rows(layout.resolve_containment(e, CFG))
    assert [got[k].absorbed_by for k in ("T1", "T2", "I1")] == ["BOX"] * 3
    assert [c.content for c in got["BOX"].absorbed_children] == ["one", "two", "![I1](image-not-exported)"] and got["BOX"].text == "one\ntwo"


def test_flow_and_disjoint_boxes_stay(elements):
    flow = elements({"layout": "flow", "box": (0.1, 0.1, 0.8, 0.5), "text": "a"}, {"layout": "flow", "box": (0.1, 0.15, 0.8, 0.05), "text": "b"})
    apart = elements({"box": (0.0, 0.0, 0.3, 0.3)}, {"box": (0.5, 0.5, 0.3, 0.3)})
    for e in (flow, apart):
        assert layout.containment_parents(e, CFG).count() == 0 and layout.resolve_containment(e, CFG).filter("absorbed_by IS NOT NULL").count() == 0


def test_nested_text_moves_one_level(elements):
    e = elements({"element_id": "A", "box": (0, 0, 0.9, 0.9), "text": "a"}, {"element_id": "B", "box": (0.1, 0.1, 0.5, 0.5), "text": "b"}, {"element_id": "C", "box": (0.2, 0.2, 0.1, 0.1), "text": "c"})
    got = rows(layout.resolve_containment(e, CFG))
    assert got["A"].text == "a\nb" and got["B"].text == "b\nc" and got["C"].absorbed_by == "B"


def cells(spark, boxes, ordinal=0):
    from leafstack.schema import CELLS

    return spark.createDataFrame([("d", 1, ordinal, i, i, 0, "", None, False, 1, 1, None, *map(float, b)) for i, b in enumerate(boxes)], CELLS)


def test_absorb_picks_best_cell_and_first_of_equals(spark, elements):
    e = elements({"element_id": "TB", "element_type": "table", "box": (0, 0, 1, 1)}, {"element_id": "IMG", "element_type": "image", "box": (0.04, 0.21, 0.57, 0.19)})
    got = layout.absorb_into_tables(e, cells(spark, [(0.01, 0.15, 0.98, 0.04), (0.01, 0.19, 0.98, 0.81), (0.01, 0.19, 0.98, 0.81)]), ParserConfig()).collect()
    assert [(r.ordinal, r.table_ordinal, r.cell_idx) for r in got] == [(1, 0, 1)]


def test_absorbed_table_takes_nothing(spark, elements):
    e = elements(
        {"element_type": "table", "box": (0, 0, 1, 1)}, {"element_type": "table", "box": (0.1, 0.1, 0.3, 0.3)}, {"element_id": "T", "box": (0.15, 0.15, 0.1, 0.1)},
    )
    both = cells(spark, [(0, 0, 1, 1)], 0).unionByName(cells(spark, [(0.1, 0.1, 0.3, 0.3)], 1))
    got = {r.ordinal: r.table_ordinal for r in layout.absorb_into_tables(e, both, ParserConfig()).collect()}
    assert got == {1: 0, 2: 0}


def test_image_labels(elements):
    image = {"element_id": "IMG", "element_type": "image", "box": (0.1, 0.1, 0.5, 0.5)}
    e = elements(image, {"text": "Label", "box": (0.2, 0.2, 0.05, 0.03)}, {"text": "x" * 100, "box": (0.2, 0.3, 0.05, 0.03)}, {"text": "Far", "box": (0.8, 0.8, 0.05, 0.03)})
    assert [(r.ordinal, r.image_ordinal) for r in layout.annotate_images(e, ParserConfig()).collect()] == [(1, 0)]


def test_noise_truth_table(elements):
    big, tiny = (0, 0, 0.5, 0.5), (0, 0, 0.005, 0.005)
    e = elements(
        {"element_type": "unknown", "text": "", "box": big}, {"text": "", "box": big}, {"text": " 　\n", "box": big}, {"text": "words", "box": big},
        {"element_type": "image", "box": big}, {"element_type": "image", "box": tiny}, {"element_type": "image", "text": "words", "box": tiny},
    )
    kept = {r.ordinal for r in layout.drop_noise(e, ParserConfig()).collect()}
    assert kept == {3, 4, 6}


def test_empty_page(elements):
    none = elements({"text": "a"}).limit(0)
    assert layout.resolve_containment(none, CFG).count() == 0 and layout.annotate_images(none, CFG).count() == 0


def random_page(rng, n):
    return [{"element_id": f"E{i}", "z_order": rng.randrange(3), "box": tuple(rng.choice((0.0, 0.1, 0.13, 0.25, 0.4, 0.6, 0.8)) for _ in range(2)) + tuple(rng.choice((0.02, 0.05, 0.1, 0.3)) for _ in range(2))} for i in range(n)]


def test_row_order(elements):
    e = elements(*({"element_id": k, "box": (*at, 0.1, 0.05)} for k, at in (("B", (0.7, 0.1)), ("A", (0.1, 0.1)), ("C", (0.2, 0.3)))))
    got = ordering.row_clustering(e, ParserConfig()).orderBy("read_ord").collect()
    assert [r.element_id for r in got] == ["A", "B", "C"]


def cut_by_hand(items, least, path="0"):
    """Recursive description of the cuts, to compare with."""
    if len(items) > 1:
        for name, at, size in (("h", "y", "height"), ("v", "x", "width")):
            byline = sorted(items, key=lambda r: r[at])
            best, where, end = 0.0, None, byline[0][at] + byline[0][size]
            for i, r in enumerate(byline[1:], 1):
                if r[at] - end > best:
                    best, where = r[at] - end, i
                end = max(end, r[at] + r[size])
            if where and best >= least:
                return cut_by_hand(byline[:where], least, f"{path}.{name}0") + cut_by_hand(byline[where:], least, f"{path}.{name}1")
    return [(r["ordinal"], path) for r in sorted(items, key=lambda r: (r["y"], r["x"], r["z_order"], r["ordinal"]))]


def test_xy_cut_and_rows_against_description(elements):
    rng = random.Random(5)
    data = []
    for d in range(40):
        data += [r | {"doc_id": str(d)} for r in random_page(rng, rng.randrange(1, 14))]
    e = elements(*data)
    base = {}
    for r in e.collect():
        base.setdefault(r.doc_id, []).append(r.asDict())
    got = {}
    for r in ordering.xy_cut(e, ParserConfig()).orderBy("read_ord").collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.spatial_group))
    assert got == {d: cut_by_hand(items, 0.006) for d, items in base.items()}
    lines = {}
    for r in ordering.row_clustering(e, ParserConfig()).orderBy("read_ord").collect():
        lines.setdefault(r.doc_id, []).append(r.ordinal)
    for d, items in base.items():
        groups = []
        for r in sorted(items, key=lambda r: (r["y"], r["x"], r["z_order"])):
            home = next((g for g in groups if abs(r["y"] - g[0]["y"]) <= 0.02), None)
            if home is None:
                groups.append([r])
            else:
                home.append(r)
        assert lines[d] == [r["ordinal"] for g in groups for r in sorted(g, key=lambda r: (r["x"], r["z_order"]))]


def test_composite_and_stored_order(elements, pages):
    e = elements({"element_id": "A", "box": (0, 0.9, 0.1, 0.05), "placeholder_idx": 1}, {"element_id": "B", "box": (0, 0.1, 0.1, 0.05)}, {"element_id": "C", "box": (0, 0.5, 0.1, 0.05), "placeholder_idx": 0})
    got = ordering.composite(e, ParserConfig()).orderBy("read_ord").collect()
    assert [(r.element_id, r.spatial_group) for r in got] == [("C", "ph"), ("A", "ph"), ("B", "0")]
    kept = ordering.reading_order(pages({"source_format": "docx"}), e.withColumn("z_order", F.lit(9) - F.col("ordinal")), ParserConfig()).orderBy("read_ord").collect()
    assert [r.element_id for r in kept] == ["C", "B", "A"]
    assert ordering.STRATEGIES.get("nonsense", ordering.composite) is ordering.composite


@pytest.mark.parametrize("text,kept", [(None, 0), ("x", 1)])
def test_null_text(elements, text, kept):
    assert layout.drop_noise(elements({"text": text}), ParserConfig()).count() == kept
