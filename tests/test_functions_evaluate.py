import random

import pytest
from pyspark.sql import functions as F

from leafstack.config import ParserConfig
from leafstack.functions import runs
from leafstack.functions import text as tx
from leafstack.operators import evaluate, nested


def test_config():
    assert ParserConfig.from_json('{"title_max_len": 5}').title_max_len == 5
    with pytest.raises(TypeError):
        ParserConfig.from_json('{"unknown_knob": 1}')


def test_text_functions(spark):
    df = spark.createDataFrame([("\x1c a \n b　",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(tx.stripped(F.col("t")), tx.line_breaks_html(tx.stripped(F.col("t")))).collect()]
    assert got == [("a \n b", "a<br/> b"), ("", ""), ("", "")]
    r = spark.range(1).select(tx.roman(F.lit(1994)), tx.auto_number(F.lit("romanLcPeriod"), F.lit(4)), tx.auto_number(F.lit("circleNumWdWhitePlain"), F.lit(20)), tx.auto_number(F.lit("arabicPlain"), F.lit(3)), tx.images_to_html(F.lit("![a](b)"), F.lit(0))).first()
    assert tuple(r) == ("MCMXCIV", "iv. ", "⑳ ", "3 ", '<img src="b" alt="a"/>')


def test_runs(spark):
    rows = [("s", 0, 0, "plain text here ", False, False, False), ("s", 0, 1, "bold", True, False, False), ("s", 0, 2, "er", True, False, False), ("s", 1, 3, "u", False, True, True), ("t", 0, 0, "all bold", True, False, False), ("n", 0, 0, None, True, False, False)]
    df = spark.createDataFrame(rows, "shape string, par int, run_idx int, text string, bold boolean, italic boolean, underline boolean")
    got = {r.shape: r.formatted for r in runs.formatted(df, ["shape"]).collect()}
    assert got == {"s": "plain text here **bolder**\n*<u>u</u>*", "t": "all bold"}
    assert {r.shape: r.formatted for r in runs.formatted(df, ["shape"], html=True).collect()}["s"].endswith("<b>bolder</b>\n<i><u>u</u></i>")


def test_metrics_against_definitions(spark):
    rng = random.Random(1)
    expected, predicted, want = [], [], {}
    for d in range(30):
        ids = [f"i{k}" for k in range(rng.randrange(0, 9))]
        other = [i for i in ids if rng.random() < 0.8] + ["new"] * (rng.random() < 0.5)
        rng.shuffle(other)
        expected += [(str(d), 1, i, k) for k, i in enumerate(ids)]
        predicted += [(str(d), 1, i, k) for k, i in enumerate(other)]
        common = [i for i in ids if i in other]
        signs = [1 if other.index(a) < other.index(b) else -1 for k, a in enumerate(common) for b in common[k + 1 :]]
        table = [[i + j if not i * j else 0 for j in range(len(other) + 1)] for i in range(len(ids) + 1)]
        for i, a in enumerate(ids, 1):
            for j, b in enumerate(other, 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a != b))
        want[str(d)] = (sum(signs) / len(signs) if signs else 1.0, 1 - table[-1][-1] / max(len(ids), len(other)) if ids or other else 1.0, bool(ids), bool(ids or other))
    frame = lambda x: spark.createDataFrame(x, "doc_id string, page_number int, id string, pos int")
    tau = {r.doc_id: r.tau for r in evaluate.kendall_tau(frame(expected), frame(predicted)).collect()}
    ned = {r.doc_id: r.ned for r in evaluate.edit_similarity(frame(expected), frame(predicted)).collect()}
    assert tau == {d: w[0] for d, w in want.items() if w[2]} and all(abs(ned[d] - w[1]) < 1e-12 for d, w in want.items() if w[3])


def test_prf(spark):
    kind = "relation_type string, source_element_id string, target_element_id string"
    g = spark.createDataFrame([("a", "1", "2"), ("a", "1", "3"), ("b", "1", "2"), ("a", "1", "2")], kind)
    p = spark.createDataFrame([("a", "1", "2"), ("b", "9", "9")], kind)
    got = {r.relation_type: (r.tp, r.fp, r.fn, r.f1) for r in evaluate.relation_prf(g, p, digits=4).collect()}
    assert got == {"a": (1, 0, 1, 0.6667), "b": (0, 1, 1, 0.0), "_overall": (1, 1, 2, 0.4)}


def test_nested_records(spark):
    cell = '{"row": "0", "col": 1.0, "span_width": "2", "text": "x", "absorbed_elements": {"element_id": "A", "type": "text", "containment": "0.5"}}'
    payloads = [
        (1, '{"pages": {"page_number": 1, "elements": [{"element_id": "E1"}, {"metadata": {"table_cells": [%s, {"span_height": null}, null]}}]}}' % cell),
        (1, '{"pages": {"page_number": 1, "elements": [{"element_id": "E1"}, {"metadata": {"table_cells": [%s, {"span_height": null}, null]}}]}}' % cell),
        (2, '{"pages": [{"elements": {"metadata": "{\\"table_cells\\": {\\"span_height\\": 3.0}}"}}, null]}'), (3, None), (4, "not json"), (5, "{}"), (6, '{"pages": null}'), (7, '{"pages": [{"elements": [{"metadata": {"table_cells": null}}]}]}'), (8, "[]"),
    ]
    df = spark.createDataFrame(payloads, "record_id long, payload string").withColumn("page_pos", F.lit(1))
    assert sorted(map(tuple, nested.merged_cells(df).collect())) == [(1, 1, 2, 1), (2, 1, 1, 1)]
    rows = {n: nested.flatten_records(df, n).orderBy("record_id", "page_pos").collect() for n in nested.LEVELS}
    assert [(r.record_id, r.page_pos, r.page_number) for r in rows["pages"]] == [(1, 1, 1), (2, 1, None), (2, 2, None), (7, 1, None)]
    assert len(rows["elements"]) == 4 and len(rows["cells"]) == 4 and [(r.element_id, r.cell_pos, r.absorbed_pos, r.containment) for r in rows["absorbed"]] == [("A", 1, 1, 0.5)]
    first = sorted(rows["cells"], key=lambda r: (r.record_id, r.cell_pos))[0]
    assert (first.row, first.col, first.span_width, first.span_height, first.text) == (0, 1, 2, None, "x")
    assert nested.flatten_records(df.limit(0), "cells").count() == 0
    with pytest.raises(ValueError):
        nested.flatten_records(df, "rows")
