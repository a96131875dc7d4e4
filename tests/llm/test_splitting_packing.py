import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafstack.llm import packing, splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!é字。", max_size=400), st.integers(1, 60), st.integers(0, 70))
def test_pieces_rebuild_the_text(text, limit, overlap):
    spans = splitting.split_spans(text, limit, overlap)
    shared = min(overlap, limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= limit for a, b in spans)
    assert all(c == b - shared and d > b for (a, b), (c, d) in zip(spans, spans[1:]))


def strongest(text, lo, hi):
    s = splitting.boundary_strengths(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    return max(range(lo, hi + 1), key=lambda i: (s[i], i))


def test_cuts_are_the_strongest_of_their_window():
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "end. ", "line\n", "par\n\n", "longer "]) for _ in range(400))
    for limit, overlap in ((50, 0), (120, 30)):
        for a, b in splitting.split_spans(text, limit, overlap)[:-1]:
            assert b == strongest(text, a + max(overlap + 1, (limit + 1) // 2), a + limit)


def test_marks_stay_with_their_letters():
    spans = splitting.split_spans("é" * 50, 7, 0)
    assert all(a % 2 == 0 for a, _ in spans)


def test_very_long_text_in_stretches(monkeypatch):
    text = "some words. and more\n" * 3000
    whole = splitting.split_spans(text, 90, 9)
    monkeypatch.setattr(splitting, "STRETCH", 5000)
    assert splitting.split_spans(text, 90, 9) == whole


def test_special_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5, 0), (2, "", 5, 0), (3, "abc def", None, 1), (4, "abc def", 0, 1), (5, "abc def", 4, None), (5, "abc def", 4, None)], "id int, text string, lim int, ov int")
    got = splitting.split_oversized(df, "text", "lim", "ov").orderBy("id", "piece_no").collect()
    assert [(r.id, r.piece_no, r.piece_text, r.piece_count) for r in got] == [(1, None, None, 0), (2, 1, "", 1), (3, 1, "abc def", 1), (4, 1, "abc def", 1), (5, 1, "abc ", 2), (5, 1, "abc ", 2), (5, 2, "def", 2), (5, 2, "def", 2)]
    clash = df.withColumns({"Piece_No": F.lit("x"), "spans": F.lit(1), "row": F.lit(2), "i": F.lit(3), "_s": F.lit(4), "__n": F.lit(5)})
    again = splitting.split_oversized(clash, "text", "lim", "ov").orderBy("id", "piece_no").collect()
    assert [(r.id, r.piece_no, r.piece_text, r.piece_count, r.spans, r.row, r.i, r._s, r["__n"]) for r in again] == [(r.id, r.piece_no, r.piece_text, r.piece_count, 1, 2, 3, 4, 5) for r in got]
    assert splitting.split_oversized(df.limit(0), "text", "lim").count() == 0
    assert [r.id for r in splitting.oversized(df, ["id"], "text", "lim", "ov").collect()] == [5]


def fewest(sizes, capacity):
    """Smallest number of containers, by search."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_hold(sizes):
    box = packing.best_fit_decreasing(np.array(sizes), 20)
    fill = np.bincount(box, weights=sizes)
    optimum = fewest(sizes, 20)
    assert fill.max() <= 20 and packing.lower_bound(np.array(sizes), 20) <= optimum <= len(fill)


def test_pack_exchanges_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION", 16)
    rng = random.Random(3)
    rows = [("a", 100, f"i{i}", rng.choice((51, 49, 34, 33, 70, 30, 0))) for i in range(300)] + [("b", 10, "only", 10)]
    items = spark.createDataFrame(rows, "pool string, capacity int, item string, size int")
    got = packing.pack(items).collect()
    assert sorted((r.pool, r["item"], r["size"]) for r in got) == sorted((p, i, s) for p, _, i, s in rows)
    fill = {}
    for r in got:
        fill[r.pool, r.container] = fill.get((r.pool, r.container), 0) + r["size"]
    assert all(v <= (100 if p == "a" else 10) for (p, _), v in fill.items())
    alone = packing.pack(items, rounds=0).select("pool", "container").distinct().count()
    assert len(fill) <= alone
    assert packing.pack(items.limit(0)).count() == 0


def test_chunks_beyond_the_capacity_are_cut(spark):
    chunks = spark.createDataFrame([("c", 1, "x", "aaaa bbbb cccc"), ("c", 1, "x", "aaaa bbbb cccc"), ("c", 1, "n", None), ("c", 2, "e", ""), ("none", 3, "y", "text")], "config_id string, package_id long, chunk_id string, text string")
    configs = spark.createDataFrame([("c", 5)], "config_id string, chunk_max_chars int")
    got = packing.pack_chunks(chunks, configs)
    assert sorted((r.chunk_id, r.piece_no, r["size"]) for r in got.collect()) == [("e", 1, 0), ("n", 1, 0), ("x", 1, 5), ("x", 2, 5), ("x", 3, 4)]
    report = packing.packing_report(got).first()
    assert report.containers == report.lower_bound == 3 and report.gap == 0
    assert [r.chunk_id for r in packing.unpackable(chunks, configs).collect()] == ["y"]


def test_all_partitions_of_a_large_pool_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION", 8)
    sizes = [(i * 7919) % 83 + 8 for i in range(1200)]
    items = spark.createDataFrame([("p", 100, f"i{i}", n) for i, n in enumerate(sizes)], "pool string, capacity int, item string, size int")
    got, none = packing.pack(items).collect(), packing.pack(items, 0).collect()
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r["size"]
    assert sorted(r.item for r in got) == sorted(f"i{i}" for i in range(1200)) and max(fill.values()) <= 100
    assert len(fill) < len({r.container for r in none})


def test_null_keys_and_extra_columns(spark):
    rows = [("c", None, None, "aaaa bbbb", 1), ("c", 1, None, "aaaa", 1), ("c", None, "a", "aaaa", 2), ("c", 2, "s\x1ft", "x", 1), (None, 1, "q", "x", 1)]
    chunks = spark.createDataFrame(rows, "config_id string, package_id long, chunk_id string, text string, size int")
    configs = spark.createDataFrame([("c", 6), (None, 9)], "config_id string, chunk_max_chars int")
    got = sorted(((r.package_id, r.chunk_id, r.piece_no, r["size"]) for r in packing.pack_chunks(chunks, configs).collect()), key=str)
    assert got == sorted([(None, None, 1, 5), (None, None, 2, 4), (1, None, 1, 4), (None, "a", 1, 4), (2, "s\x1ft", 1, 1)], key=str)
    audit = packing.packing_audit(packing.pack_chunks(chunks, configs)).first()
    assert (audit.chunks, audit.split_chunks, audit.chars, audit.overfull, audit.enough) == (4, 1, 18, 0, True)


def test_bound_equals_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        c = int(rng.integers(3, 60))
        sizes = rng.integers(0, c + 1, int(rng.integers(1, 40)))
        best = 0
        for e in range(0, c // 2 + 1):
            best = max(best, -(-sum(c if s > c - e else 0 if s < e else int(s) for s in sizes) // c))
        assert packing.lower_bound(sizes, c) >= best


def test_stretches_cut_as_a_whole_text_would(monkeypatch):
    rng = random.Random(1)
    pieces = ["word ", "end. ", "x" * 30, "\n", "\n \n", "\n\n", ".\u201d ", "   ", "\u0301"]
    texts = ["".join(rng.choice(pieces) for _ in range(600)) for _ in range(12)]
    whole = [splitting.split_spans(t, 40, 7) for t in texts]
    monkeypatch.setattr(splitting, "STRETCH", 200)
    assert [splitting.split_spans(t, 40, 7) for t in texts] == whole
