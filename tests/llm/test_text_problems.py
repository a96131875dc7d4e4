import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.llm import boilerplate, canonical, contamination, mixing, truncation

ALIKE = [
    ("Ｅｎｔｒéｅ", "Entrée"), ("Hoмеp", "Номер"), ("Phase Ⅳ", "Phase IV"), ("ﬂat", "flat"), ("Ω", "Ω"), ("µm", "μm"),
    ("a b", "a b"), ("a‑b", "a-b"), ("so­ft", "soft"), ("한", "한"), ("Cοst", "Cost"),
]
APART = [("Cafe", "Café"), ("m²", "m2"), ("CO₂", "CO2"), ("③", "3"), ("Open", "open"), ("a b", "a  b"), ("a b", "a\nb"), ("mиr", "mir")]


def test_looks(spark):
    rows = [(i, t) for i, pair in enumerate(ALIKE + APART) for t in pair]
    got = canonical.canonicalize(spark.createDataFrame(rows, "id int, text string"), "text").collect()
    forms = {}
    for r in got:
        forms.setdefault(r.id, set()).add(r.canonical)
    assert [len(forms[i]) for i in range(len(rows) // 2)] == [1] * len(ALIKE) + [2] * len(APART)


def test_composed_letters_of_look_alikes(spark):
    # Cyrillic and Greek letters under Latin accents, composed and decomposed, and Hangul letters of half width.
    pairs = [("gr\u043e\u0308ss", "gröss"), ("\u0410\u0308rger", "Ärger"), ("\u04e7l", "öl"), ("\u03bf\u0301", "ó"), ("\uffa1", "\u3131"), ("\u045et", "\u0443\u0306t"), ("\u1f40x", "o\u0313x")]
    rows = [(i, t) for i, pair in enumerate(pairs) for t in pair]
    got = canonical.canonicalize(spark.createDataFrame(rows, "id int, text string"), "text").collect()
    forms = {}
    for r in got:
        forms.setdefault(r.id, set()).add(r.canonical)
    assert all(len(f) == 1 for f in forms.values()), forms


def test_alike_classes(spark):
    rows = [(1, k, "Cost") for k in range(5)] + [(1, 9, "C\u03bfst"), (1, 8, "Ｃost"), (2, 3, "C\u03bfst"), (1, 7, "other"), (1, 6, None), (1, None, "Ｃost")]
    df = spark.createDataFrame(rows + rows[:2], "package_id int, uid int, text string")
    got = {(r.uid, r.class_uid, r.forms, r.links) for r in canonical.alike_classes(df, ["package_id"], "uid", "text").collect()}
    assert got == {(k, 0, 3, 3) for k in range(5)} | {(9, 0, 3, 7), (8, 0, 3, 6), (None, 0, 3, 6)}
    pairs = canonical.alike_pairs(df, ["package_id"], "uid", "text").collect()
    assert len(pairs) == 5 + 5 + 1 and len({(r.uid_a, r.uid_b) for r in pairs}) == 11


def test_alike_pairs(spark):
    rows = [(1, 1, "Cost", "x"), (1, 2, "Cοst", "x"), (1, 2, "Cοst", "x"), (1, 3, "Cost", "x"), (2, 4, "Co​st", "x"), (1, 5, None, "x"), (1, 6, " ", "x"), (1, 7, " ", "x"), (1, 8, "", "x"), (1, 9, "Ｃost", "x")]
    df = spark.createDataFrame(rows, "package_id int, uid int, text string, canonical string")
    got = {(r.package_id, r.uid_a, r.uid_b) for r in canonical.alike_pairs(df, ["package_id"], "uid", "text").collect()}
    assert got == {(1, 1, 2), (1, 2, 3), (1, 1, 9), (1, 2, 9), (1, 3, 9)}
    replaced = canonical.canonicalize(df, "text")
    assert replaced.columns == ["package_id", "uid", "text", "canonical"] and {r.canonical for r in replaced.filter("uid = 2").collect()} == {"Cost"}
    assert canonical.alike_pairs(df.limit(0), ["package_id"], "uid", "text").count() == 0


def test_summaries_miss_nothing():
    rng = np.random.default_rng(1)
    truth, summary = Counter(), boilerplate.Summary(20)
    for _ in range(50):
        keys, counts = np.unique(rng.zipf(1.3, 200) % 1000 + 1, return_counts=True)
        summary.add(keys, counts)
        truth.update(dict(zip(keys.tolist(), counts.tolist())))
    held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert len(held) <= 20 and summary.error <= sum(truth.values()) / 20
    assert all(held.get(k, 0) <= n <= held.get(k, 0) + summary.error for k, n in truth.items())


def packages_and_elements(spark):
    packages = spark.createDataFrame([(i, p) for i, p in enumerate(["/One//a/x.pptx", ".\\one\\b.docx", "ONE/c", "one/d", "two/a", "two/b", "plain.docx"])], "package_id long, source_path string")
    text = "Own %d\n\n © %d  ACME \nlast"
    rows = [(i, i, "one" if i % 2 else None, text % (i, 2000 + i)) for i in range(4)] + [(9, 0, None, "© 7 acme\n© 8 acme"), (10, 4, "two", "© 1 acme"), (11, 6, None, "© 1 acme"), (12, 0, "one", None), (13, 1, "one", ""), (0, 0, None, text % (0, 2000))]
    return packages, spark.createDataFrame(rows, "element_uid long, package_id long, site_code string, text string")


def test_repeated_lines(spark):
    packages, elements = packages_and_elements(spark)
    lines = {(r.site, r.line, r.packages_with_line, r.packages) for r in boilerplate.repeated_lines(elements, packages).collect()}
    assert lines == {("one", "© 0 acme", 4, 4), ("one", "last", 4, 4), ("one", "own 0", 4, 4)}
    places = {tuple(r) for r in boilerplate.repeated_line_places(elements, packages).collect()}
    assert places == {(i, n) for i in range(4) for n in (1, 3, 4)} | {(9, 1), (9, 2)}
    clean = {r.element_uid: (r.clean_text, r.lines_removed) for r in boilerplate.without_repeated_lines(elements, packages).collect()}
    assert clean[1] == ("", 3) and clean[9] == ("", 2) and clean[10] == ("© 1 acme", 0) and clean[12] == (None, 0) and clean[13] == ("", 0)
    assert boilerplate.repeated_line_places(elements.limit(0), packages).count() == 0 and boilerplate.repeated_lines(elements, packages.limit(0)).count() == 0


def test_clashing_names_and_null_columns(spark):
    packages, elements = packages_and_elements(spark)
    more = elements.withColumns({c: F.lit("x") for c in ("site", "SITE_OLD", "clean_text", "lines_removed", "__set", "key", "line", "doc")})
    more = more.unionByName(more.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in more.dtypes)))
    other = packages.withColumns({"site": F.lit("y"), "packages": F.lit(9)}).unionByName(packages.limit(1).select(F.lit(None).cast("long").alias("package_id"), F.lit(None).cast("string").alias("source_path")), allowMissingColumns=True)
    plain = {(r.element_uid, r.clean_text, r.lines_removed) for r in boilerplate.without_repeated_lines(elements, packages).collect()}
    got = {(r.element_uid, r.clean_text, r.lines_removed) for r in boilerplate.without_repeated_lines(more, other).collect()}
    assert got == plain | {(None, None, 0)} and boilerplate.without_repeated_lines(more, other).count() == more.count()
    assert {tuple(r) for r in boilerplate.repeated_line_places(more, other).collect()} == {tuple(r) for r in boilerplate.repeated_line_places(elements, packages).collect()}


def test_null_keys_of_documents(spark):
    rows = [(None, "word " * 9, None, None), (1, "word " * 9, "s", None), (None, None, "s", "a"), (2, "", None, None), (3, "word " * 400_000, "s", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, author string").withColumns({"id": F.lit(0), "size": F.lit(0), "seed": F.lit(1), "window": F.lit("w")})
    targets = spark.createDataFrame([("s", 1.0, 1), (None, 0.5, 2), ("t", None, None)], "source string, target_weight double, max_repeats int").withColumn("size", F.lit(1))
    assert sorted(r.doc_id for r in mixing.mix(docs, targets)[0].collect()) == [1, 3]
    flags = truncation.truncation_flags(docs)
    assert sorted((str(r.doc_id), str(r.source)) for r in flags.collect()) == [("1", "s"), ("2", "None"), ("3", "s"), ("None", "None"), ("None", "s")]
    items = spark.createDataFrame([(7, "word " * 12), (None, "word " * 12), (8, None)], "item_id long, text string").withColumn("hash", F.lit(0))
    assert sorted((str(r.doc_id), str(r.item_id)) for r in contamination.exact_leaks(docs, items).collect()) == [("3", "7"), ("3", "None")]


def test_a_full_summary_still_finds_the_line(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "COUNTERS", 3)
    packages = spark.createDataFrame([(i, "s/x") for i in range(40)], "package_id long, source_path string")
    rows = [(i * 100 + k, i, "s", f"w{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}\n" + ("common" if i % 3 == 0 else "")) for i in range(40) for k in range(5)]
    got = boilerplate.repeated_lines(spark.createDataFrame(rows, "element_uid long, package_id long, site_code string, text string"), packages).collect()
    assert [(r.line, r.packages_with_line) for r in got] == [("common", 14)]


def test_sites_with_more_lines_than_counters(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # digits would all be equal
    packages = spark.createDataFrame([(i, ("long/x", "short/x")[i >= 12]) for i in range(16)], "package_id long, source_path string")
    long = [(i, i, "long", "\n".join([f"own {letters(i * 4000 + k)} x" for k in range(4000)] + ["Seen  often"] * (i % 3 == 0) + ["Seen twice"] * (i in (1, 2)))) for i in range(12)]
    short = [(i, i, "short", f"only {letters(i)}\nPage {i}" + "\nTwo" * (i < 14)) for i in range(12, 16)]
    elements = spark.createDataFrame(long + short, "element_uid long, package_id long, site_code string, text string").coalesce(1)
    lines = {tuple(r) for r in boilerplate.repeated_lines(elements, packages).collect()}
    assert lines == {("long", "seen often", 4, 12), ("short", "page 0", 4, 4)}
    places = {tuple(r) for r in boilerplate.repeated_line_places(elements, packages).collect()}
    assert places == {(i, 4001) for i in (0, 3, 6, 9)} | {(i, 2) for i in range(12, 16)}
    removed = {r.element_uid: r.lines_removed for r in boilerplate.without_repeated_lines(elements, packages).collect()}
    assert removed == {i: int(i >= 12 or i % 3 == 0) for i in range(16)}


@pytest.mark.parametrize("partitions", [1, 2, 8])
@pytest.mark.parametrize("having", [(0, 1, 2), (0, 5, 11), (9, 10, 11), (0, 1, 2, 3)])
def test_footers_of_interleaved_sites(spark, partitions, having):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits would all be equal
    packages = spark.createDataFrame([(i, f"s{i % 20}/x") for i in range(240)], "package_id long, source_path string")
    rows = [(i, i, f"s{i % 20}", "\n".join([f"own {letters(i)} {letters(k)}" for k in range(1000)] + ["The footer"] * (i // 20 in having))) for i in range(240)]
    elements = spark.createDataFrame(rows, "element_uid long, package_id long, site_code string, text string").coalesce(1) if partitions == 1 else spark.createDataFrame(rows, "element_uid long, package_id long, site_code string, text string").repartition(partitions, "element_uid")
    got = {(r.site, r.line, r.packages_with_line) for r in boilerplate.repeated_lines(elements, packages).collect()}
    assert got == {(f"s{k}", "the footer", len(having)) for k in range(20)}


def test_words_see_through_markup():
    assert contamination.words("<b>The</b> <i>quick&nbsp;brown</i>\n> “fox” [quote=me]said[/quote] don&#39;t AT&amp;T") == ["the", "quick", "brown", "fox", "said", "don", "t", "at", "t"]
    assert contamination.words(None) == contamination.words("") == []


def test_tags_of_any_length_part_no_passage(spark):
    item = [f"w{i}" for i in range(12)]
    long = "q" * 5000
    parts = (f'<a href="http://x.example/{long} {long}">', f"[quote={long} {long}]", f"<!-- {long} -->")
    docs = [(k, " ".join([*item[:6], tag, *item[6:]])) for k, tag in enumerate(parts)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in contamination.exact_leaks(d, i).collect()) == [0, 1, 2]
    assert sorted((r.doc_id, r.exact_windows) for r in contamination.tolerant_leaks(d, i).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_leaks(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(30)]
    docs = [
        (1, " ".join(["a", *item[3:15], "b"])), (2, " ".join(["a", *item[3:14], "b"])), (3, "<p>" + ",\n> ".join(x.upper() for x in item[10:25]) + "</p>"), (4, None), (5, ""), (6, " ".join(["x"] * 50)),
        (7, " ".join([*item[:8], "changed", *item[9:20]])), (1, " ".join(["a", *item[3:15], "b"])), (8, " ".join(rng.choice(item) for _ in range(200))),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(100, " ".join(item)), (101, "too short"), (102, None), (103, " ".join(item[:20]))], "item_id long, text string")
    assert sorted(tuple(r) for r in contamination.exact_leaks(d, i).collect()) == [(1, 100), (1, 103), (3, 100)]
    near = {(r.doc_id, r.item_id): r for r in contamination.tolerant_leaks(d, i).collect()}
    assert near[7, 100].overlap_words == 20 and near[7, 100].exact_windows == 0 and near[3, 100].exact_windows == 4
    assert contamination.exact_leaks(d.limit(0), i).count() == 0 and contamination.exact_leaks(d, i.limit(0)).count() == 0


def test_every_mask_set_covers_its_changes():
    for changes in range(5):
        for hit in combinations(range(12), changes):
            assert any(all(m[j] == "0" for j in hit) for m in contamination.masks(changes)), (changes, hit)
    assert contamination.masks(0) == ("1" * 12,)
    with pytest.raises(ValueError):
        contamination.masks(11)


def test_one_and_two_changed_words_anywhere(spark):
    item = [f"w{i}" for i in range(12)]
    changed = [hit for n in (1, 2) for hit in combinations(range(12), n)]
    docs = [(k, " ".join(["a", "b", "c", *("x" if j in hit else w for j, w in enumerate(item)), "d", "e", "f"])) for k, hit in enumerate(changed)]
    docs.append((900, " ".join("x" if j in (0, 5, 9) else w for j, w in enumerate(item))))
    got = contamination.tolerant_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.overlap_words, r.exact_windows, r.doc_pos, r.item_pos) for r in got} == {(k, 12, 0, 3, 0) for k in range(len(changed))}


def test_overlaps_equal_a_plain_search(spark):
    rng = random.Random(8)
    items = {100 + k: [rng.choice("abcdefghij") + str(j % 3) for j in range(60)] for k in range(3)}
    docs = {}
    for k in range(30):
        w = list(items[100 + k % 3])
        # Words are changed at random, or at gaps of 5 and 7 along the whole passage.
        for j in [j for j in range(60) if rng.random() < 0.18] if k < 24 else [j for a in range(k % 5, 60, 12) for j in (a, a + 5) if j < 60]:
            w[j] = "changed"
        docs[k] = ["q", *w, "r"]
    want = {}
    for d, a in docs.items():
        for i, b in items.items():
            best, run = 0, 0
            for shift in range(-len(b), len(a)):
                run = 0
                for p in range(max(0, shift), min(len(a), len(b) + shift) - 11):
                    near = sum(a[p + j] != b[p - shift + j] for j in range(12)) <= 2
                    run = run + 1 if near else 0
                    best = max(best, run + 11 if run else 0)
            if best:
                want[d, i] = best
    frames = (spark.createDataFrame([(k, " ".join(w)) for k, w in side.items()], f"{key} long, text string") for side, key in ((docs, "doc_id"), (items, "item_id")))
    assert {(r.doc_id, r.item_id): r.overlap_words for r in contamination.tolerant_leaks(*frames).collect()} == want and len(want) > 20


def test_leaks_without_a_filter(spark, monkeypatch):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(40)]
    docs = [(k, " ".join(w if rng.random() > 0.1 else "x" for w in item)) for k in range(40)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[5:30]))], "item_id long, text string")
    want = sorted(map(tuple, contamination.tolerant_leaks(d, i).collect()))
    monkeypatch.setattr(contamination, "MOST_BITS", 5)
    assert sorted(map(tuple, contamination.tolerant_leaks(d, i).collect())) == want and len(want) > 30


@pytest.mark.parametrize("words,rate", [(12, 0.1), (12, 0.2), (16, 0.15), (24, 0.2)])
def test_recall_of_substituted_passages(spark, words, rate):
    rng = random.Random(words)
    item = [f"w{i}" for i in range(words)]
    hit = [[rng.random() < rate for _ in item] for _ in range(400)]
    want = {k for k, h in enumerate(hit) if any(sum(h[a : a + 12]) <= 2 for a in range(words - 11))}
    docs = [(k, " ".join(["a", *("x" if c else w for c, w in zip(h, item)), "b"])) for k, h in enumerate(hit)]
    got = contamination.tolerant_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_pivotal_rounding():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 400).astype(float)
    p = np.full(400, 0.37)
    total = np.zeros(400)
    for k in range(300):
        out, left = mixing.pivotal(p, size, np.random.default_rng(k))
        assert abs(out @ size - p @ size) < 1e-6 * (p @ size)
        assert ((out == 0) | (out == 1)).sum() >= 399 and (left < 0 or 0 < out[left] < 1)
        total += out
    assert abs(total.mean() / 300 - 0.37) < 0.01 and abs(total / 300 - 0.37).max() < 0.15


def test_mix_reaches_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = [(i, "word " * (5 + i % 40), "big" if i < 600 else "small" if i < 640 else None if i == 640 else "other") for i in range(660)] + [(1000, None, "big"), (1001, "", "small"), (3, "word " * 8, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("absent", 0.1, 3)], "source string, target_weight double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    got = {r.source: r for r in shares.collect()}
    assert abs(got["big"].actual_share - 0.7 / 0.9) < 0.01 and abs(got["small"].actual_share - 0.2 / 0.9) < 0.01 and got["absent"].tokens == 0
    assert got["small"].most_copies <= 4 and got["big"].most_copies == 1 and chosen.count() == chosen.select("doc_id").distinct().count()
    again = mixing.mix(docs.repartition(7), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def corpus():
    rng = random.Random(6)
    nouns = ["hammer", "lantern", "kettle", "bicycle", "garden", "window", "carpet", "bottle"]
    make = [lambda a, b: f"The {a} stands behind the {b}.", lambda a, b: f"We repaired a {a} with the old {b}.", lambda a, b: f"Never put the {a} near a {b}."]
    return rng, lambda n: " ".join(rng.choice(make)(rng.choice(nouns), rng.choice(nouns)) for _ in range(n))


def test_truncation(spark):
    rng, text = corpus()
    rows, cut = [], set()
    for i in range(900):
        t, source = text(rng.randrange(2, 9)), ("limited", "free")[i % 2]
        if source == "limited" and len(t) > 200:
            whole, t = t, t[:200]
            if t.rstrip()[-1] != "." and whole[200] != ".":  # else it stops between sentences
                cut.add(i)
        elif i % 9 == 0:
            t = t[:-1]  # left without a full stop
        elif i % 9 == 1:
            t += "\n-- \nanna"
        elif i % 9 == 2:
            t += " good luck"
        elif i % 9 == 3:
            t += " :)"
        rows.append((i, t, source, "anna"))
    special = [(2001, text(3) + "<b", "free", "x"), (2002, text(2) + " The ham", "free", "x"), (2003, text(2) + " We repaired a", "free", "x"), (2004, text(2) + " You&nb", "free", "x"), (2005, None, "free", None), (2006, "", None, None), (2007, text(2)[:-1] + "...", "free", "x"), (2008, text(2) + " see site.example/a/1", "free", None)]
    cut |= {2001, 2002, 2003, 2004}
    df = spark.createDataFrame(rows + special + rows[:3], "doc_id long, text string, source string, author string").withColumn("token", F.lit("x"))
    flags = truncation.truncation_flags(df)
    got = {r.doc_id for r in flags.filter("truncated").collect()}
    assert flags.count() == len(rows) + len(special) and len(cut) > 150
    assert len(cut - got) <= 0.02 * len(cut) and len(got - cut) <= 0.02 * len(cut), ([t[-40:] for i, t, *_ in rows if i in cut - got][:30], sorted(got - cut)[:9])
    assert {2001, 2002, 2003, 2004} <= got and not got & {2005, 2006, 2007, 2008}
    rates = {r.source: r for r in truncation.truncation_rates(flags).collect()}
    assert rates["limited"].share > 0.3 and rates["free"].truncated < 20
    assert truncation.truncation_flags(df.limit(0)).count() == 0


def test_cuts_in_long_words_and_tags(spark):
    rng, text = corpus()
    word = "".join(rng.choice("abcdefghij") for _ in range(60))
    rows = [(i, text(4) + f" The {word} stands near a garden.", "a") for i in range(60)]
    rows += [(100, text(3) + f" The {word[:45]}", "a"), (101, text(3) + f' See <a href="{"x" * 900}', "a"), (102, text(3) + f' [quote="{"y " * 400}', "a"), (103, text(3) + f' <a href="{"x" * 900}">A garden.</a>', "a")]
    flags = truncation.truncation_flags(spark.createDataFrame(rows, "doc_id long, text string, source string"), author=None)
    got = {r.doc_id: r.reason for r in flags.collect()}
    assert (got[100], got[101], got[102], got[103]) == ("word", "tag", "tag", None)
