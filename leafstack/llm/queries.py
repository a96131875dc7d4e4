"""Registered queries of the problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, table
from leafstack.llm import boilerplate, canonical, contamination, mixing, packing, splitting, truncation


def _limited_chunks(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "parser_configs").select("config_id", "chunk_max_chars", "chunk_overlap_chars")
    return table(spark, d, "rag_chunks").join(maybe_broadcast(limits), "config_id", "left")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_limited_chunks(spark, d), ["package_id", "chunk_id"], "text", "chunk_max_chars", "chunk_overlap_chars")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = _limited_chunks(spark, d).select("package_id", "chunk_id", "chunk_max_chars", "chunk_overlap_chars", "text").distinct()
    return splitting.split_oversized(chunks, "text", "chunk_max_chars", "chunk_overlap_chars").drop("text")


def _texts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    name, uid = ("document_elements", "element_uid") if kind == "element" else ("table_cells", "cell_uid")
    return table(spark, d, name).select(F.lit(kind).alias("kind"), "package_id", F.col(uid).alias("uid"), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    both = _texts(spark, d, "element").unionByName(_texts(spark, d, "cell"))
    return canonical.alike_pairs(both, ["kind", "package_id"], "uid", "text").select("kind", "uid_a", "uid_b")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    both = _texts(spark, d, "element").unionByName(_texts(spark, d, "cell")).select("kind", "uid", "text").distinct()
    return canonical.canonicalize(both, "text").select("kind", "uid", "canonical")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    both = _texts(spark, d, "element").unionByName(_texts(spark, d, "cell"))
    return canonical.alike_classes(both, ["kind", "package_id"], "uid", "text")


def p3_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_chunks(table(spark, d, "rag_chunks"), table(spark, d, "parser_configs"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p3_containers(spark, d))


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_audit(p3_containers(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_line_places(table(spark, d, "document_elements"), table(spark, d, "parsed_documents"))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "document_elements"), table(spark, d, "parsed_documents"))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "document_elements").select("element_uid", "package_id", "site_code", "text")
    return boilerplate.without_repeated_lines(elements, table(spark, d, "parsed_documents")).select("element_uid", "clean_text", "lines_removed")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.exact_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return contamination.tolerant_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    return mixing.audit(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")), table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_flags(table(spark, d, "documents")).filter("truncated").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(truncation.truncation_flags(table(spark, d, "documents")))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_limits(truncation.text_lengths(table(spark, d, "documents")))


def queries() -> dict:
    named = (p1_found, p1_pieces, p2_found, p2_canonical, p2_classes, p3_containers, p3_report, p3_audit, p5_found, p5_lines, p5_cleaned, p6_found, p6_overlaps, p7_mix, p7_shares, p7_audit, p8_found, p8_rates, p8_limits)
    return {f.__name__: f for f in named}


#: The look of a text, written apart from the operator's own SQL: by ranges of code points and letters typed here.
_LOOK = r"""
texts AS (
  SELECT DISTINCT 'element' AS kind, package_id, element_uid AS uid, text FROM document_elements
  UNION ALL SELECT DISTINCT 'cell', package_id, cell_uid, text FROM table_cells),
wide AS (SELECT string_agg(chr(c::INTEGER), '' ORDER BY c) AS f, string_agg(chr(c::INTEGER - 65248), '' ORDER BY c) AS t FROM range(65281, 65375) r(c)),
seen AS (
  SELECT kind, package_id, uid, text, regexp_replace(text, '[\x{AD}\x{34F}\x{61C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}\x{FEFF}]', '', 'g') AS s FROM texts),
spaced AS (
  SELECT kind, package_id, uid, text, regexp_replace(regexp_replace(regexp_replace(s, '[\t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '[\x{2010}-\x{2012}\x{2212}\x{FE63}\x{FF0D}]', '-', 'g'), '\r\n|[\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS s FROM seen),
joined AS (SELECT kind, package_id, uid, text, @joined@ AS s FROM spaced),
latin AS (
  SELECT kind, package_id, uid, text, nfc_normalize(translate(nfc_normalize(translate(s, f, t)),
    'АВЕЅІЈКМНОРСТХҮԁһаеіјорсѕухԛԝЁёЇїЀѐӒӓӦӧӐӑӖӗӰӱΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳΪμϹͿΆΈΊΌΎό',
    'ABESIJKMHOPCTXYdhaeijopcsyxqwËëÏïÈèÄäÖöĂăĔĕŸÿABEZHIKMNOPTYXocjÏµCJÁÉÍÓÝó')) AS s FROM joined, wide),
formed AS (
  SELECT kind, package_id, uid, text, CASE WHEN NOT regexp_matches(s, '[\p{Cyrillic}\p{Greek}]') THEN s ELSE
    array_to_string([CASE
      WHEN regexp_matches(w, '\p{Cyrillic}') THEN translate(w, 'ABESIJKMHOPCTXYdhaeijopcsyxqwËëÏïÈèÄäÖöĂăĔĕŸÿ', 'АВЕЅІЈКМНОРСТХҮԁһаеіјорсѕухԛԝЁёЇїЀѐӒӓӦӧӐӑӖӗӰӱ')
      WHEN regexp_matches(w, '\p{Greek}') THEN translate(w, 'ABEZHIKMNOPTYXocjÏCJÁÉÍÓÝó', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳΪϹͿΆΈΊΌΎό')
      ELSE w END FOR w IN regexp_extract_all(s, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+')], '') END AS look FROM latin)"""
# Letters joined into one character, and their parts.
_JOINED_LETTERS = "Ⅱ=II Ⅲ=III Ⅳ=IV Ⅵ=VI Ⅶ=VII Ⅷ=VIII Ⅸ=IX Ⅺ=XI Ⅻ=XII Ⅰ=I Ⅴ=V Ⅹ=X ⅱ=ii ⅲ=iii ⅳ=iv ⅵ=vi ⅶ=vii ⅷ=viii ⅸ=ix ⅺ=xi ⅻ=xii ⅰ=i ⅴ=v ⅹ=x ﬃ=ffi ﬄ=ffl ﬀ=ff ﬁ=fi ﬂ=fl ﬅ=st ﬆ=st ĳ=ij Ĳ=IJ …=... ‥=.. ‼=!!"


def _with_joined(sql: str) -> str:
    expr = "s"
    for pair in _JOINED_LETTERS.split(" "):
        a, b = pair.split("=")
        expr = f"replace({expr}, '{a}', '{b}')"
    return sql.replace("@joined@", expr)


_KEYED = r"regexp_replace(lower(upper(trim(regexp_replace({}, '[\s\pZ\x{{1c}}-\x{{1f}}\x{{85}}\x{{0b}}]+', ' ', 'g')))), '\p{{Nd}}+', '0', 'g')"

_SITES = r"""
sites AS (
  SELECT package_id, min(lower(trim(list_filter(string_split(replace(source_path, chr(92), '/'), '/'), lambda x: trim(x) NOT IN ('', '.', '..'))[1]))) AS site
  FROM parsed_documents GROUP BY 1),
totals AS (SELECT site, count(*) AS packages FROM sites GROUP BY 1),
elements AS (SELECT DISTINCT element_uid, package_id, site, text FROM document_elements JOIN sites USING (package_id) WHERE text IS NOT NULL),
raw_lines AS (SELECT element_uid, package_id, site, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM elements),
lines AS (
  SELECT element_uid, package_id, site, line_no, l AS raw,
    regexp_replace(lower(upper(trim(regexp_replace(l, '[\s\pZ\x{1c}-\x{1f}\x{85}\x{0b}]+', ' ', 'g')))), '\p{Nd}+', '0', 'g') AS line FROM raw_lines),
repeated AS (
  SELECT site, line, count(DISTINCT package_id) AS packages_with_line, any_value(packages) AS packages
  FROM lines JOIN totals USING (site) WHERE line <> '' GROUP BY 1, 2 HAVING count(DISTINCT package_id) >= 3 AND 4 * count(DISTINCT package_id) >= any_value(packages))"""

_WORDS = r"""regexp_extract_all(lower(regexp_replace(regexp_replace(text,
  '</?[a-zA-Z][^<>]*>|\[/?[a-zA-Z*]{1,12}(=[^\[\]]*)?\]', ' ', 'g'), '&(#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,30});', ' ', 'g')), '[\p{L}\p{N}]+')"""
_GRAMS = "SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL))"


#: Boundary strengths of every cut by windows over single characters, then one cut after the other from each text's list.
_PIECES = r"""
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER () AS id, least(greatest(coalesce(chunk_overlap_chars, 0), 0), chunk_max_chars - 1) AS ov, coalesce(length(text) > chunk_max_chars AND chunk_max_chars > 0, false) AS big
  FROM (SELECT DISTINCT package_id, chunk_id, chunk_max_chars, chunk_overlap_chars, text FROM rag_chunks LEFT JOIN parser_configs USING (config_id))),
chars AS (SELECT id, length(text) AS n, i, text[i] AS l, CASE WHEN i < length(text) THEN text[i + 1] END AS r FROM (SELECT id, text, unnest(range(1, length(text) + 1)) AS i FROM rows WHERE big)),
kinds AS (
  SELECT *, regexp_matches(l, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]') AS blank, r IS NULL OR regexp_matches(r, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]') AS before_blank,
    regexp_matches(l, '^["'')\]}»”’」』]') AS closes, regexp_matches(l, '^[.!?…。！？．]') AS stop, regexp_matches(l, '^[。！？]') AS wide_stop,
    coalesce(regexp_matches(r, '^[\x{300}-\x{36F}\x{483}-\x{489}\x{591}-\x{5BD}\x{64B}-\x{65F}\x{93A}-\x{94D}\x{1160}-\x{11FF}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{200C}\x{200D}\x{20D0}-\x{20F0}\x{FE00}-\x{FE0F}\x{FE20}-\x{FE2F}\x{1F3FB}-\x{1F3FF}\x{E0100}-\x{E01EF}]'), false)
      OR coalesce(l = chr(8205) AND r IS NOT NULL, false) OR coalesce(l = chr(13) AND r = chr(10), false) AS tied FROM chars),
seen AS (
  SELECT *, max(CASE WHEN NOT blank THEN i ELSE 0 END) OVER w AS ink, arg_max(stop, i) FILTER (NOT blank AND NOT closes) OVER w AS ended, arg_max(wide_stop, i) FILTER (NOT blank AND NOT closes) OVER w AS wide_ended,
    max(CASE WHEN l = chr(10) THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS feed FROM kinds WINDOW w AS (PARTITION BY id ORDER BY i)),
strengths AS (
  SELECT id, list(CASE WHEN tied THEN 0 WHEN l = chr(10) AND feed > ink THEN 5 WHEN l = chr(10) THEN 4 WHEN ended AND (blank OR before_blank) THEN 3 WHEN wide_ended AND NOT blank THEN 3 WHEN blank OR before_blank THEN 2 ELSE 1 END ORDER BY i) AS s
  FROM seen GROUP BY id),
steps AS (
  SELECT id, 1 AS no, 0 AS start, CAST(NULL AS INTEGER) AS cut, chunk_max_chars AS cap, ov, s FROM rows JOIN strengths USING (id)
  UNION ALL
  SELECT id, no + 1, cut - ov, NULL, cap, ov, s FROM (
    SELECT id, no, cap, ov, s, CASE WHEN list_max(s[near:hi]) >= 2 THEN hi + 1 - list_position(list_reverse(s[near:hi]), list_max(s[near:hi])) ELSE hi + 1 - list_position(list_reverse(s[far:hi]), list_max(s[far:hi])) END AS cut
    FROM (SELECT *, start + cap AS hi, start + greatest(ov + 1, (cap + 1) // 2) AS near, start + ov + 1 AS far FROM steps WHERE len(s) - start > cap))),
starts AS (SELECT id, no, start, lead(start) OVER (PARTITION BY id ORDER BY no) + ov AS cut, len(s) AS n, count(*) OVER (PARTITION BY id) AS pieces FROM steps),
spans AS (
  SELECT id, no, start, coalesce(cut, n) AS cut, pieces FROM starts
  UNION ALL SELECT id, CASE WHEN text IS NOT NULL THEN 1 END, CASE WHEN text IS NOT NULL THEN 0 END, length(text), CASE WHEN text IS NULL THEN 0 ELSE 1 END FROM rows WHERE NOT big)
SELECT package_id, chunk_id, chunk_max_chars, chunk_overlap_chars, CAST(no AS INTEGER) AS piece_no, CAST(start AS INTEGER) AS piece_start, CAST(cut - start AS INTEGER) AS piece_chars, CAST(pieces AS INTEGER) AS piece_count,
  substring(text, CAST(start + 1 AS BIGINT), CAST(cut - start AS BIGINT)) AS piece_text FROM spans JOIN rows USING (id)"""

#: Two changes in twelve words leave one of three blocks of four words whole; what shares a block is compared word by word.
_OVERLAPS = r"""
WITH d AS (SELECT doc_id, i - 1 AS doc_pos, w[i:i + 11] AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT DISTINCT doc_id, @words@ AS w FROM documents WHERE text IS NOT NULL))),
t AS (SELECT item_id, i - 1 AS item_pos, w[i:i + 11] AS b FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT DISTINCT item_id, @words@ AS w FROM eval_items WHERE text IS NOT NULL))),
blocks AS (SELECT unnest([1, 5, 9]) AS k),
met AS (
  SELECT DISTINCT doc_id, item_id, doc_pos, item_pos, a, b FROM (SELECT d.*, k, array_to_string(a[k:k + 3], ' ') AS g FROM d, blocks) JOIN (SELECT t.*, k, array_to_string(b[k:k + 3], ' ') AS g FROM t, blocks) USING (k, g)),
near AS (SELECT doc_id, item_id, doc_pos, item_pos, len([j FOR j IN range(1, 13) IF a[j] <> b[j]]) AS changed FROM met),
runs AS (
  SELECT *, doc_pos - row_number() OVER (PARTITION BY doc_id, item_id, doc_pos - item_pos ORDER BY doc_pos) AS run FROM near WHERE changed <= 2),
whole AS (
  SELECT doc_id, item_id, min(doc_pos) AS doc_pos, min(item_pos) AS item_pos, max(doc_pos) - min(doc_pos) + 12 AS overlap_words, count(*) FILTER (changed = 0) AS exact FROM runs GROUP BY doc_id, item_id, doc_pos - item_pos, run),
best AS (
  SELECT *, CAST(sum(exact) OVER (PARTITION BY doc_id, item_id) AS BIGINT) AS exact_windows, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap_words DESC, exact DESC, doc_pos, item_pos) AS r FROM whole)
SELECT doc_id, item_id, overlap_words, exact_windows, CAST(doc_pos AS INTEGER) AS doc_pos, CAST(item_pos AS INTEGER) AS item_pos FROM best WHERE r = 1"""


#: Piles of lengths: copies count once, and a length is compared with as many around it as it is long enough for.
_LIMITS = """
WITH t AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
l AS (SELECT source, unit, length, count(*) AS n FROM (SELECT source, 'chars' AS unit, length(text) AS length FROM t UNION ALL SELECT source, 'bytes', strlen(text) FROM t) GROUP BY 1, 2, 3),
reach AS (SELECT *, CASE WHEN length >= 200 THEN 100 WHEN length >= 100 THEN 50 WHEN length >= 50 THEN 25 ELSE 12 END AS r, max(length) OVER (PARTITION BY source, unit) AS longest FROM l),
sums AS (
  SELECT a.source, a.unit, a.length, a.n, a.r, a.longest, coalesce(sum(b.n) FILTER (b.length BETWEEN a.length - r AND a.length - 1), 0) AS lower, coalesce(sum(b.n) FILTER (b.length BETWEEN a.length + 1 AND a.length + r), 0) AS upper,
    sum(b.n) FILTER (b.length BETWEEN a.length - 7 AND a.length) AS near, coalesce(sum(b.n) FILTER (b.length BETWEEN a.length - r - 8 AND a.length - 8), 0) AS below
  FROM reach a JOIN l b ON a.source = b.source AND a.unit = b.unit AND b.length BETWEEN a.length - 108 AND a.length + 100 WHERE a.length >= 24 GROUP BY ALL),
judged AS (SELECT *, n >= 6 AND n >= 6.0::DOUBLE * (greatest(lower, upper) / r + 0.5::DOUBLE) AS sharp, length = longest AND near >= 6 AND near >= 6.0::DOUBLE * (below / r * 8 + 0.5::DOUBLE) AS top FROM sums)
SELECT source, unit, CAST(length AS INTEGER) AS length, top FROM judged WHERE sharp OR top"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT package_id, chunk_id FROM rag_chunks JOIN parser_configs USING (config_id) WHERE length(text) > chunk_max_chars",
        "p1_pieces": _PIECES,
        "p2_canonical": f"WITH {_with_joined(_LOOK)} SELECT DISTINCT kind, uid, look AS canonical FROM formed",
        "p2_found": f"""WITH {_with_joined(_LOOK)}
            SELECT DISTINCT a.kind, a.uid AS uid_a, b.uid AS uid_b FROM formed a JOIN formed b
            ON a.kind = b.kind AND a.package_id = b.package_id AND a.look = b.look AND a.uid < b.uid AND a.text <> b.text
            WHERE regexp_replace(a.look, '\\s+', '', 'g') <> ''""",
        "p2_classes": f"""WITH {_with_joined(_LOOK)},
            live AS (SELECT *, count(*) OVER (PARTITION BY kind, package_id, look, text) AS n, count(*) OVER k AS members, min(uid) OVER k AS class_uid
              FROM formed WHERE regexp_replace(look, '\\s+', '', 'g') <> '' WINDOW k AS (PARTITION BY kind, package_id, look)),
            forms AS (SELECT kind, package_id, look, count(DISTINCT text) AS forms FROM live GROUP BY ALL)
            SELECT kind, package_id, uid, class_uid, forms, members - n AS links FROM live JOIN forms USING (kind, package_id, look) WHERE forms > 1""",
        "p3_audit": """WITH rows AS (SELECT DISTINCT config_id, package_id, chunk_id, text, chunk_max_chars AS cap FROM rag_chunks JOIN parser_configs USING (config_id))
            SELECT config_id, count(*) AS chunks, count(*) FILTER (length(text) > cap) AS split_chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS overfull, true AS enough
            FROM rows GROUP BY 1""",
        "p5_found": f"WITH {_SITES} SELECT DISTINCT element_uid, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN repeated USING (site, line)",
        "p5_lines": f"WITH {_SITES} SELECT site, line, packages_with_line, packages FROM repeated",
        "p5_cleaned": f"""WITH {_SITES},
            every AS (SELECT row_number() OVER () AS id, element_uid, site, text FROM document_elements LEFT JOIN sites USING (package_id)),
            every_line AS (SELECT id, site, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM every WHERE text IS NOT NULL),
            marked AS (
              SELECT id, n, l, r.line IS NOT NULL AS gone FROM (SELECT *, {_KEYED.format('l')} AS line FROM every_line) LEFT JOIN repeated r USING (site, line)),
            cleaned AS (SELECT id, coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (NOT gone), '') AS clean_text, CAST(count(*) FILTER (gone) AS INTEGER) AS lines_removed FROM marked GROUP BY 1)
            SELECT element_uid, clean_text, coalesce(lines_removed, 0) AS lines_removed FROM every LEFT JOIN cleaned USING (id)""",
        "p7_audit": """WITH d AS (SELECT DISTINCT doc_id, source FROM documents WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL)
            SELECT source, max_repeats, count(DISTINCT doc_id) AS usable_documents, true AS within_caps, true AS within_one_document FROM mix_targets LEFT JOIN d USING (source) GROUP BY 1, 2""",
        "p8_limits": _LIMITS,
        "p6_overlaps": _OVERLAPS.replace("@words@", _WORDS),
        "p6_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(key='doc_id', words=_WORDS, table='documents')}) JOIN ({_GRAMS.format(key='item_id', words=_WORDS, table='eval_items')}) USING (gram)",
    }
