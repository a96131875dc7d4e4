"""DuckDB SQL for the whole pipeline over document_elements, stage by stage."""

from __future__ import annotations

from leafstack.functions.text import CAPTION_WORDS
from leafstack.plans import oracles as o

_PAGE = "doc_id, page_number"
_SLOT = ("cx", "cy", "cw", "ch")

#: Containment merge, with flow paragraphs outside it; then the elements with their new texts.
_MERGED = f"""{o._E},
area AS MATERIALIZED (SELECT *, greatest(0.0::DOUBLE, width) * greatest(0.0::DOUBLE, height) AS area FROM e),
{o.merge_ctes("AND coalesce(b.layout, '') <> 'flow'")},
m AS MATERIALIZED (
  SELECT e.* REPLACE (coalesce(new_text, text) AS text, {o._strip('coalesce(new_text, text)')} AS st), kid.pid AS absorbed_by FROM area e
  LEFT JOIN (SELECT doc_id, page_number, po AS ordinal, new_text FROM top) t USING (doc_id, page_number, ordinal) LEFT JOIN kid USING (doc_id, page_number, ordinal))"""

#: Cells with boxes; which cell takes which element; which image takes which label; what stands for itself.
_PLACED = f"""{_MERGED},
{o._C.partition(o._E + ',')[2]},
boxed AS MATERIALIZED (
  SELECT *, CASE WHEN NOT coalesce(is_spanned, false) THEN x + width / ncols * col_idx END AS cx, CASE WHEN NOT coalesce(is_spanned, false) THEN y + height / nrows * row_idx END AS cy,
    CASE WHEN NOT coalesce(is_spanned, false) THEN width / ncols * coalesce(span_width, 1) END AS cw, CASE WHEN NOT coalesce(is_spanned, false) THEN height / nrows * coalesce(span_height, 1) END AS ch FROM cell),
t AS MATERIALIZED (SELECT doc_id, page_number, ordinal, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, ordinal) AS INTEGER) AS rank FROM m WHERE element_type = 'table'),
slot AS MATERIALIZED (SELECT doc_id, page_number, ordinal, rank, cell_idx, cx, cy, cw, ch FROM boxed JOIN t USING (doc_id, page_number, ordinal) WHERE cx IS NOT NULL),
hits AS (SELECT a.doc_id, a.page_number, a.ordinal, b.ordinal AS table_ordinal, b.rank AS table_rank, b.cell_idx, {o._ratio('a', 'b', _SLOT)} AS ratio
  FROM m a JOIN slot b ON {o._SAME} AND a.ordinal <> b.ordinal WHERE a.absorbed_by IS NULL AND a.element_type <> 'group' AND {o._ratio('a', 'b', _SLOT)} >= 0.5::DOUBLE),
claims AS MATERIALIZED (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, ordinal, table_ordinal ORDER BY ratio DESC, cell_idx) = 1),
{o._TAKING},
taken AS MATERIALIZED (SELECT doc_id, page_number, ordinal, table_ordinal, cell_idx, ratio FROM claims JOIN final USING (doc_id, page_number) WHERE NOT list_contains(gone, table_rank)
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, ordinal ORDER BY table_rank) = 1),
img AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, ordinal) AS rank FROM m WHERE element_type = 'image'),
labelled AS MATERIALIZED (
  SELECT a.doc_id, a.page_number, a.ordinal, b.ordinal AS image_ordinal, {o._ratio('a', 'b')} AS ratio FROM (SELECT * FROM m ANTI JOIN taken USING (doc_id, page_number, ordinal)) a JOIN img b ON {o._SAME}
  WHERE a.absorbed_by IS NULL AND a.element_type IN ('text', 'unknown') AND length(a.st) BETWEEN 1 AND 60 AND {o._ratio('a', 'b')} >= 0.5::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_number, a.ordinal ORDER BY b.rank) = 1),
placed_all AS MATERIALIZED (SELECT m.*, table_ordinal, image_ordinal FROM m LEFT JOIN taken USING (doc_id, page_number, ordinal) LEFT JOIN labelled USING (doc_id, page_number, ordinal)),
f AS MATERIALIZED (SELECT * FROM placed_all WHERE absorbed_by IS NULL AND table_ordinal IS NULL AND image_ordinal IS NULL AND NOT (st = '' AND (element_type IN ('unknown', 'text') OR width * height < 1e-4::DOUBLE)))"""

_ORDERED = o._cuts(f"{_PLACED},\n{o._STORED.format('f')}", "spatial WHERE placeholder_idx IS NULL") + "," + o._COMPOSITE.format("spatial") + """,
od AS MATERIALIZED (SELECT * FROM placed UNION ALL BY NAME
  SELECT f.*, NULL AS spatial_group, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY z_order, element_id, ordinal) AS INTEGER) AS read_ord FROM f JOIN choice USING (doc_id, page_number) WHERE as_stored)"""

_WORDS = " OR ".join(f"contains(lower(a.st), '{w}')" for w in CAPTION_WORDS)
#: Titles and captions with the knobs' defaults.
_RELATED = f"""{_ORDERED},
tt AS (SELECT * FROM od WHERE element_type = 'text' AND st <> '' AND (is_placeholder OR (length(st) <= 80 AND NOT contains(st, chr(10)))) QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY read_ord) = 1),
title AS MATERIALIZED (
  SELECT b.doc_id, b.page_number, a.ordinal AS source_ordinal, b.ordinal AS target_ordinal, a.read_ord AS source_ord, b.read_ord AS target_ord, a.element_id AS source_element_id, b.element_id AS target_element_id
  FROM tt a JOIN od b ON {o._SAME} AND a.ordinal <> b.ordinal WHERE b.y >= a.y AND b.y - (a.y + a.height) <= 0.5::DOUBLE),
pc AS (
  SELECT a.doc_id, a.page_number, a.element_id AS text_element_id, b.element_id AS visual_element_id, a.read_ord AS text_ord, b.read_ord AS visual_ord, a.ordinal AS text_ordinal, b.ordinal AS visual_ordinal, a.st AS caption_text,
    greatest(0.0::DOUBLE, least(b.x + b.width, a.x + a.width) - greatest(b.x, a.x)) / greatest(least(b.x + b.width - b.x, a.x + a.width - a.x), 1e-6::DOUBLE) AS ov,
    a.y - (b.y + b.height) AS below, b.y - (a.y + a.height) AS above, greatest(a.width * a.height, 1e-9::DOUBLE) / greatest(b.width * b.height, 1e-9::DOUBLE) AS sz,
    greatest(CASE WHEN length(a.st) BETWEEN 8 AND 120 THEN 1.0::DOUBLE WHEN length(a.st) BETWEEN 1 AND 180 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN {_WORDS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS text_hint,
    CASE WHEN a.st[1] IN ('-', '•', '·') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS bullet_penalty
  FROM od a JOIN od b ON {o._SAME} WHERE a.element_type = 'text' AND a.st <> '' AND b.element_type IN ('image', 'table') AND a.x IS NOT NULL AND b.x IS NOT NULL),
pg2 AS (SELECT *, CASE WHEN below >= 0 AND above >= 0 THEN least(below, above) WHEN below >= 0 THEN below WHEN above >= 0 THEN above END AS gap FROM pc),
ps AS (
  SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - gap / 0.06::DOUBLE) AS proximity, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ov)) AS alignment, CASE WHEN sz < 0.5 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - sz) END AS size_ratio,
    CASE WHEN below >= 0 AND below <= 0.06::DOUBLE THEN 0.8::DOUBLE WHEN above >= 0 AND above <= 0.06::DOUBLE THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS position FROM pg2 WHERE ov >= 1.0::DOUBLE - 0.08::DOUBLE AND gap IS NOT NULL AND gap <= 0.06::DOUBLE),
sc AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * proximity + 0.25::DOUBLE * alignment + 0.15::DOUBLE * size_ratio + 0.15::DOUBLE * position + 0.1::DOUBLE * text_hint - bullet_penalty)) AS score FROM ps),
jd AS MATERIALIZED (
  SELECT *, CASE WHEN score >= 0.65::DOUBLE THEN 'caption_of' ELSE 'related_to' END AS relation_type, row_number() OVER (PARTITION BY doc_id, page_number, text_ordinal ORDER BY score DESC, visual_ord, text_ord) > 1 AS rejected,
    row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, visual_ord, text_ord) AS rank FROM sc WHERE score >= 0.45::DOUBLE),
rel AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, part, place) AS INTEGER) AS rel_idx FROM (
    SELECT doc_id, page_number, 'title_of' AS relation_type, source_element_id, target_element_id, 0.7::DOUBLE AS confidence, NULL AS method, NULL AS caption_text, 0 AS part, target_ord AS place FROM title
    UNION ALL SELECT doc_id, page_number, relation_type, text_element_id, visual_element_id, score, 'rule', caption_text, 1, rank FROM jd WHERE NOT rejected)),
said AS MATERIALIZED (SELECT doc_id, target_element_id AS element_id, arg_max(caption_text, rel_idx) AS caption FROM rel WHERE relation_type = 'caption_of' AND caption_text <> '' GROUP BY 1, 2)"""

#: Blocks by reading order; a target of a title that is a heading met before belongs to that heading.
_FROM_BLOCKS = o._BLOCKS.partition(o._E + ",")[2].replace("FROM e LEFT JOIN", "FROM b0 LEFT JOIN").replace("FROM lv LEFT JOIN par USING (doc_id, page_number, ordinal)", "FROM lv LEFT JOIN par2 USING (doc_id, page_number, ordinal)")
_FROM_BLOCKS = _FROM_BLOCKS.replace("o AS MATERIALIZED (", """own_title AS (SELECT title.doc_id, title.page_number, target_ord AS ordinal, source_ord FROM title JOIN hd ON hd.doc_id = title.doc_id AND hd.page_number = title.page_number AND hd.ordinal = title.source_ord),
par2 AS MATERIALIZED (SELECT lv.doc_id, lv.page_number, lv.ordinal, CASE WHEN lv.level IS NULL AND source_ord < lv.ordinal THEN source_ord ELSE par.parent END AS parent
  FROM lv LEFT JOIN par USING (doc_id, page_number, ordinal) LEFT JOIN own_title USING (doc_id, page_number, ordinal)),
o AS MATERIALIZED (""", 1)
_BLOCKED = f"""{_RELATED},
b0 AS MATERIALIZED (SELECT * REPLACE (read_ord AS ordinal), ordinal AS place FROM od),
{_FROM_BLOCKS},
up(doc_id, page_number, ordinal, cur, path) AS (
  SELECT doc_id, page_number, ordinal, parent, CAST([] AS VARCHAR[]) FROM o WHERE makes
  UNION ALL SELECT u.doc_id, u.page_number, u.ordinal, q.parent, list_prepend(h.label, u.path)
  FROM up u JOIN hd h ON h.doc_id = u.doc_id AND h.page_number = u.page_number AND h.ordinal = u.cur LEFT JOIN par q ON q.doc_id = h.doc_id AND q.page_number = h.page_number AND q.ordinal = h.ordinal),
paths AS MATERIALIZED (SELECT doc_id, page_number, CAST(own AS INTEGER) AS block_idx, CASE WHEN level IS NOT NULL THEN list_append(path, coalesce(nullif(st, ''), 'heading')) ELSE path END AS path FROM up JOIN o USING (doc_id, page_number, ordinal) WHERE cur IS NULL),
bx AS MATERIALIZED (
  SELECT blk.*, {o._BID.format('block_idx')} AS block_id, coalesce(element_ids, '') AS element_ids, CASE WHEN pidx IS NOT NULL THEN {o._BID.format('pidx')} END AS parent_block_id, coalesce(path, []) AS path
  FROM blk LEFT JOIN ids USING (doc_id, page_number, block_idx) LEFT JOIN paths USING (doc_id, page_number, block_idx))"""

#: Chunks: a block's title and the texts of its elements with their captions, cut at blank lines.
_CHUNKS = f"""WITH RECURSIVE {_BLOCKED},
piece AS (
  SELECT it.doc_id, it.page_number, it.block_idx, string_agg(CASE WHEN st <> '' AND st <> {o._strip('bx.title_text')} THEN st || CASE WHEN caption <> '' THEN chr(10) || chr(10) || '[CAPTION] ' || caption ELSE '' END WHEN caption <> '' THEN '[CAPTION] ' || caption END,
    chr(10) || chr(10) ORDER BY ordinal) AS body FROM it JOIN bx ON bx.doc_id = it.doc_id AND bx.page_number = it.page_number AND bx.block_idx = it.block_idx LEFT JOIN said ON said.doc_id = it.doc_id AND said.element_id = it.element_id WHERE bx.kind <> 'container' GROUP BY 1, 2, 3),
whole AS (
  SELECT bx.*, trim(concat_ws(chr(10) || chr(10), CASE WHEN kind = 'heading' AND title_text <> '' THEN title_text END, body), (SELECT ws FROM white)) AS t FROM bx LEFT JOIN piece USING (doc_id, page_number, block_idx) WHERE kind <> 'container'),
cutt(doc_id, page_number, block_idx, t, s, n, e) AS (
  SELECT doc_id, page_number, block_idx, t, 0, 0, 0 FROM whole WHERE t <> '' UNION ALL
  SELECT doc_id, page_number, block_idx, t, e, n + 1, CASE WHEN length(t) <= 1200 OR e + 1200 >= length(t) THEN length(t)
    WHEN contains(t[e + 2:e + 1200], chr(10) || chr(10)) THEN e + 1200 - (instr(reverse(t[e + 2:e + 1200]), chr(10) || chr(10)) - 1) - 2 ELSE e + 1200 END FROM cutt WHERE e < length(t)),
part AS (SELECT *, CASE WHEN length(t) <= 1200 THEN t ELSE trim(t[s + 1:e], (SELECT ws FROM white)) END AS part FROM cutt WHERE n > 0)
SELECT doc_id, printf('CH_%05d', row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_idx, n)) AS chunk_id, page_number, part AS text, block_id, kind AS block_kind, element_ids,
  CASE WHEN kind = 'heading' THEN level END AS outline_level, CASE WHEN kind = 'heading' THEN parent_block_id END AS parent_block_id, CASE WHEN len(path) > 0 THEN array_to_string(path, ' > ') END AS section_path
FROM part JOIN bx USING (doc_id, page_number, block_idx) WHERE part <> ''"""

#: Tables with what their cells have taken in, above or below the cell's middle; labels; bodies of all elements.
_CON = f"""
use2 AS MATERIALIZED (SELECT *, coalesce(span_width, 1) AS sw, coalesce(span_height, 1) AS sh FROM boxed WHERE NOT coalesce(is_spanned, false)),
nrow AS {o._html_rows("'td'", 'text', 'use2')}, ndim AS (SELECT doc_id, page_number, ordinal, unnest(range(max(row_idx) + 1)) AS row_idx FROM use2 GROUP BY 1, 2, 3),
nest AS (SELECT doc_id, page_number, ordinal, '<table>' || chr(10) || string_agg(coalesce(row, '<tr></tr>'), chr(10) ORDER BY row_idx) || chr(10) || '</table>' AS html FROM ndim LEFT JOIN nrow USING (doc_id, page_number, ordinal, row_idx) GROUP BY 1, 2, 3),
took AS (
  SELECT k.doc_id, k.page_number, k.table_ordinal AS ordinal, k.cell_idx, m.y, m.x, m.ordinal AS item, trim(CASE m.element_type WHEN 'image' THEN '<img src="' || coalesce(nullif(image_ref, ''), 'image-not-exported') || '" alt="' || element_id || '"/>' WHEN 'table' THEN coalesce(nest.html, st) ELSE st END, (SELECT ws FROM white)) AS content
  FROM taken k JOIN m USING (doc_id, page_number, ordinal) LEFT JOIN nest USING (doc_id, page_number, ordinal)),
base AS (SELECT *, {o._br('text', "'<br/>'")} AS plain, {o._br("coalesce(nullif(trim(formatted_text, (SELECT ws FROM white)), ''), text)", "'<br/>'")} AS fancy FROM use2),
filled AS (
  SELECT b.doc_id, b.page_number, b.ordinal, b.cell_idx, string_agg({o._br('content', "'<br/>'")}, '<br/>' ORDER BY k.y, k.x, item) FILTER (content <> '' AND coalesce(k.y < b.cy + b.ch / 2, false)) AS before,
    string_agg({o._br('content', "'<br/>'")}, '<br/>' ORDER BY k.y, k.x, item) FILTER (content <> '' AND NOT coalesce(k.y < b.cy + b.ch / 2, false)) AS after FROM base b JOIN took k USING (doc_id, page_number, ordinal, cell_idx) GROUP BY 1, 2, 3, 4),
con2 AS MATERIALIZED (SELECT base.*, coalesce(concat_ws('<br/>', before, nullif(plain, ''), after), '') AS content, coalesce(concat_ws('<br/>', before, nullif(fancy, ''), after), '') AS shown FROM base LEFT JOIN filled USING (doc_id, page_number, ordinal, cell_idx))"""
_TABLES = o._HEAD.partition("hs AS (")[2].replace("FROM con GROUP", "FROM con2 GROUP").replace("length(content) <= 30)", "length(content) <= 30 AND NOT contains(content, chr(10)))")
_BODIES = f"""{_BLOCKED},{_CON},
hs AS ({_TABLES},
cc AS (SELECT con2.*, CASE WHEN row_idx < header_rows THEN 'th' ELSE 'td' END AS tag FROM con2 JOIN hdr USING (doc_id, page_number, ordinal)),
rw AS {o._html_rows('tag', 'shown', 'cc')}, grid AS (SELECT doc_id, page_number, ordinal, header_rows, unnest(range(max_row + 1)) AS row_idx FROM hdr),
tln AS (SELECT grid.*, coalesce(row, '<tr></tr>') AS row FROM grid LEFT JOIN rw USING (doc_id, page_number, ordinal, row_idx)),
tparts AS (SELECT doc_id, page_number, ordinal, any_value(header_rows) AS h, string_agg(row, chr(10) ORDER BY row_idx) FILTER (row_idx < header_rows) AS head, string_agg(row, chr(10) ORDER BY row_idx) FILTER (row_idx >= header_rows) AS body FROM tln GROUP BY 1, 2, 3),
html AS (SELECT doc_id, page_number, ordinal, '<table>' || chr(10) || CASE WHEN h > 0 THEN '<thead>' || chr(10) || head || chr(10) || '</thead>' || chr(10) ELSE '' END || '<tbody>' || chr(10) || coalesce(body || chr(10), '') || '</tbody>' || chr(10) || '</table>' AS html FROM tparts),
notes AS (SELECT doc_id, page_number, image_ordinal AS ordinal, string_agg(st, ' | ' ORDER BY y, x, ordinal) FILTER (st <> '') AS notes FROM placed_all WHERE image_ordinal IS NOT NULL GROUP BY 1, 2, 3),
dressed AS MATERIALIZED (
  SELECT od.*, replace(st, chr(9), ' · ') AS shown, notes, html, caption, element_type = 'text' AND st <> '' AND is_placeholder AS opens
  FROM od LEFT JOIN notes USING (doc_id, page_number, ordinal) LEFT JOIN html USING (doc_id, page_number, ordinal) LEFT JOIN said USING (doc_id, element_id)),
worn AS MATERIALIZED (
  SELECT *, CASE element_type
    WHEN 'text' THEN CASE WHEN st = '' THEN '' WHEN is_heading THEN repeat('#', least(greatest(coalesce(nullif(heading_level, 0), 2), 2), 6)) || ' ' || shown ELSE {o._br('shown', "'  ' || chr(10)")} END
    WHEN 'image' THEN '<img src="' || coalesce(nullif(image_ref, ''), 'image-not-exported') || '" alt="' || element_id || '"/>' || coalesce(chr(10) || chr(10) || '*' || notes || '*', '')
    WHEN 'table' THEN coalesce(nullif(html, ''), {o._br('st', "'  ' || chr(10)")})
    WHEN 'chart' THEN CASE WHEN coalesce(text, '') = '' THEN '> [chart]' ELSE '> [chart] ' || st END
    ELSE {o._br('st', "'  ' || chr(10)")} END AS plain FROM dressed)"""

#: Documents by blocks where a heading block owns a heading or placeholder, else by pages.
_MARKDOWN = f"""WITH RECURSIVE {_BODIES},
native AS (SELECT DISTINCT doc_id FROM it JOIN bx USING (doc_id, page_number, block_idx) WHERE bx.kind = 'heading' AND (is_heading OR is_placeholder)),
lines AS (
  SELECT *, CASE WHEN opens AND NOT used THEN '# ' || shown ELSE plain END AS body FROM (
    SELECT *, coalesce(bool_or(opens OR starts_with(plain, '# ')) OVER (PARTITION BY doc_id, page_number ORDER BY read_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS used FROM worn)),
broken AS (
  SELECT *, string_split(lag(spatial_group) OVER w, '.') AS a, string_split(spatial_group, '.') AS b, lag(spatial_group) OVER w AS prev, row_number() OVER (PARTITION BY doc_id, page_number, caption ORDER BY read_ord) = 1 AS first
  FROM lines WHERE body <> '' WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY read_ord)),
pmd AS (
  SELECT doc_id, page_number, string_agg(CASE WHEN coalesce(prev <> spatial_group AND starts_with(b[list_position([coalesce(a[j] = b[j], false) FOR j IN range(1, greatest(len(a), len(b)) + 1)], false)], 'v'), false) THEN '<!-- column-break -->' || chr(10) || chr(10) ELSE '' END
    || body || chr(10) || CASE WHEN first AND caption <> '' THEN '> ' || caption || chr(10) ELSE '' END, chr(10) ORDER BY read_ord) AS t FROM broken GROUP BY 1, 2),
pages AS (
  SELECT doc_id, page_number, trim('<!-- Page ' || page_number || ' -->' || chr(10) || chr(10) || coalesce(t, ''), (SELECT ws FROM white)) AS md FROM p LEFT JOIN pmd USING (doc_id, page_number)),
own AS (
  SELECT it.doc_id, it.page_number, it.block_idx, it.ordinal AS spot, w.plain AS body, w.caption FROM it JOIN bx ON bx.doc_id = it.doc_id AND bx.page_number = it.page_number AND bx.block_idx = it.block_idx
  JOIN worn w ON w.doc_id = it.doc_id AND w.page_number = it.page_number AND w.ordinal = it.place
  WHERE w.plain <> '' AND NOT (bx.kind = 'heading' AND replace(w.st, chr(9), ' · ') = replace({o._strip('bx.title_text')}, chr(9), ' · '))),
bodies AS (
  SELECT doc_id, page_number, block_idx, string_agg(body || chr(10) || CASE WHEN first AND caption <> '' THEN '> ' || caption || chr(10) ELSE '' END, chr(10) ORDER BY spot) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, caption ORDER BY page_number, block_idx, spot) = 1 AS first FROM own) GROUP BY 1, 2, 3),
heads AS (
  SELECT *, kind = 'heading' AND level > 0 AND title_text <> '' AS shown, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_idx) = 1 AS fresh, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_idx) > 1 AS later FROM bx SEMI JOIN native USING (doc_id)),
marks AS (SELECT *, coalesce(bool_or(shown AND level >= 2) OVER (PARTITION BY doc_id, page_number ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS used FROM heads),
bmd AS (
  SELECT doc_id, page_number, block_idx, concat_ws(chr(10), CASE WHEN fresh THEN CASE WHEN later THEN chr(10) ELSE '' END || '<!-- Page ' || page_number || ' -->' || chr(10) END,
    CASE WHEN shown THEN CASE WHEN NOT used AND level >= 2 THEN '#' ELSE repeat('#', level) END || ' ' || replace(title_text, chr(9), ' · ') || chr(10) WHEN kind = 'container' AND title_text <> '' THEN '<!-- ' || title_text || ' -->' || chr(10) END, t) AS t
  FROM marks LEFT JOIN bodies USING (doc_id, page_number, block_idx))
SELECT doc_id, trim(string_agg(t, chr(10) ORDER BY page_number, block_idx) FILTER (t <> ''), (SELECT ws FROM white)) || chr(10) AS markdown FROM bmd GROUP BY 1
UNION ALL SELECT doc_id, trim(string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number) FILTER (md <> ''), (SELECT ws FROM white)) || chr(10) FROM pages ANTI JOIN native USING (doc_id) GROUP BY 1"""

ORACLES = {
    "pipeline_elements": f"WITH RECURSIVE {_PLACED} SELECT element_uid, text, absorbed_by, table_ordinal, image_ordinal FROM placed_all",
    "pipeline_order": f"WITH RECURSIVE {_ORDERED} SELECT element_uid, read_ord, spatial_group FROM od",
    "pipeline_relations": f"WITH RECURSIVE {_RELATED} SELECT doc_id, page_number, rel_idx, relation_type, source_element_id, target_element_id, confidence, method, caption_text FROM rel",
    "pipeline_blocks": f"WITH RECURSIVE {_BLOCKED} SELECT doc_id, page_number, block_idx, block_id, kind, level, title_text, element_ids, parent_block_id, array_to_string(path, ' > ') AS section_path FROM bx",
    "rag_chunks": _CHUNKS,
    "markdown_document": _MARKDOWN,
    "debug_report": f"""WITH RECURSIVE {_BLOCKED}, n AS (SELECT doc_id, count(*) AS num_pages FROM p GROUP BY 1), b AS (SELECT doc_id, count(*) AS num_blocks FROM bx GROUP BY 1), related AS (SELECT doc_id, count(*) AS num_relations FROM rel GROUP BY 1),
        v AS (SELECT doc_id, count(*) AS none FROM od WHERE element_type IN ('image', 'table') AND (doc_id, page_number, ordinal) NOT IN (SELECT (doc_id, page_number, visual_ordinal) FROM jd) GROUP BY 1),
        d AS (SELECT doc_id, count(*) AS judged, count(*) FILTER (rejected) AS rejected FROM jd GROUP BY 1), x AS (SELECT doc_id, count(*) AS elements, CAST(sum(length(left(coalesce(text, ''), 120))) AS BIGINT) AS preview_chars FROM od JOIN (SELECT doc_id, page_number FROM p) USING (doc_id, page_number) GROUP BY 1)
        SELECT doc_id, num_pages, coalesce(num_blocks, 0) AS num_blocks, coalesce(num_relations, 0) AS num_relations, coalesce(elements, 0) AS elements, coalesce(preview_chars, 0) AS preview_chars, coalesce(judged, 0) + coalesce(none, 0) AS decisions, coalesce(rejected, 0) + coalesce(none, 0) AS rejected
        FROM n LEFT JOIN b USING (doc_id) LEFT JOIN related USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "parsed_json": f"""WITH RECURSIVE {_BLOCKED}, el AS (SELECT * FROM od JOIN (SELECT doc_id, page_number FROM p) USING (doc_id, page_number)),
        n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1), a AS (SELECT doc_id, count(*) AS elements FROM el GROUP BY 1), b AS (SELECT doc_id, count(*) AS blocks FROM bx GROUP BY 1), related AS (SELECT doc_id, count(*) AS relations, count(*) FILTER (part = 1) AS scored FROM rel GROUP BY 1),
        celled AS (SELECT doc_id, count(*) AS cells, count(cx) AS boxed_cells FROM boxed SEMI JOIN el USING (doc_id, page_number, ordinal) GROUP BY 1),
        k AS (SELECT doc_id, count(*) AS absorbed FROM (SELECT doc_id, page_number, table_ordinal AS ordinal FROM taken) SEMI JOIN el USING (doc_id, page_number, ordinal) GROUP BY 1),
        l AS (SELECT doc_id, count(*) AS annotations FROM (SELECT doc_id, page_number, image_ordinal AS ordinal FROM labelled) SEMI JOIN el USING (doc_id, page_number, ordinal) GROUP BY 1)
        SELECT doc_id, pages, coalesce(elements, 0) AS elements, coalesce(cells, 0) AS cells, coalesce(boxed_cells, 0) AS boxed_cells, coalesce(absorbed, 0) AS absorbed, coalesce(annotations, 0) AS annotations, coalesce(relations, 0) AS relations, coalesce(scored, 0) AS scored, coalesce(blocks, 0) AS blocks
        FROM n LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN related USING (doc_id) LEFT JOIN celled USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
