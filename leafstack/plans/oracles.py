"""DuckDB SQL for the registered core queries."""

from __future__ import annotations

from leafstack.functions.text import CAPTION_WORDS, ROMAN

#: White space that stripping removes, as for the Column builders.
_WS = "' ' || " + " || ".join(f"chr({c})" for c in range(33, 0x3001) if chr(c).isspace()) + " || " + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31))


def _strip(c: str) -> str:
    return f"trim(coalesce({c}, ''), (SELECT ws FROM white))"


_WHITE = f"white AS MATERIALIZED (SELECT {_WS} AS ws)"

#: document_elements in the pipeline's form.
_E = f"""{_WHITE},
e AS MATERIALIZED (
  SELECT element_uid, CAST(package_id AS VARCHAR) AS doc_id, page_number, ordinal, element_id, element_type, z_order, bbox.x AS x, bbox.y AS y, bbox.width AS width, bbox.height AS height,
    text, {_strip('text')} AS st, metadata['layout'] AS layout, coalesce(metadata['is_placeholder'] = 'true', false) AS is_placeholder, coalesce(metadata['is_heading'] = 'true', false) AS is_heading,
    CAST(metadata['placeholder_idx'] AS INTEGER) AS placeholder_idx, CAST(metadata['heading_level'] AS INTEGER) AS heading_level, coalesce(metadata['is_list_item'] = 'true', false) AS is_list_item, metadata['source_format'] AS source_format,
    json_extract_string(metadata['image'], '$.filename') AS image_ref
  FROM (SELECT *, row_number() OVER (PARTITION BY element_uid ORDER BY ingested_at DESC) AS r FROM document_elements) WHERE r = 1),
p AS (
  SELECT DISTINCT CAST(package_id AS VARCHAR) AS doc_id, page_number, width, height, metadata['source_format'] AS source_format, metadata['layout_mode'] AS layout_mode, metadata['sheet_name'] AS sheet_name FROM document_pages)"""

#: Order lines as a dense layout.
_L = f"""{_WHITE},
e AS MATERIALIZED (
  SELECT CAST(pg AS VARCHAR) AS doc_id, 1 AS page_number, ordinal, printf('E_001_%04d', ordinal + 1) AS element_id,
    CASE k WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'unknown' ELSE 'text' END AS element_type, ordinal + 1 AS z_order,
    (l_partkey % 80) / 100 AS x, (l_suppkey % 80) / 100 AS y, l_quantity / 100 AS width, 0.02::DOUBLE + (l_partkey % 7) / 50 AS height, NULL AS image_ref, CASE WHEN l_suppkey % 11 = 0 THEN CAST(l_partkey % 3 AS INTEGER) END AS placeholder_idx, CASE WHEN k >= 2 THEN p_name END AS text, {_strip('CASE WHEN k >= 2 THEN p_name END')} AS st
  FROM (SELECT *, l_orderkey // 4 AS pg, l_partkey % 5 AS k, CAST(row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS ordinal
        FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey),
area AS MATERIALIZED (SELECT *, greatest(0.0::DOUBLE, width) * greatest(0.0::DOUBLE, height) AS area FROM e)"""


def _ratio(i: str, o: str, names=("x", "y", "width", "height")) -> str:
    x, y, w, h = (f"{o}.{n}" for n in names)
    shared = f"(greatest(0.0::DOUBLE, least({i}.x + {i}.width, {x} + {w}) - greatest({i}.x, {x})) * greatest(0.0::DOUBLE, least({i}.y + {i}.height, {y} + {h}) - greatest({i}.y, {y})))"
    size = f"(greatest(0.0::DOUBLE, {i}.x + {i}.width - {i}.x) * greatest(0.0::DOUBLE, {i}.y + {i}.height - {i}.y))"
    return f"(CASE WHEN {x} IS NULL OR {i}.x IS NULL OR {shared} <= 0 OR {size} <= 0 THEN 0.0::DOUBLE ELSE {shared} / {size} END)"


_SAME = "a.doc_id = b.doc_id AND a.page_number = b.page_number"

_PARENT = f"""WITH {_L},
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, ordinal) AS rank FROM area WHERE element_type <> 'table'),
pairs AS (SELECT b.doc_id, b.page_number, b.ordinal, b.rank AS child_rank, a.rank AS pr, a.ordinal AS po, {_ratio('b', 'a')} AS ratio FROM r a JOIN r b ON {_SAME} AND a.rank < b.rank WHERE {_ratio('b', 'a')} >= 0.6::DOUBLE)
SELECT doc_id, page_number, ordinal, arg_max(po, pr) AS parent_ordinal, arg_max(ratio, pr) AS ratio, CAST(min(pr) AS INTEGER) AS first_rank, CAST(any_value(child_rank) AS INTEGER) AS child_rank FROM pairs GROUP BY 1, 2, 3"""

_CLAIMS = f"""{_L},
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, ordinal) AS INTEGER) AS rank FROM area WHERE element_type = 'table'),
cell AS MATERIALIZED (SELECT doc_id, page_number, ordinal, rank, c AS cell_idx, x + width / 2 * (c % 2) AS cx, y + height / 2 * (c // 2) AS cy, width / 2 AS cw, height / 2 AS ch FROM t, (SELECT unnest(range(4)) AS c)),
hits AS (SELECT a.doc_id, a.page_number, a.ordinal, b.ordinal AS table_ordinal, b.rank AS table_rank, b.cell_idx, {_ratio('a', 'b', ('cx', 'cy', 'cw', 'ch'))} AS ratio
  FROM e a JOIN cell b ON {_SAME} AND a.ordinal <> b.ordinal WHERE a.element_type <> 'group' AND {_ratio('a', 'b', ('cx', 'cy', 'cw', 'ch'))} >= 0.5::DOUBLE),
claims AS MATERIALIZED (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, ordinal, table_ordinal ORDER BY ratio DESC, cell_idx) = 1)"""

_TAKING = """most AS (SELECT doc_id, page_number, max(rank) AS n FROM t GROUP BY 1, 2),
step(doc_id, page_number, k, gone) AS (
  SELECT doc_id, page_number, 0, CAST([] AS INTEGER[]) FROM most
  UNION ALL
  SELECT s.doc_id, s.page_number, s.k + 1, CASE WHEN list_contains(s.gone, s.k + 1) THEN s.gone ELSE list_concat(s.gone, coalesce((
      SELECT list(t.rank) FROM claims c JOIN t ON t.doc_id = c.doc_id AND t.page_number = c.page_number AND t.ordinal = c.ordinal
      WHERE c.doc_id = s.doc_id AND c.page_number = s.page_number AND c.table_rank = s.k + 1), [])) END
  FROM step s JOIN most USING (doc_id, page_number) WHERE s.k < most.n),
final AS (SELECT doc_id, page_number, gone FROM step JOIN most USING (doc_id, page_number) WHERE k = n)"""
_TABLE_ABSORB = f"""WITH RECURSIVE {_CLAIMS},
{_TAKING}
SELECT doc_id, page_number, ordinal, table_ordinal, cell_idx, ratio FROM claims JOIN final USING (doc_id, page_number) WHERE NOT list_contains(gone, table_rank)
QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, ordinal ORDER BY table_rank) = 1"""

_ANNOTATE = f"""WITH {_L},
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, ordinal) AS rank FROM area WHERE element_type = 'image')
SELECT a.doc_id, a.page_number, a.ordinal, b.ordinal AS image_ordinal, {_ratio('a', 'b')} AS ratio FROM e a JOIN i b ON {_SAME}
WHERE a.element_type IN ('text', 'unknown') AND length(a.st) BETWEEN 1 AND 60 AND {_ratio('a', 'b')} >= 0.5::DOUBLE
QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_number, a.ordinal ORDER BY b.rank) = 1"""

def _cuts(source: str, rows: str, least: str = "0.006::DOUBLE") -> str:
    """Recursive cuts of the elements in ``rows``: each step cuts every open node at its widest gap, down first."""
    node = "PARTITION BY doc_id, page_number, path"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""{source},
cut(doc_id, page_number, ordinal, x, y, width, height, path) AS (
  SELECT doc_id, page_number, ordinal, x, y, width, height, '0' FROM {rows}{' AND ' if ' WHERE ' in rows else ' WHERE '}x IS NOT NULL
  UNION ALL
  SELECT doc_id, page_number, ordinal, x, y, width, height, path || CASE WHEN hg > 0 AND hg >= {least} THEN CASE WHEN hr < hs THEN '.h0' ELSE '.h1' END ELSE CASE WHEN vr < vs THEN '.v0' ELSE '.v1' END END
  FROM (SELECT *, min(CASE WHEN hgap = hg THEN hr END) OVER ({node}) AS hs, min(CASE WHEN vgap = vg THEN vr END) OVER ({node}) AS vs
    FROM (SELECT *, max(hgap) OVER ({node}) AS hg, max(vgap) OVER ({node}) AS vg
      FROM (SELECT *, row_number() OVER ({node} ORDER BY y, ordinal) AS hr, row_number() OVER ({node} ORDER BY x, ordinal) AS vr,
          y - max(y + height) OVER ({node} ORDER BY y, ordinal {before}) AS hgap, x - max(x + width) OVER ({node} ORDER BY x, ordinal {before}) AS vgap FROM cut)))
  WHERE (hg > 0 AND hg >= {least}) OR (vg > 0 AND vg >= {least})),
leaf AS MATERIALIZED (SELECT doc_id, page_number, ordinal, arg_max(path, length(path)) AS spatial_group FROM cut GROUP BY 1, 2, 3)"""


_XY = _cuts(_L, "e") + """,
xy AS MATERIALIZED (SELECT doc_id, page_number, ordinal, spatial_group, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY spatial_group, y, x, z_order, ordinal) AS INTEGER) AS read_ord FROM e JOIN leaf USING (doc_id, page_number, ordinal))"""

#: Placeholders by index, the others by their leaves.
_COMPOSITE = """
placed AS MATERIALIZED (
  SELECT e.*, CASE WHEN placeholder_idx IS NULL THEN leaf.spatial_group ELSE 'ph' END AS spatial_group, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY placeholder_idx NULLS LAST,
    CASE WHEN placeholder_idx IS NULL THEN leaf.spatial_group END, CASE WHEN placeholder_idx IS NULL THEN y END, CASE WHEN placeholder_idx IS NULL THEN x END, CASE WHEN placeholder_idx IS NULL THEN z_order END, ordinal) AS INTEGER) AS read_ord
  FROM {0} e LEFT JOIN leaf USING (doc_id, page_number, ordinal))"""

_STORED = """c AS (SELECT doc_id, page_number, count(*) AS n, count(*) FILTER (layout = 'flow') AS f, count(*) FILTER (layout = 'flow' AND y >= 0.99::DOUBLE) AS s FROM {0} GROUP BY 1, 2),
choice AS MATERIALIZED (SELECT doc_id, page_number, coalesce(layout_mode = 'page_metrics', false) OR coalesce(source_format = 'docx', false) OR coalesce(f >= greatest(3, n // 2) AND s >= 3, false) AS as_stored FROM p LEFT JOIN c USING (doc_id, page_number)),
spatial AS MATERIALIZED (SELECT e.* FROM {0} e LEFT JOIN choice USING (doc_id, page_number) WHERE NOT coalesce(as_stored, false))"""

_READING = _cuts(f"{_E},\n{_STORED.format('e')}", "spatial WHERE placeholder_idx IS NULL") + "," + _COMPOSITE.format("spatial")

#: Groups of a page one after the other; ``texts`` holds what the groups so far made of the page's texts, by ordinal.
_MERGE_CTES = """r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, ordinal) AS rank FROM area WHERE element_type <> 'table'),
pairs AS (SELECT b.doc_id, b.page_number, b.ordinal, b.rank AS child_rank, a.rank AS pr, a.ordinal AS po FROM r a JOIN r b ON @same@ AND a.rank < b.rank WHERE @ratio@ >= 0.6::DOUBLE @children@),
held AS (SELECT doc_id, page_number, ordinal, arg_max(po, pr) AS po, min(pr) AS first_rank, any_value(child_rank) AS child_rank FROM pairs GROUP BY 1, 2, 3),
grp AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY place) AS k FROM (
    SELECT held.doc_id, held.page_number, po, any_value(t.element_type) AS ptype, any_value(t.element_id) AS pid, min({'f': first_rank, 'c': held.child_rank}) AS place,
      list({'o': c.ordinal, 't': c.element_type, 'id': c.element_id, 'ref': c.@ref@} ORDER BY c.y, c.x, first_rank, held.child_rank) AS kids
    FROM held JOIN e t ON t.doc_id = held.doc_id AND t.page_number = held.page_number AND t.ordinal = held.po JOIN e c ON c.doc_id = held.doc_id AND c.page_number = held.page_number AND c.ordinal = held.ordinal
    GROUP BY 1, 2, 3) WHERE ptype IN ('text', 'unknown', 'group')),
fold(doc_id, page_number, k, texts, po, new_text, kids, pid, only_text, contents) AS (
  SELECT doc_id, page_number, CAST(0 AS BIGINT), list(st ORDER BY ordinal), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), NULL::STRUCT(o INTEGER, t VARCHAR, id VARCHAR, ref VARCHAR)[], CAST(NULL AS VARCHAR), false, CAST(NULL AS VARCHAR[])
  FROM e WHERE (doc_id, page_number) IN (SELECT doc_id, page_number FROM grp) GROUP BY 1, 2
  UNION ALL
  SELECT doc_id, page_number, k, [CASE WHEN j = po + 1 AND len(parts) > 0 THEN array_to_string(parts, chr(10)) ELSE texts[j] END FOR j IN range(1, len(texts) + 1)], po, CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10)) END,
    kids, pid, ptype = 'text' AND len([c FOR c IN kids IF c.t <> 'text']) = 0, [CASE WHEN c.t = 'image' THEN '![' || c.id || '](' || coalesce(nullif(c.ref, ''), 'image-not-exported') || ')' ELSE texts[c.o + 1] END FOR c IN kids]
  FROM (SELECT f.doc_id, f.page_number, g.k, f.texts, g.po, g.kids, g.pid, g.ptype,
      list_reduce([f.texts[c.o + 1] FOR c IN g.kids IF c.t = 'text' AND f.texts[c.o + 1] <> ''], lambda acc, v: CASE WHEN list_contains(acc, v) THEN acc ELSE list_append(acc, v) END,
        CASE WHEN f.texts[g.po + 1] <> '' THEN [f.texts[g.po + 1]] ELSE CAST([] AS VARCHAR[]) END) AS parts
    FROM fold f JOIN grp g ON g.doc_id = f.doc_id AND g.page_number = f.page_number AND g.k = f.k + 1)),
top AS (SELECT * FROM fold WHERE k > 0),
kid AS (SELECT doc_id, page_number, unnest(kids).o AS ordinal, pid FROM top)"""


def merge_ctes(children: str = "", ref: str = "image_ref") -> str:
    """From ``area`` and ``e`` to ``top`` (containers with their new texts) and ``kid`` (what they hold)."""
    return _MERGE_CTES.replace("@same@", _SAME).replace("@ratio@", _ratio("b", "a")).replace("@children@", children).replace("@ref@", ref)


_MERGE = f"WITH RECURSIVE {_L},\n" + merge_ctes() + """
SELECT doc_id, page_number, e.ordinal, coalesce(new_text, text) AS text, kid.pid AS absorbed_by, CASE WHEN only_text THEN array_to_string([c.id FOR c IN kids], ',') END AS merged_children,
  CASE WHEN NOT only_text AND len([v FOR v IN contents IF v <> '']) > 0 THEN CAST(to_json([{'element_id': kids[j].id, 'type': kids[j].t, 'content': contents[j]} FOR j IN range(1, len(kids) + 1) IF contents[j] <> '']) AS VARCHAR) END AS absorbed_children
FROM e LEFT JOIN (SELECT doc_id, page_number, po AS ordinal, * EXCLUDE (doc_id, page_number, po, pid) FROM top) t USING (doc_id, page_number, ordinal) LEFT JOIN kid USING (doc_id, page_number, ordinal)"""

_ROWS = f"""{_L},
tops AS (SELECT doc_id, page_number, list_sort(list(DISTINCT y)) AS ys FROM e GROUP BY 1, 2),
anchors AS (SELECT doc_id, page_number, list_reduce(ys[2:], lambda acc, v: CASE WHEN v - acc[len(acc)] > 0.02::DOUBLE THEN list_append(acc, v) ELSE acc END, [ys[1]]) AS anchors FROM
  (SELECT doc_id, page_number, list_transform(ys, lambda v: v) AS ys FROM tops)),
rowed AS MATERIALIZED (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id, e.page_number ORDER BY len(list_filter(anchors, lambda v: v <= e.y)), x, z_order, y, ordinal) AS read_ord FROM e JOIN anchors USING (doc_id, page_number))"""

_TITLES = f"""WITH {_E},
t AS (SELECT * FROM e WHERE element_type = 'text' AND st <> '' AND (is_placeholder OR (length(st) <= 80 AND NOT contains(st, chr(10)))) QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ordinal) = 1)
SELECT b.doc_id, b.page_number, a.ordinal AS source_ordinal, b.ordinal AS target_ordinal, 0.7::DOUBLE AS confidence FROM t a JOIN e b ON {_SAME} AND a.ordinal <> b.ordinal
WHERE b.y >= a.y AND b.y - (a.y + a.height) <= 0.5::DOUBLE"""

_WORDS = " OR ".join(f"contains(lower(caption_text), '{w}')" for w in CAPTION_WORDS)
_CAND = f"""{_L},
pair AS (
  SELECT a.doc_id, a.page_number, a.ordinal AS text_ordinal, b.ordinal AS visual_ordinal, b.element_id AS visual_element_id, a.st AS caption_text, a.width AS tw, a.height AS th, b.width AS vw, b.height AS vh,
    greatest(0.0::DOUBLE, least(b.x + b.width, a.x + a.width) - greatest(b.x, a.x)) / greatest(least(b.x + b.width - b.x, a.x + a.width - a.x), 1e-6::DOUBLE) AS ov,
    a.y - (b.y + b.height) AS below, b.y - (a.y + a.height) AS above
  FROM e a JOIN e b ON {_SAME} WHERE a.element_type = 'text' AND a.st <> '' AND b.element_type IN ('image', 'table')),
gated AS (
  SELECT *, CASE WHEN below >= 0 AND above >= 0 THEN least(below, above) WHEN below >= 0 THEN below WHEN above >= 0 THEN above END AS gap, greatest(tw * th, 1e-9::DOUBLE) / greatest(vw * vh, 1e-9::DOUBLE) AS sz FROM pair),
parts AS (
  SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - gap / 0.3::DOUBLE) AS proximity, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ov)) AS alignment,
    CASE WHEN sz < 0.5 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - sz) END AS size_ratio,
    CASE WHEN below >= 0 AND below <= 0.3::DOUBLE THEN 0.8::DOUBLE WHEN above >= 0 AND above <= 0.3::DOUBLE THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS position,
    greatest(CASE WHEN length(caption_text) BETWEEN 8 AND 120 THEN 1.0::DOUBLE WHEN length(caption_text) BETWEEN 1 AND 180 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN {_WORDS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS text_hint,
    CASE WHEN caption_text[1] IN ('-', '•', '·') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS bullet_penalty
  FROM gated WHERE ov >= 1.0::DOUBLE - 0.2::DOUBLE AND gap IS NOT NULL AND gap <= 0.3::DOUBLE),
scored AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * proximity + 0.25::DOUBLE * alignment + 0.15::DOUBLE * size_ratio + 0.15::DOUBLE * position + 0.1::DOUBLE * text_hint - bullet_penalty)) AS score FROM parts),
cand AS MATERIALIZED (SELECT *, CASE WHEN score >= 0.65::DOUBLE THEN 'caption_of' ELSE 'related_to' END AS relation_type FROM scored WHERE score >= 0.45::DOUBLE),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, page_number, text_ordinal ORDER BY score DESC, visual_ordinal, text_ordinal) > 1 THEN 'caption_already_assigned' END AS rejected_reason,
    CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, visual_ordinal, text_ordinal) AS INTEGER) AS rank FROM cand)"""
_KEYS = "doc_id, page_number, text_ordinal, visual_ordinal"

#: Blocks of document_elements in stored order, without titles.
_BLOCKS = f"""{_E},
lv AS (SELECT *, CASE WHEN is_heading THEN least(greatest(coalesce(nullif(heading_level, 0), 2), 1), 6) WHEN is_placeholder THEN 3 END AS level,
  CASE p2.source_format WHEN 'pptx' THEN 'Slide ' || page_number WHEN 'xlsx' THEN coalesce(nullif(p2.sheet_name, ''), 'Sheet ' || page_number) WHEN 'hwpx' THEN 'Section ' || page_number END AS container
  FROM e LEFT JOIN (SELECT doc_id, page_number, source_format, sheet_name FROM p) p2 USING (doc_id, page_number)),
hd AS MATERIALIZED (SELECT doc_id, page_number, ordinal, level, coalesce(nullif(st, ''), 'heading') AS label FROM lv WHERE level IS NOT NULL),
par AS MATERIALIZED (
  SELECT a.doc_id, a.page_number, a.ordinal, max(b.ordinal) AS parent FROM lv a JOIN hd b ON {_SAME} AND b.ordinal < a.ordinal AND b.level < coalesce(a.level, 7) GROUP BY 1, 2, 3),
o AS MATERIALIZED (
  SELECT *, level IS NOT NULL OR element_type IN ('table', 'image') OR (parent IS NULL AND container IS NULL) AS makes,
    sum(CASE WHEN level IS NOT NULL OR element_type IN ('table', 'image') OR (parent IS NULL AND container IS NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY ordinal) + CASE WHEN container IS NULL THEN 0 ELSE 1 END AS own
  FROM lv LEFT JOIN par USING (doc_id, page_number, ordinal)),
pi AS (SELECT o.*, coalesce(h.own, CASE WHEN o.container IS NOT NULL THEN 1 END) AS pidx FROM o LEFT JOIN (SELECT doc_id, page_number, ordinal AS parent, own FROM o WHERE level IS NOT NULL) h USING (doc_id, page_number, parent)),
kind AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'heading' WHEN element_type = 'table' THEN 'table' WHEN element_type = 'image' THEN 'figure' WHEN is_list_item THEN 'list_item' ELSE 'paragraph' END AS kind FROM pi),
blk AS (
  SELECT doc_id, page_number, CAST(own AS INTEGER) AS block_idx, kind, coalesce(level, 0) AS level, CASE kind WHEN 'heading' THEN st WHEN 'figure' THEN 'figure' ELSE coalesce(nullif(st, ''), kind) END AS title_text, pidx FROM kind WHERE makes
  UNION ALL SELECT DISTINCT doc_id, page_number, 1, 'container', 1, CASE source_format WHEN 'pptx' THEN 'Slide ' || page_number WHEN 'xlsx' THEN coalesce(nullif(sheet_name, ''), 'Sheet ' || page_number) ELSE 'Section ' || page_number END, NULL
    FROM p WHERE source_format IN ('pptx', 'xlsx', 'hwpx')),
it AS (SELECT *, CAST(CASE WHEN makes THEN own ELSE pidx END AS INTEGER) AS block_idx FROM kind),
ids AS (
  SELECT doc_id, page_number, block_idx, string_agg(element_id, ',' ORDER BY ordinal) AS element_ids FROM
    (SELECT doc_id, page_number, block_idx, element_id, min(ordinal) AS ordinal FROM it GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""

_BID = "printf('B_%03d_%04d', page_number, CAST({} AS INTEGER))"

#: Cells of document tables with the grid of their table.
_C = f"""{_E},
cell AS MATERIALIZED (
  SELECT e.doc_id, e.page_number, e.ordinal, c.* EXCLUDE (package_id, element_uid, cell_uid, text), c.text AS raw, {_strip('c.text')} AS text, e.x, e.y, e.width, e.height,
    max(row_idx) OVER (PARTITION BY e.doc_id, e.page_number, e.ordinal) + 1 AS nrows, max(col_idx) OVER (PARTITION BY e.doc_id, e.page_number, e.ordinal) + 1 AS ncols
  FROM e JOIN (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_uid) = 1) c USING (element_uid) WHERE e.element_type = 'table'),
use AS (SELECT *, coalesce(span_width, 1) AS sw, coalesce(span_height, 1) AS sh FROM cell WHERE NOT coalesce(is_spanned, false))"""


def _br(c: str, joint: str) -> str:
    return f"(CASE WHEN contains({c}, chr(10)) THEN array_to_string(list_transform(string_split({c}, chr(10)), lambda l: rtrim(l, {_WS})), {joint}) ELSE {c} END)"


_HEAD = f"""{_C},
con AS (SELECT *, {_br('text', "'<br/>'")} AS content, {_br("coalesce(nullif(trim(formatted_text, (SELECT ws FROM white)), ''), text)", "'<br/>'")} AS shown FROM use),
hs AS (
  SELECT doc_id, page_number, ordinal, max(row_idx) AS max_row, count(*) FILTER (row_idx = 0) AS n, count(*) FILTER (row_idx = 0 AND content <> '' AND length(content) <= 30) AS short,
    coalesce(bool_or(row_idx = 0 AND (sw > 1 OR sh > 1)), false) AS spanned, max(sh) FILTER (row_idx = 0) AS tallest FROM con GROUP BY 1, 2, 3),
hdr AS MATERIALIZED (
  SELECT doc_id, page_number, ordinal, max_row, CASE WHEN n > 0 AND 0.5::DOUBLE * (0.5::DOUBLE + CASE WHEN spanned THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + 0.3::DOUBLE * 0.0::DOUBLE + 0.2::DOUBLE * (short / greatest(n, 1)) >= 0.45::DOUBLE
    THEN greatest(1, least(tallest, max_row + 1)) ELSE 0 END AS header_rows FROM hs)"""


def _html_rows(tag: str, content: str, source: str) -> str:
    return f"""(SELECT doc_id, page_number, ordinal, row_idx, '<tr>' || string_agg('<' || {tag} || CASE WHEN sw > 1 THEN ' colspan="' || sw || '"' ELSE '' END || CASE WHEN sh > 1 THEN ' rowspan="' || sh || '"' ELSE '' END
      || '>' || {content} || '</' || {tag} || '>', '' ORDER BY col_idx, cell_idx) || '</tr>' AS row FROM {source} GROUP BY 1, 2, 3, 4)"""


_MD = f"""{_E},
body0 AS (
  SELECT *, replace(st, chr(9), ' · ') AS shown, element_type = 'text' AND st <> '' AND is_placeholder AS opens FROM e),
body1 AS (
  SELECT *, {_br('shown', "'  ' || chr(10)")} AS plain, CASE WHEN element_type = 'text' AND NOT is_heading THEN starts_with(shown, '# ') WHEN element_type IN ('text', 'image', 'chart') THEN false ELSE starts_with(st, '# ') END AS looks FROM body0),
body2 AS (SELECT *, coalesce(bool_or(opens OR looks) OVER (PARTITION BY doc_id, page_number ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS used FROM body1),
body AS (
  SELECT *, CASE element_type
    WHEN 'text' THEN CASE WHEN st = '' THEN '' WHEN is_placeholder AND NOT used THEN '# ' || shown WHEN is_heading THEN repeat('#', least(greatest(coalesce(nullif(heading_level, 0), 2), 2), 6)) || ' ' || shown ELSE plain END
    WHEN 'image' THEN '<img src="' || coalesce(nullif(image_ref, ''), 'image-not-exported') || '" alt="' || element_id || '"/>'
    WHEN 'chart' THEN CASE WHEN coalesce(text, '') = '' THEN '> [chart]' ELSE '> [chart] ' || st END
    ELSE {_br('st', "'  ' || chr(10)")} END AS body FROM body2)"""



def _roman(n: str) -> str:
    """Roman numeral from the fixed table, one place at a time."""
    table = {v: s for v, s in ROMAN}
    out = [f"repeat('M', {n} // 1000)"]
    for unit in (100, 10, 1):
        one, four, five, nine = table[unit], table[4 * unit], table[5 * unit], table[9 * unit]
        digits = ["", one, one * 2, one * 3, four, five, five + one, five + one * 2, five + one * 3, nine]
        out.append("[" + ", ".join(f"'{x}'" for x in digits) + f"][({n} // {unit}) % 10 + 1]")
    return "(" + " || ".join(out) + ")"


_RUNS = """runs AS MATERIALIZED (
  SELECT l_orderkey AS shape, CAST(l_linenumber % 2 AS INTEGER) AS par, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS run_idx,
    l_returnflag || l_linestatus || l_linenumber AS text, l_partkey % 4 < 3 AS bold, l_suppkey % 3 = 0 AS italic, l_quantity > 40 AS underline FROM lineitem)"""
_DOMINANT = ", ".join(f"sum(CASE WHEN {f} THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1) >= 0.8::DOUBLE AND sum(length(text)) > 0 AS dominant_{f}" for f in ("bold", "italic", "underline"))


def _merge(source: str) -> str:
    return f"""SELECT shape, par, min(run_idx) AS run_idx, string_agg(text, '' ORDER BY run_idx) AS text, bold, italic, underline FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY shape, par ORDER BY run_idx) AS g FROM (
        SELECT *, CASE WHEN (bold, italic, underline) IS DISTINCT FROM lag((bold, italic, underline)) OVER (PARTITION BY shape, par ORDER BY run_idx) THEN 1 ELSE 0 END AS fresh FROM {source} WHERE text <> ''))
    GROUP BY shape, par, g, bold, italic, underline"""


_TWO = f"""{_ROWS},
ex AS (SELECT doc_id, page_number, chr(ordinal + 40) AS id, ordinal AS e FROM e),
pr AS (SELECT doc_id, page_number, chr(ordinal + 40) AS id, read_ord AS p FROM rowed WHERE ordinal % 7 <> 3),
tau AS (
  SELECT k.doc_id, k.page_number, coalesce(s / nullif(n, 0), 1.0::DOUBLE) AS tau FROM (SELECT DISTINCT doc_id, page_number FROM e) k LEFT JOIN (
    SELECT a.doc_id, a.page_number, CAST(sum(sign(b.p - a.p)) AS DOUBLE) AS s, CAST(sum(abs(sign(b.p - a.p))) AS DOUBLE) AS n
    FROM (SELECT * FROM ex JOIN pr USING (doc_id, page_number, id)) a JOIN (SELECT * FROM ex JOIN pr USING (doc_id, page_number, id)) b ON {_SAME} AND a.e < b.e GROUP BY 1, 2) USING (doc_id, page_number)),
ned AS (
  SELECT doc_id, page_number, 1.0::DOUBLE - levenshtein(x, coalesce(y, '')) / CAST(greatest(length(x), length(coalesce(y, ''))) AS DOUBLE) AS ned
  FROM (SELECT doc_id, page_number, string_agg(id, '' ORDER BY e) AS x FROM ex GROUP BY 1, 2) LEFT JOIN (SELECT doc_id, page_number, string_agg(id, '' ORDER BY p) AS y FROM pr GROUP BY 1, 2) USING (doc_id, page_number))"""

_PRF = """gold AS (SELECT DISTINCT CAST(package_id AS VARCHAR) AS doc_id, rel_idx, relation_type, source_element_id AS s, target_element_id AS t, rel_idx + package_id AS n FROM element_relations),
g AS (SELECT DISTINCT {k} relation_type, s, t FROM gold), q AS (SELECT DISTINCT {k} CASE WHEN n % 7 = 0 THEN 'related_to' ELSE relation_type END AS relation_type, s, t FROM gold WHERE n % 5 <> 0),
f AS (SELECT {k} relation_type, coalesce(gg, 0) AS gg, coalesce(qq, 0) AS qq FROM (SELECT *, 1 AS gg FROM g) FULL JOIN (SELECT *, 1 AS qq FROM q) USING ({k} relation_type, s, t)),
c AS (SELECT {k} CASE WHEN grouping(relation_type) = 1 THEN '_overall' ELSE relation_type END AS relation_type, CAST(sum(gg * qq) AS BIGINT) AS tp, CAST(sum(qq * (1 - gg)) AS BIGINT) AS fp, CAST(sum(gg * (1 - qq)) AS BIGINT) AS fn
  FROM f GROUP BY GROUPING SETS (({k} relation_type), ({g}))),
pp AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM c)"""
_F1 = "2 * precision * recall / greatest(precision + recall, 1e-9::DOUBLE) AS f1"

#: Lines of the documents, stripped; blank ones are left out.
_LINES = f"""{_WHITE}, ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10))), (SELECT ws FROM white)) AS l FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))"""
_ONE_EACH = f"WITH {_LINES} SELECT doc_id, 'text' AS element_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ordinal, l AS text FROM ln WHERE l <> ''"
_ALL_IN_ONE = f"WITH {_LINES} SELECT doc_id, '{{}}' AS element_type, 0 AS ordinal, string_agg(l, chr(10) ORDER BY i) AS text FROM ln WHERE l <> '' GROUP BY 1"


def _as_list(j: str) -> str:
    """A JSON list; anything else as a list of one, null and absent as none."""
    return f"(CASE json_type({j}) WHEN 'ARRAY' THEN CAST({j} AS JSON[]) WHEN 'NULL' THEN [] ELSE CASE WHEN {j} IS NULL THEN [] ELSE [{j}] END END)"


def _child(parent: str, name: str, keys: str, pos: str, value: str, source: str) -> str:
    listed = _as_list(value)
    return f"{name} AS (SELECT {keys}, generate_subscripts({listed}, 1) AS {pos}, unnest({listed}) AS j FROM {source})"


_J = ", ".join([
    "r AS (SELECT DISTINCT record_id, CAST(payload AS JSON) AS j FROM raw_records WHERE json_valid(payload))",
    "r1 AS (SELECT record_id, json_extract(j, '$.pages') AS v FROM r)", _child("r1", "pg", "record_id", "page_pos", "v", "r1"),
    "r2 AS (SELECT record_id, page_pos, json_extract(j, '$.elements') AS v FROM pg)", _child("r2", "el", "record_id, page_pos", "element_pos", "v", "r2"),
    "r3a AS (SELECT *, json_extract(j, '$.metadata') AS m FROM el)",
    "r3 AS (SELECT record_id, page_pos, element_pos, json_extract(CASE WHEN json_type(m) = 'VARCHAR' THEN TRY_CAST(json_extract_string(m, '$') AS JSON) ELSE m END, '$.table_cells') AS v FROM r3a)",
    _child("r3", "ce", "record_id, page_pos, element_pos", "cell_pos", "v", "r3"),
    "r4 AS (SELECT record_id, page_pos, element_pos, cell_pos, json_extract(j, '$.absorbed_elements') AS v FROM ce)", _child("r4", "ab", "record_id, page_pos, element_pos, cell_pos", "absorbed_pos", "v", "r4"),
])


def _jn(name: str, kind: str = "INTEGER") -> str:
    number = f"TRY_CAST(json_extract_string(j, '$.{name}') AS DOUBLE)"
    return f"CAST(trunc({number}) AS {kind})" if kind == "INTEGER" else number


def _jb(name: str) -> str:
    return ", ".join(f"{_jn(f'{name}.{k}', 'DOUBLE')} AS {k}" for k in ("x", "y", "width", "height"))


_POS = ", ".join(f"CAST({x}_pos AS INTEGER) AS {x}_pos" for x in ("page", "element", "cell", "absorbed"))

def _prefix(k: str, n: str) -> str:
    """Number ``n`` in the kind of place ``k`` of the list of kinds."""
    return f"""CASE {k} WHEN 0 THEN {n} || '. ' WHEN 1 THEN {n} || ') ' WHEN 2 THEN {n} || ' ' WHEN 3 THEN chr(CAST(97 + ({n} - 1) % 26 AS INTEGER)) || '. ' WHEN 4 THEN chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)) || ') '
        WHEN 5 THEN lower({_roman(n)}) || '. ' WHEN 6 THEN {_roman(n)} || ') ' WHEN 7 THEN CASE WHEN {n} <= 20 THEN chr(CAST(9311 + {n} AS INTEGER)) || ' ' ELSE '(' || {n} || ') ' END ELSE {n} || '. ' END"""


#: Order lines numbered from 0, and the rows of a table made of them: plain, with a wide first cell, with a last cell that
#: goes on from above.
_NUMBERED = "li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS n FROM lineitem)"
_GRID = f"""{_NUMBERED},
gr AS (SELECT l_orderkey, n AS row_idx, CAST(c AS INTEGER) AS col_idx, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)][c + 1] AS text, (n % 3 = 1 AND c = 1) OR (n % 3 = 2 AND c = 2) AS is_spanned,
  n % 3 = 1 AND c = 0 AS wide, n % 3 = 1 AND c = 2 AND n < max(n) OVER (PARTITION BY l_orderkey) AS tall FROM li, (SELECT unnest(range(3)) AS c))"""
_GRID_ROWS = "SELECT l_orderkey, row_idx, col_idx, CASE WHEN NOT is_spanned THEN text END AS text, is_spanned, CASE WHEN wide THEN 2 ELSE 1 END AS span_width"

ORACLES = {
    "pptx_numbering_roundtrip": f"""WITH {_WHITE}, q AS (SELECT p_partkey, {_strip('p_name')} AS name, p_partkey % 9 AS k, p_partkey % 60 + 1 AS n, p_partkey % 60 + 2 AS n2, p_partkey % 60 + 3 AS n3 FROM part)
        SELECT p_partkey, {_prefix('k', 'n')} || name || chr(10) || {_prefix('k', 'n2')} || 'next' || chr(10) || '– sign' || chr(10) || {_prefix('k', 'n3')} || 'third' || chr(10) || {_prefix('k', 'n')} || 'again' || chr(10) || 'none' AS text FROM q""",
    "pptx_shapes_roundtrip": f"""WITH {_NUMBERED}, s AS (
          SELECT l_orderkey, n, n % 4 AS k, l_partkey % 80 * 100000 AS px, l_suppkey % 80 * 100000 AS py, CAST(l_quantity AS INTEGER) * 100000 AS w, (n + 1) * 100000 AS h,
            CAST(n + coalesce(sum(CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS ordinal FROM li),
        a AS (
          SELECT l_orderkey, ordinal, CASE k WHEN 1 THEN 'image' WHEN 2 THEN 'group' ELSE 'text' END AS element_type, CASE WHEN k IN (0, 3) THEN 'T' || n END AS text, k = 3 AS is_placeholder, px, py, w, h, CASE WHEN k = 1 THEN '0.25 0.00 0.00 0.10' END AS crop FROM s
          UNION ALL SELECT l_orderkey, ordinal + 1, 'text', 'T' || n, false, px + 100000, py + 200000, 100000, 100000, NULL FROM s WHERE k = 2)
        SELECT l_orderkey, ordinal, printf('%04d', ordinal + 1) AS number, element_type, text, is_placeholder, least(1.0::DOUBLE, px / 9144000.0::DOUBLE) AS x, least(1.0::DOUBLE, py / 6858000.0::DOUBLE) AS y,
          greatest(1e-6::DOUBLE, least(1.0::DOUBLE, w / 9144000.0::DOUBLE)) AS width, greatest(1e-6::DOUBLE, least(1.0::DOUBLE, h / 6858000.0::DOUBLE)) AS height, crop FROM a""",
    "pptx_tables_roundtrip": f"WITH {_GRID} {_GRID_ROWS}, CASE WHEN tall THEN 2 ELSE 1 END AS span_height, wide OR tall AS is_merge_origin FROM gr",
    "pptx_layers_roundtrip": f"""WITH s AS (SELECT DISTINCT s_suppkey AS k, {_strip('s_name').replace('(SELECT ws FROM white)', _WS)} AS name FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY k // 16 ORDER BY k) AS page FROM s),
        q(k, ordinal, element_type, text, is_placeholder, image_ref, image_width, px, py, w, h) AS (
          SELECT k, 0, 'text', name, true, NULL, NULL, 914400, 685800, 4572000, 685800 FROM r UNION ALL SELECT k, 1, 'text', 'B' || k, true, NULL, NULL, 457200, 1371600, 4572000, 3429000 FROM r
          UNION ALL SELECT k, 2, 'image', NULL, false, printf('slide%03d_shape0003.png', page), 100, 0, 0, 952500, 952500 FROM r UNION ALL SELECT k, 3, 'chart', NULL, false, NULL, NULL, 0, 0, 9144000, 6858000 FROM r
          UNION ALL SELECT k, 4, 'text', 'F' || k || chr(10) || '[MATH] x + y', false, NULL, NULL, 0, 0, 0, 0 FROM r UNION ALL SELECT k, 5, 'text', 'Layout text', true, NULL, NULL, 0, 6172200, 914400, 342900 FROM r WHERE page = 1
          UNION ALL SELECT k, 6, 'text', 'Company', false, NULL, NULL, 0, 0, 914400, 342900 FROM r WHERE page = 1)
        SELECT k AS s_suppkey, ordinal, element_type, text, is_placeholder, image_ref, image_width, px / 9144000.0::DOUBLE AS x, py / 6858000.0::DOUBLE AS y, greatest(1e-6::DOUBLE, w / 9144000.0::DOUBLE) AS width, greatest(1e-6::DOUBLE, h / 6858000.0::DOUBLE) AS height FROM q""",
    "docx_drawings_roundtrip": f"""WITH s AS (SELECT DISTINCT s_suppkey AS k, {_strip('s_name').replace('(SELECT ws FROM white)', _WS)} AS name FROM supplier),
        b AS (SELECT *, k % 50 * 10000 / 7772400.0::DOUBLE AS bx, k % 30 * 20000 / 10058400.0::DOUBLE AS bb, 720.0::DOUBLE / 15840.0::DOUBLE AS top, 720.0::DOUBLE / 12240.0::DOUBLE AS inset FROM s)
        SELECT k AS s_suppkey, 0 AS ordinal, 'text' AS element_type, 'Box' || k AS text, 102 AS z_order, 'floating_textbox' AS layout, NULL AS image_ref, bx AS x, bb AS y, least(1828800 / 7772400.0::DOUBLE, 1.0::DOUBLE - bx) AS width, least(914400 / 10058400.0::DOUBLE, 1.0::DOUBLE - bb) AS height FROM b
        UNION ALL SELECT k, 1, 'image', NULL, 4, 'inline', 'pic.png', 457200 / 7772400.0::DOUBLE, 457200 / 10058400.0::DOUBLE, 914400 / 7772400.0::DOUBLE, 914400 / 10058400.0::DOUBLE FROM b
        UNION ALL SELECT k, 2, 'text', name, 5, 'flow', NULL, inset, top + 0.025::DOUBLE + 0.025::DOUBLE, 10800.0::DOUBLE / 12240.0::DOUBLE, 0.025::DOUBLE FROM b""",
    "hwpx_tables_roundtrip": f"WITH {_GRID} {_GRID_ROWS}, CASE WHEN tall THEN 2 ELSE 1 END AS span_height, NOT is_spanned AS is_merge_origin FROM gr",
    "xlsx_drawings_roundtrip": f"""WITH s AS (SELECT DISTINCT s_suppkey AS k, {_strip('s_name').replace('(SELECT ws FROM white)', _WS)} AS name FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY k // 16 ORDER BY k) AS page FROM s)
        SELECT k AS s_suppkey, 0 AS ordinal, 'table' AS element_type, k || ' | ' || chr(10) || ' | ' || name AS text, NULL AS image_ref, 'S' || k AS sheet_name, 0.02::DOUBLE AS x, 0.0::DOUBLE AS y, 0.96::DOUBLE AS width, 0.9::DOUBLE AS height, '1 1' AS col_widths FROM r
        UNION ALL SELECT k, 1, 'image', NULL, 'sheet' || page || '_img1.png', NULL, k % 2 / 2, k % 4 / 4, 0.5::DOUBLE, 0.25::DOUBLE, NULL FROM r
        UNION ALL SELECT k, 2, 'chart', CASE WHEN k % 2 = 1 THEN name ELSE 'Chart 1' END, NULL, NULL, 0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, NULL FROM r""",
    "pptx_markdown_roundtrip": f"""WITH {_GRID}, rw AS (
          SELECT l_orderkey, row_idx, '<tr>' || string_agg('<' || tag || CASE WHEN wide THEN ' colspan="2"' ELSE '' END || CASE WHEN tall THEN ' rowspan="2"' ELSE '' END || '>' || text || '</' || tag || '>', '' ORDER BY col_idx) || '</tr>' AS row
          FROM (SELECT *, CASE WHEN row_idx = 0 THEN 'th' ELSE 'td' END AS tag FROM gr WHERE NOT is_spanned) GROUP BY 1, 2),
        tb AS (SELECT l_orderkey, '<table>' || chr(10) || '<colgroup>' || chr(10) || '<col style="width:16.7%"/>' || chr(10) || '<col style="width:33.3%"/>' || chr(10) || '<col style="width:50.0%"/>' || chr(10) || '</colgroup>' || chr(10) || '<thead>' || chr(10)
          || any_value(row) FILTER (row_idx = 0) || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || coalesce(string_agg(row, chr(10) ORDER BY row_idx) FILTER (row_idx > 0) || chr(10), '') || '</tbody>' || chr(10) || '</table>' AS html FROM rw GROUP BY 1)
        SELECT l_orderkey // 16 AS package, string_agg('<!-- Page ' || page || ' -->' || chr(10) || chr(10) || html, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) || chr(10) AS markdown
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey) AS page FROM tb) GROUP BY 1""",
    "docx_tables_roundtrip": f"WITH {_GRID} {_GRID_ROWS}, 1 AS span_height, NOT is_spanned AS is_merge_origin FROM gr",
    "docx_structure_roundtrip": f"""WITH {_LINES}, q AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS i, l FROM ln WHERE l <> '')
        SELECT doc_id, i - 1 AS ordinal, CASE WHEN i % 4 = 2 THEN repeat('  ', i % 3) || '- ' || l ELSE l END AS text, i % 4 = 1 AS is_heading, CASE WHEN i % 4 = 1 THEN 1 + i % 3 END AS heading_level, i % 4 = 2 AS is_list_item,
          CASE WHEN i % 4 = 2 THEN i % 3 END AS list_level, CASE WHEN i % 4 = 1 THEN 'Heading' || (1 + i % 3) END AS paragraph_style, i % 4 = 3 AS is_mostly_bold, CASE WHEN i % 4 = 3 THEN '**' || l[1] || '**' || l[2:] END AS formatted_text,
          CASE WHEN l[1] = '[' AND contains(l, ']') THEN 'bracket_leading' END AS line_pattern FROM q""",
    "xlsx_values_roundtrip": f"""WITH {_NUMBERED}, c AS (SELECT unnest(range(7)) AS c),
        v AS (SELECT l_orderkey, n AS row_idx, CAST(c AS INTEGER) AS col_idx, CASE c WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 1 THEN CAST(l_extendedprice AS VARCHAR) WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 00:00:00'
            WHEN 3 THEN CASE WHEN l_partkey % 2 = 1 THEN 'True' ELSE 'False' END WHEN 4 THEN l_returnflag WHEN 6 THEN 'p' || l_partkey END AS text FROM li, c)
        SELECT l_orderkey, row_idx, col_idx, text, row_idx = 0 AND col_idx = 5 AS is_spanned, CASE WHEN row_idx = 0 AND col_idx = 4 THEN 2 ELSE 1 END AS span_width FROM v""",
    "docx_ingest_roundtrip": _ONE_EACH,
    "hwpx_ingest_roundtrip": _ONE_EACH,
    "pptx_ingest_roundtrip": _ALL_IN_ONE.format("text"),
    "xlsx_ingest_roundtrip": _ALL_IN_ONE.format("table"),
    "p4_found": f"WITH {_J} SELECT DISTINCT record_id, {_POS.rpartition(', ')[0]} FROM ce WHERE coalesce({_jn('span_width')}, 1) * coalesce({_jn('span_height')}, 1) > 1",
    "p4_pages": f"WITH {_J} SELECT record_id, CAST(page_pos AS INTEGER) AS page_pos, {_jn('page_number')} AS page_number, {_jn('width', 'DOUBLE')} AS width, {_jn('height', 'DOUBLE')} AS height, coalesce(json_type(json_extract(j, '$.metadata')), 'NULL') <> 'NULL' AS has_metadata FROM pg",
    "p4_elements": f"""WITH {_J} SELECT record_id, CAST(page_pos AS INTEGER) AS page_pos, CAST(element_pos AS INTEGER) AS element_pos, json_extract_string(j, '$.element_id') AS element_id, json_extract_string(j, '$.element_type') AS element_type,
        {_jn('z_order')} AS z_order, {_jb('bbox')}, json_extract_string(j, '$.text') AS text, coalesce(json_type(json_extract(j, '$.metadata')), 'NULL') <> 'NULL' AS has_metadata FROM el""",
    "p4_cells": f"""WITH {_J} SELECT record_id, {_POS.rpartition(', ')[0]}, {_jn('row')} AS row, {_jn('col')} AS col, json_extract_string(j, '$.text') AS text, json_extract_string(j, '$.formatted_text') AS formatted_text,
        TRY_CAST(json_extract_string(j, '$.is_spanned') AS BOOLEAN) AS is_spanned, {_jn('span_width')} AS span_width, {_jn('span_height')} AS span_height, TRY_CAST(json_extract_string(j, '$.is_merge_origin') AS BOOLEAN) AS is_merge_origin, {_jb('cell_bbox')} FROM ce""",
    "p4_absorbed": f"WITH {_J} SELECT record_id, {_POS}, json_extract_string(j, '$.element_id') AS element_id, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.content') AS content, {_jn('containment', 'DOUBLE')} AS containment, {_jn('y', 'DOUBLE')} AS y, {_jn('x', 'DOUBLE')} AS x FROM ab",
    "bbox_normalize": f"""WITH {_E}, b AS (SELECT e.element_uid, e.x * p.width / greatest(p.width, 1.0::DOUBLE) AS x, e.y * p.height / greatest(p.height, 1.0::DOUBLE) AS y,
          e.width * p.width / greatest(p.width, 1.0::DOUBLE) AS w, e.height * p.height / greatest(p.height, 1.0::DOUBLE) AS h FROM e JOIN p USING (doc_id, page_number))
        SELECT element_uid, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)) AS x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y)) AS y, greatest(1e-6::DOUBLE, least(1.0::DOUBLE, w)) AS width, greatest(1e-6::DOUBLE, least(1.0::DOUBLE, h)) AS height FROM b""",
    "containment_parent": _PARENT,
    "table_cell_bbox": f"""WITH {_C}, b AS (SELECT *, width / ncols AS sx, height / nrows AS sy, coalesce(is_spanned, false) AS gone FROM cell)
        SELECT doc_id, page_number, ordinal, cell_idx, CASE WHEN NOT gone THEN x + sx * col_idx END AS cx, CASE WHEN NOT gone THEN y + sy * row_idx END AS cy,
          CASE WHEN NOT gone THEN sx * coalesce(span_width, 1) END AS cw, CASE WHEN NOT gone THEN sy * coalesce(span_height, 1) END AS ch FROM b""",
    "table_absorb_best_cell": f"WITH {_CLAIMS} SELECT doc_id, page_number, ordinal, table_ordinal, table_rank, cell_idx, ratio FROM claims",
    "table_absorb": _TABLE_ABSORB,
    "image_annotation_absorb": _ANNOTATE,
    "noise_filter": f"WITH {_E} SELECT element_uid FROM e WHERE NOT (st = '' AND (element_type IN ('unknown', 'text') OR width * height < 1e-4::DOUBLE))",
    "containment_merge": _MERGE,
    "xy_cut_order": f"WITH RECURSIVE {_XY} SELECT doc_id, page_number, ordinal, read_ord, spatial_group FROM xy",
    "composite_order": f"WITH RECURSIVE {_cuts(_L, 'e WHERE placeholder_idx IS NULL')},{_COMPOSITE.format('e')} SELECT doc_id, page_number, ordinal, read_ord, spatial_group FROM placed",
    "reading_order": f"""WITH RECURSIVE {_READING} SELECT element_uid, read_ord, spatial_group FROM placed UNION ALL
        SELECT element_uid, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY z_order, element_id, ordinal) AS INTEGER), NULL FROM e JOIN choice USING (doc_id, page_number) WHERE as_stored""",
    "column_break": f"""WITH RECURSIVE {_XY}, pair AS (SELECT doc_id, page_number, ordinal, spatial_group AS cur, lag(spatial_group) OVER (PARTITION BY doc_id, page_number ORDER BY read_ord) AS prev FROM xy),
        parted AS (SELECT *, string_split(prev, '.') AS a, string_split(cur, '.') AS b FROM pair)
        SELECT doc_id, page_number, ordinal, coalesce(prev <> cur AND starts_with(b[list_position([coalesce(a[j] = b[j], false) FOR j IN range(1, greatest(len(a), len(b)) + 1)], false)], 'v'), false) AS breaks FROM parted""",
    "document_order": f"WITH {_E} SELECT element_uid, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY z_order, element_id, ordinal) AS read_ord FROM e",
    "order_choice": f"""WITH {_E}, c AS (SELECT doc_id, page_number, count(*) AS n, count(*) FILTER (layout = 'flow') AS f, count(*) FILTER (layout = 'flow' AND y >= 0.99::DOUBLE) AS s FROM e GROUP BY 1, 2)
        SELECT doc_id, page_number, coalesce(layout_mode = 'page_metrics', false) OR coalesce(source_format = 'docx', false) OR coalesce(f >= greatest(3, n // 2) AND s >= 3, false) AS as_stored FROM p LEFT JOIN c USING (doc_id, page_number)""",
    "row_clustering": f"WITH {_ROWS} SELECT doc_id, page_number, ordinal, read_ord FROM rowed",
    "title_of": _TITLES,
    "caption_score": f"WITH {_CAND} SELECT {_KEYS}, proximity, alignment, size_ratio, position, text_hint, bullet_penalty, score, relation_type FROM cand",
    "caption_assignment": f"WITH {_CAND} SELECT {_KEYS}, score, relation_type, rejected_reason, rank FROM judged",
    "caption_verified": f"""WITH {_CAND} SELECT {_KEYS}, CASE WHEN relation_type = 'related_to' AND text_ordinal % 2 = 0 THEN 0.91::DOUBLE ELSE score END AS score,
        CASE WHEN relation_type = 'related_to' AND text_ordinal % 2 = 0 THEN 'caption_of' ELSE relation_type END AS relation_type,
        CASE WHEN relation_type = 'related_to' THEN CASE WHEN text_ordinal % 2 = 0 THEN 'vlm_fallback' ELSE 'vlm_rejected' END ELSE 'rule' END AS method FROM cand""",
    "no_candidate_log": f"""WITH {_CAND}, met AS (SELECT DISTINCT doc_id, page_number, visual_ordinal AS ordinal FROM cand)
        SELECT doc_id, page_number, ordinal FROM e ANTI JOIN met USING (doc_id, page_number, ordinal) WHERE element_type IN ('image', 'table')""",
    "caption_map_last_wins": f"WITH {_CAND} SELECT doc_id, visual_element_id AS target_element_id, arg_max(caption_text, rank) AS caption FROM judged WHERE rejected_reason IS NULL AND relation_type = 'caption_of' GROUP BY 1, 2",
    "section_path": f"""WITH RECURSIVE {_BLOCKS},
        up(element_uid, level, first, doc_id, page_number, cur, path) AS (
          SELECT element_uid, level, parent, doc_id, page_number, parent, '' FROM o WHERE level IS NOT NULL
          UNION ALL SELECT u.element_uid, u.level, u.first, u.doc_id, u.page_number, q.parent, h.label || CASE WHEN u.path = '' THEN '' ELSE ' > ' || u.path END
          FROM up u JOIN hd h ON h.doc_id = u.doc_id AND h.page_number = u.page_number AND h.ordinal = u.cur LEFT JOIN par q ON q.doc_id = h.doc_id AND q.page_number = h.page_number AND q.ordinal = h.ordinal)
        SELECT element_uid, level, first AS parent_ordinal, path FROM up WHERE cur IS NULL""",
    "block_kinds": f"WITH {_BLOCKS} SELECT doc_id, page_number, block_idx, {_BID.format('block_idx')} AS block_id, kind, level, title_text, coalesce(element_ids, '') AS element_ids, CASE WHEN pidx IS NOT NULL THEN {_BID.format('pidx')} END AS parent_block_id FROM blk LEFT JOIN ids USING (doc_id, page_number, block_idx)",
    "bbox_union": f"WITH {_BLOCKS} SELECT doc_id, page_number, block_idx, min(x) AS x, min(y) AS y, greatest(max(x + width) - min(x), 0.0::DOUBLE) AS width, greatest(max(y + height) - min(y), 0.0::DOUBLE) AS height FROM it GROUP BY 1, 2, 3 HAVING min(x) IS NOT NULL",
    "caption_review_sample": f"""WITH {_CAND} SELECT doc_id, page_number, source_element_id, visual_element_id AS target_element_id, score AS confidence, 'correct_caption_link, wrong_link or missing_link' AS labels
        FROM (SELECT *, printf('E_001_%04d', text_ordinal + 1) AS source_element_id FROM judged) WHERE rejected_reason IS NULL AND relation_type = 'caption_of'
        ORDER BY md5('0|' || doc_id || '|' || page_number || '|' || source_element_id || '|' || visual_element_id) LIMIT 50""",
    "title_scores": f"""WITH {_E} SELECT a.doc_id, a.page_number, a.ordinal AS source_ordinal, count(*) AS targets, 0.7::DOUBLE AS score FROM e a JOIN e b ON {_SAME} AND a.ordinal <> b.ordinal
        WHERE a.is_placeholder OR (a.element_type = 'text' AND a.st <> '' AND length(a.st) <= 80 AND NOT contains(a.st, chr(10))) GROUP BY 1, 2, 3""",
    "table_header_rows": f"WITH {_HEAD} SELECT doc_id, page_number, ordinal, max_row, header_rows FROM hdr",
    "pipe_table": f"""WITH {_C}, one AS (SELECT doc_id, page_number, ordinal, row_idx, col_idx, arg_max(text, cell_idx) AS text FROM use GROUP BY ALL),
        dim AS (SELECT doc_id, page_number, ordinal, max(row_idx) AS nr, max(col_idx) AS nc FROM one GROUP BY ALL),
        grid AS (SELECT d.*, r AS row_idx, c AS col_idx FROM (SELECT *, unnest(range(nr + 1)) AS r FROM dim) d, LATERAL (SELECT unnest(range(d.nc + 1)) AS c)),
        line AS (SELECT doc_id, page_number, ordinal, row_idx, any_value(nc) AS nc, '| ' || string_agg(coalesce(text, ''), ' | ' ORDER BY col_idx) || ' |' AS line FROM grid LEFT JOIN one USING (doc_id, page_number, ordinal, row_idx, col_idx) GROUP BY ALL)
        SELECT doc_id, page_number, ordinal, string_agg(line || CASE WHEN row_idx = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(nc + 1), lambda i: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row_idx) AS markdown FROM line GROUP BY ALL""",
    "html_table": f"""WITH {_HEAD}, cc AS (SELECT con.*, CASE WHEN row_idx < header_rows THEN 'th' ELSE 'td' END AS tag FROM con JOIN hdr USING (doc_id, page_number, ordinal)),
        rw AS {_html_rows('tag', 'shown', 'cc')}, grid AS (SELECT doc_id, page_number, ordinal, header_rows, unnest(range(max_row + 1)) AS row_idx FROM hdr),
        ln AS (SELECT grid.*, coalesce(row, '<tr></tr>') AS row FROM grid LEFT JOIN rw USING (doc_id, page_number, ordinal, row_idx)),
        parts AS (SELECT doc_id, page_number, ordinal, any_value(header_rows) AS h, string_agg(row, chr(10) ORDER BY row_idx) FILTER (row_idx < header_rows) AS head, string_agg(row, chr(10) ORDER BY row_idx) FILTER (row_idx >= header_rows) AS body FROM ln GROUP BY 1, 2, 3)
        SELECT doc_id, page_number, ordinal, '<table>' || chr(10) || CASE WHEN h > 0 THEN '<thead>' || chr(10) || head || chr(10) || '</thead>' || chr(10) ELSE '' END || '<tbody>' || chr(10) || coalesce(body || chr(10), '') || '</tbody>' || chr(10) || '</table>' AS html FROM parts""",
    "nested_html": f"""WITH {_C}, rw AS {_html_rows("'td'", 'text', 'use')}, dim AS (SELECT doc_id, page_number, ordinal, unnest(range(max(row_idx) + 1)) AS row_idx FROM use GROUP BY 1, 2, 3)
        SELECT doc_id, page_number, ordinal, '<table>' || chr(10) || string_agg(coalesce(row, '<tr></tr>'), chr(10) ORDER BY row_idx) || chr(10) || '</table>' AS html FROM dim LEFT JOIN rw USING (doc_id, page_number, ordinal, row_idx) GROUP BY 1, 2, 3""",
    "col_width_pct": """WITH w AS (SELECT l_orderkey, list_sort(list(floor(l_quantity))) AS w FROM lineitem GROUP BY 1), t AS (SELECT *, list_sum(w) AS total FROM w WHERE list_sum(w) > 0)
        SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS pos, w[i] / total * 100 AS pct FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)""",
    "md_linebreaks": f"""WITH {_E} SELECT element_uid, {_br('st', "'  ' || chr(10)")} AS markdown, {_br('st', "'<br/>'")} AS html, replace(text, chr(9), ' · ') AS tabs FROM e WHERE text IS NOT NULL""",
    "img_md_to_html": f"""WITH {_E} SELECT element_uid, 'see <img src="' || coalesce(image_ref, 'none.png') || '" alt="' || element_id || '"' || w || '/> and <img src="y.png" alt="x"' || w || '/>' AS html
        FROM (SELECT *, CASE WHEN ordinal % 3 > 0 THEN ' width="' || (ordinal % 3) || '"' ELSE '' END AS w FROM e WHERE element_type = 'image')""",
    "markdown_page": f"""WITH {_MD}, pg AS (SELECT doc_id, page_number, string_agg(body || chr(10), chr(10) ORDER BY ordinal) AS t FROM body WHERE body <> '' GROUP BY 1, 2)
        SELECT doc_id, page_number, trim('<!-- Page ' || page_number || ' -->' || chr(10) || chr(10) || coalesce(t, ''), (SELECT ws FROM white)) AS markdown FROM p LEFT JOIN pg USING (doc_id, page_number)""",
    "rag_split": f"""WITH RECURSIVE {_WHITE}, t AS (SELECT DISTINCT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text <> ''),
        cut(doc_id, t, s, n, e) AS (
          SELECT doc_id, t, 0, 0, 0 FROM t UNION ALL
          SELECT doc_id, t, e, n + 1, CASE WHEN length(t) <= 400 THEN length(t) WHEN e + 400 >= length(t) THEN length(t)
            WHEN contains(t[e + 2:e + 400], chr(10) || chr(10)) THEN e + 400 - (instr(reverse(t[e + 2:e + 400]), chr(10) || chr(10)) - 1) - 2 ELSE e + 400 END
          FROM cut WHERE e < length(t)),
        part AS (SELECT doc_id, n, CASE WHEN length(t) <= 400 THEN t ELSE trim(t[s + 1:e], (SELECT ws FROM white)) END AS part FROM cut WHERE n > 0)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS part_no, part FROM part WHERE part <> ''""",
    "rag_chunks_elements": f"""WITH RECURSIVE {_E}, t AS (SELECT doc_id, page_number, ordinal, element_id, st AS t FROM e WHERE st <> ''),
        cut(doc_id, page_number, ordinal, element_id, t, s, n, e) AS (
          SELECT doc_id, page_number, ordinal, element_id, t, 0, 0, 0 FROM t UNION ALL
          SELECT doc_id, page_number, ordinal, element_id, t, e, n + 1, CASE WHEN e + 1200 >= length(t) THEN length(t)
            WHEN contains(t[e + 2:e + 1200], chr(10) || chr(10)) THEN e + 1200 - (instr(reverse(t[e + 2:e + 1200]), chr(10) || chr(10)) - 1) - 2 ELSE e + 1200 END
          FROM cut WHERE e < length(t)),
        part AS (SELECT *, CASE WHEN length(t) <= 1200 THEN t ELSE trim(t[s + 1:e], (SELECT ws FROM white)) END AS part FROM cut WHERE n > 0),
        num AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, ordinal, n) AS INTEGER) AS chunk_idx FROM part WHERE part <> '')
        SELECT doc_id, chunk_idx, printf('CH_%05d', chunk_idx) AS chunk_id, page_number, part AS text, element_id FROM num""",
    "debug_report_counts": f"""WITH {_BLOCKS}, b AS (SELECT doc_id, count(*) AS num_blocks FROM blk GROUP BY 1), r AS (SELECT CAST(package_id AS VARCHAR) AS doc_id, count(*) AS num_relations FROM (SELECT DISTINCT package_id, rel_idx FROM element_relations) GROUP BY 1),
        n AS (SELECT doc_id, count(*) AS num_pages FROM p GROUP BY 1) SELECT doc_id, num_pages, coalesce(num_blocks, 0) AS num_blocks, coalesce(num_relations, 0) AS num_relations FROM n LEFT JOIN b USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "kendall_tau": f"WITH {_TWO} SELECT doc_id, page_number, tau FROM tau",
    "edit_distance_norm": f"WITH {_TWO} SELECT doc_id, page_number, ned FROM ned",
    "relation_prf": f"WITH {_PRF.format(k='', g='')} SELECT relation_type, tp, fp, fn, precision, recall, {_F1} FROM pp",
    "golden_report": f"""WITH {_TWO}, {_PRF.format(k='doc_id,', g='doc_id')}, m AS (SELECT doc_id, count(*) AS pages, avg(tau) AS avg_tau, avg(ned) AS avg_ned FROM tau JOIN ned USING (doc_id, page_number) GROUP BY 1)
        SELECT m.doc_id, pages, avg_tau, avg_ned, precision, recall, f1 FROM m LEFT JOIN (SELECT doc_id, precision, recall, {_F1} FROM pp WHERE relation_type = '_overall') USING (doc_id)""",
    "caption_baseline": f"""WITH {_CAND}, el AS (SELECT doc_id, count(DISTINCT page_number) AS pages, count(*) FILTER (element_type = 'image') AS images FROM e GROUP BY 1),
        ca AS (SELECT doc_id, count(*) FILTER (rejected_reason IS NULL AND relation_type = 'caption_of') AS captions, count(*) AS n, count(rejected_reason) AS r FROM judged GROUP BY 1),
        no AS (SELECT doc_id, count(*) AS m FROM e WHERE element_type IN ('image', 'table') AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.doc_id = e.doc_id AND c.page_number = e.page_number AND c.visual_ordinal = e.ordinal) GROUP BY 1),
        al AS (SELECT doc_id, pages, images, coalesce(captions, 0) AS captions, coalesce(n, 0) + coalesce(m, 0) AS decisions, coalesce(r, 0) + coalesce(m, 0) AS rejected FROM el LEFT JOIN ca USING (doc_id) LEFT JOIN no USING (doc_id)),
        su AS (SELECT doc_id, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(images) AS BIGINT) AS images, CAST(sum(captions) AS BIGINT) AS captions, CAST(sum(decisions) AS BIGINT) AS decisions, CAST(sum(rejected) AS BIGINT) AS rejected FROM al GROUP BY ROLLUP (doc_id))
        SELECT *, captions / greatest(images, 1) AS caption_density_per_image, rejected / greatest(decisions, 1) AS rejection_rate FROM su""",
    "autonum_format": f"SELECT p_partkey, {_prefix('p_partkey % 9', 'n')} AS prefix FROM (SELECT p_partkey, p_partkey % 60 + 1 AS n FROM part)",
    "roman_numeral": f"SELECT p_partkey, {_roman('n')} AS numeral FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)",
    "dominant_style": f"WITH {_RUNS} SELECT shape, {_DOMINANT} FROM runs GROUP BY shape",
    "merge_runs": f"WITH {_RUNS} {_merge('runs')}",
    "wrap_runs": f"""WITH {_RUNS}, d AS (SELECT shape, {_DOMINANT} FROM runs GROUP BY shape),
        s AS (SELECT shape, par, run_idx, text, bold AND NOT dominant_bold AS bold, italic AND NOT dominant_italic AS italic, underline AND NOT dominant_underline AS underline FROM runs JOIN d USING (shape)),
        m AS ({_merge('s')}), w AS (SELECT *, CASE WHEN underline THEN '<u>' || text || '</u>' ELSE text END AS a FROM m), x AS (SELECT *, CASE WHEN italic THEN '*' || a || '*' ELSE a END AS b FROM w),
        l AS (SELECT shape, par, trim(string_agg(CASE WHEN bold THEN '**' || b || '**' ELSE b END, '' ORDER BY run_idx)) AS line FROM x GROUP BY 1, 2)
        SELECT shape, string_agg(line, chr(10) ORDER BY par) AS formatted FROM l WHERE line <> '' GROUP BY 1""",
}
ORACLES["pptx_runs_roundtrip"] = ORACLES["wrap_runs"]  # what is read back is what the operator on frames gives
