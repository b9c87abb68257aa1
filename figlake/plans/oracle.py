"""DuckDB SQL for the queries of the catalogue, written from the operators' definitions."""

from __future__ import annotations

_ANCHOR = r"^\s*(?:fig(?:ure)?\.?)\s*(\d{1,3}(?:\.\d{1,2})?[a-z]?)\s*([:.\-–—|])\s*\S"
_NUMBER = r"\bfig(?:ure)?\.?\s*(\d{1,3}(?:\.\d{1,2})?[a-z]?)"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


_TOP = "((line_no % 8) // 2) * 180 + (line_no % 2) * 16 + ((line_no * 5) % 3) * 4"
_X0 = "CASE WHEN doc_id % 4 = 2 AND line_no % 2 = 1 THEN 340e0 ELSE 72e0 END"
#: Named parts in the order in which they build on each other.
_PARTS = {
    "lines": f"""SELECT doc_id, line_no // 8 + 1 AS page_number, line_no,
        CASE WHEN (doc_id * 7 + line_no) % 11 = 3 THEN 'Figure ' || (line_no % 9 + 1) ||
          CASE (doc_id + line_no) % 4 WHEN 0 THEN ': ' WHEN 1 THEN '. ' WHEN 2 THEN ' - ' ELSE ' shows ' END || t ELSE t END AS text,
        {_X0} AS x0, 40e0 + {_TOP} AS top, {_X0} + least(length(t) + 8, CASE WHEN doc_id % 4 = 2 THEN 40 ELSE 80 END) * 5.5e0 AS x1, 50e0 + {_TOP} AS bottom
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)""",
    "graphics": """SELECT l_orderkey % (SELECT count(*) FROM documents) AS doc_id, (l_linenumber - 1) % 3 + 1 AS page_number,
        CASE l_suppkey % 4 WHEN 0 THEN 'image' ELSE 'vector' END AS kind,
        CASE WHEN l_suppkey % 20 = 7 THEN 6e0 ELSE 72e0 + l_partkey % 300 END AS x0,
        40e0 + (l_orderkey * 37) % 700 AS top,
        CASE l_suppkey % 20 WHEN 7 THEN 606e0 WHEN 9 THEN 72e0 + l_partkey % 300 ELSE 72e0 + l_partkey % 300 + l_quantity * 7 END AS x1,
        40e0 + (l_orderkey * 37) % 700 + CASE WHEN l_suppkey % 20 = 7 THEN 1e0 ELSE l_quantity * 3 END AS bottom FROM lineitem""",
    "raw": """SELECT l_orderkey % (SELECT count(*) FROM documents) AS doc_id, (l_linenumber - 1) % 3 + 1 AS page_number,
        row_number() OVER (PARTITION BY l_orderkey % (SELECT count(*) FROM documents), (l_linenumber - 1) % 3
          ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS region_no,
        CASE l_partkey % 3 WHEN 0 THEN 'Figure' WHEN 1 THEN ' Figure Caption ' ELSE 'Plain Text' END AS raw_label,
        (l_partkey % 320) * 4e0 - 20.3e0 AS x0, (l_partkey % 320) * 4e0 - 20.3e0 + l_quantity * 14 AS x1,
        ((l_orderkey * 37) % 700) * 2 + 80.25e0 AS y0, ((l_orderkey * 37) % 700) * 2 + 80.25e0 + l_quantity * 6 AS y1,
        l_discount * 10 AS confidence,
        CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'no number here' ELSE 'FIG. ' || (l_suppkey % 12 + 1) || '. region caption' END AS caption_text FROM lineitem""",
    "marked": rf"""SELECT *, regexp_matches({_strip("text")}, '{_ANCHOR}', 'i') AS anchor, lag(bottom) OVER w AS last_bottom, lag(top) OVER w AS last_top
      FROM lines WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)""",
    "runs": """SELECT *, sum(CASE WHEN anchor OR last_bottom IS NULL OR top - last_bottom > 0.8e0 * greatest(last_bottom - last_top, 6e0) THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS run FROM marked""",
    "captions": rf"""SELECT doc_id, page_number, min(line_no) AS caption_no, regexp_extract({_strip("arg_min(text, line_no)")}, '{_ANCHOR}', 1, 'i') AS number,
        {_strip(f"string_agg({_strip('text')}, ' ' ORDER BY line_no)")} AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom
      FROM runs GROUP BY doc_id, page_number, run HAVING arg_min(anchor, line_no)""",
    "columns_": "SELECT *, greatest(0e0, x0 - 15e0) AS cx0, least(612e0, x1 + 15e0) AS cx1 FROM captions",
    "edges": """SELECT c.doc_id, c.page_number, c.caption_no,
        max(CASE WHEN l.bottom <= c.top - 1e0 THEN l.bottom END) AS above, min(CASE WHEN l.top >= c.bottom + 1e0 THEN l.top END) AS below
      FROM columns_ c LEFT JOIN lines l ON l.doc_id = c.doc_id AND l.page_number = c.page_number
        AND l.x1 - l.x0 >= 0.5e0 * greatest(c.x1 - c.x0, 1e0) AND least(l.x1, c.cx1) - greatest(l.x0, c.cx0) > 0 GROUP BY ALL""",
    "bands": """SELECT * FROM (
        SELECT c.doc_id, c.page_number, c.caption_no, 'above' AS direction, cx0 AS x0, greatest(0e0, coalesce(above, 0e0)) AS top, cx1 AS x1, c.top - 1e0 AS bottom
          FROM columns_ c JOIN edges e USING (doc_id, page_number, caption_no)
        UNION ALL SELECT c.doc_id, c.page_number, c.caption_no, 'below', cx0, c.bottom + 1e0, cx1, least(792e0, coalesce(below, 792e0))
          FROM columns_ c JOIN edges e USING (doc_id, page_number, caption_no)) WHERE bottom - top >= 25e0""",
    "held": """SELECT b.doc_id, b.page_number, b.caption_no, b.direction, b.top AS btop, b.bottom AS bbottom, g.kind, g.x0, g.top, g.x1, g.bottom
      FROM bands b JOIN graphics g ON g.doc_id = b.doc_id AND g.page_number = b.page_number
        AND (g.top + g.bottom) / 2e0 BETWEEN b.top AND b.bottom AND least(g.x1, b.x1) - greatest(g.x0, b.x0) > 0
        AND NOT (g.kind = 'vector' AND g.x1 - g.x0 > 0.9e0 * 612e0 AND g.bottom - g.top < 3e0)""",
    "detected": """SELECT doc_id, page_number, caption_no, direction, CASE WHEN bool_or(kind = 'image') THEN 'embedded-image' ELSE 'vector-cluster' END AS method,
        greatest(min(x0), 0e0) AS x0, greatest(min(top), any_value(btop)) AS top, least(max(x1), 612e0) AS x1, least(max(bottom), any_value(bbottom)) AS bottom
      FROM held GROUP BY doc_id, page_number, caption_no, direction HAVING max(x1) - min(x0) >= 60e0 AND max(bottom) - min(top) >= 40e0""",
    "windows": """SELECT doc_id, page_number, caption_no, cx0, cx1, greatest(0e0, top - 320e0) AS t1, greatest(greatest(0e0, top - 320e0) + 1e0, top - 2e0) AS b1,
        least(bottom + 2e0, least(792e0, bottom + 320e0) - 1e0) AS t2, least(792e0, bottom + 320e0) AS b2 FROM columns_""",
    "located": """SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, caption_no ORDER BY CASE direction WHEN 'above' THEN 1 WHEN 'below' THEN 2 ELSE 3 END) AS turn FROM (
        SELECT * FROM detected UNION ALL SELECT doc_id, page_number, caption_no, 'fallback', 'caption-fallback', cx0,
          CASE WHEN b1 - t1 < 40e0 THEN t2 ELSE t1 END, cx1, CASE WHEN b1 - t1 < 40e0 THEN b2 ELSE b1 END FROM windows)) WHERE turn = 1""",
    "heuristic": """SELECT l.*, 'figure-' || lower(c.number) AS figure_id, 'Figure ' || c.number AS label, c.number, c.text AS caption,
        greatest(l.x0 - 6e0, 0e0) AS kx0, greatest(l.top - 6e0, 0e0) AS ktop, least(l.x1 + 6e0, 612e0) AS kx1, least(l.bottom + 6e0, 792e0) AS kbottom
      FROM located l JOIN captions c USING (doc_id, page_number, caption_no)""",
    "first_wins": """SELECT * FROM heuristic WHERE kx1 - kx0 >= 4 AND kbottom - ktop >= 4
      QUALIFY row_number() OVER (PARTITION BY doc_id, figure_id ORDER BY page_number, caption_no) = 1""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, caption_no) AS seq FROM first_wins""",
    "figures": """SELECT *, printf('figure_%03d', seq) AS stem, CASE WHEN longest * 300 / 72e0 > 4000 THEN greatest(72, CAST(floor(288000e0 / longest) AS BIGINT)) ELSE 300 END AS dpi
      FROM (SELECT *, greatest(kx1 - kx0, kbottom - ktop) AS longest FROM numbered)""",
    "regions": """SELECT * FROM (SELECT doc_id, page_number, region_no, regexp_replace(lower(trim(raw_label)), ' ', '_', 'g') AS label, confidence, caption_text,
        least(greatest(0, CAST(trunc(x0) AS BIGINT)), 1224) AS x0, least(greatest(0, CAST(trunc(y0) AS BIGINT)), 1584) AS y0,
        least(greatest(0, CAST(trunc(x1) AS BIGINT)), 1224) AS x1, least(greatest(0, CAST(trunc(y1) AS BIGINT)), 1584) AS y1 FROM raw) WHERE x1 > x0 AND y1 > y0""",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, region_no) AS index FROM regions WHERE label = 'figure' AND confidence >= 0.3e0""",
    "nearest": """SELECT * EXCLUDE (turn) FROM (SELECT f.*, c.region_no AS caption_region, c.caption_text AS found_text,
          CASE WHEN c.region_no IS NULL THEN NULL WHEN c.y0 >= f.y1 THEN c.y0 - f.y1 WHEN c.y1 <= f.y0 THEN f.y0 - c.y1 + 40 ELSE 0 END AS gap,
          row_number() OVER (PARTITION BY f.doc_id, f.page_number, f.region_no ORDER BY
            CASE WHEN c.y0 >= f.y1 THEN c.y0 - f.y1 WHEN c.y1 <= f.y0 THEN f.y0 - c.y1 + 40 ELSE 0 END, c.region_no) AS turn
        FROM ordered f LEFT JOIN regions c ON c.doc_id = f.doc_id AND c.page_number = f.page_number AND c.label = 'figure_caption' AND least(f.x1, c.x1) - greatest(f.x0, c.x0) > 0) WHERE turn = 1""",
    "named": rf"""SELECT *, coalesce(nullif(regexp_extract(coalesce(found_text, ''), '{_NUMBER}', 1, 'i'), ''), 'p' || page_number || '-' || index) AS number FROM nearest""",
    "points": """SELECT *, least(greatest(0e0 + x0 * 0.5e0, 0e0), 612e0) AS px0, least(greatest(0e0 + y0 * 0.5e0, 0e0), 792e0) AS ptop,
        least(0e0 + x1 * 0.5e0, 612e0) AS px1, least(0e0 + y1 * 0.5e0, 792e0) AS pbottom FROM named""",
    "candidates": """SELECT doc_id, page_number, path, figure_id, cand_no FROM (
        SELECT doc_id, page_number, 'layout' AS path, 'figure-' || lower(number) AS figure_id, index AS cand_no FROM points
          WHERE least(px1 + 6e0, 612e0) - greatest(px0 - 6e0, 0e0) >= 4 AND least(pbottom + 6e0, 792e0) - greatest(ptop - 6e0, 0e0) >= 4
        UNION ALL SELECT doc_id, page_number, 'heuristic', figure_id, caption_no FROM heuristic WHERE kx1 - kx0 >= 4 AND kbottom - ktop >= 4)
      QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, path, figure_id ORDER BY cand_no) = 1""",
    "turns": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS turn FROM (SELECT doc_id, page_number,
        coalesce(list({'figure_id': figure_id, 'cand_no': cand_no} ORDER BY cand_no) FILTER (path = 'layout'), []) AS layout,
        coalesce(list({'figure_id': figure_id, 'cand_no': cand_no} ORDER BY cand_no) FILTER (path = 'heuristic'), []) AS heuristic_ FROM candidates GROUP BY doc_id, page_number)""",
    "page_texts": "SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, page_number",
}


def _with(query: str) -> str:
    """The query with the parts that it needs, directly or not, before it."""
    import re

    names, need, todo = "|".join(_PARTS), set(), [query]
    while todo:
        for name in re.findall(rf"(?:FROM|JOIN) ({names})\b", todo.pop()):
            if name not in need:
                need.add(name)
                todo.append(_PARTS[name])
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in _PARTS.items() if name in need)
    if "WITH RECURSIVE" in query:
        return query.replace("WITH RECURSIVE", f"WITH RECURSIVE {parts},") if parts else query
    return f"WITH {parts}\n{query}" if parts else query


_BOX = "x0, top, x1, bottom"
_KEY = "doc_id, page_number"
ORACLE_SQL = {
    name: _with(sql)
    for name, sql in {
        "geometry_box_metrics": f"SELECT {_KEY}, {_BOX}, x1 - x0 AS width, bottom - top AS height, greatest(x1 - x0, 0e0) * greatest(bottom - top, 0e0) AS area, (top + bottom) / 2e0 AS center FROM graphics",
        "geometry_pad_clamp": f"SELECT {_KEY}, {_BOX}, greatest(x0 - 100e0, 0e0) AS c_x0, greatest(top - 100e0, 0e0) AS c_top, least(x1 + 100e0, 612e0) AS c_x1, least(bottom + 100e0, 792e0) AS c_bottom FROM graphics",
        "geometry_horizontal_overlap": "SELECT c.doc_id, c.page_number, caption_no, g.x0 AS g_x0, g.x1 AS g_x1, greatest(0e0, least(c.x1, g.x1) - greatest(c.x0, g.x0)) AS overlap FROM captions c JOIN graphics g ON g.doc_id = c.doc_id AND g.page_number = c.page_number",
        "caption_anchor_lines": rf"SELECT {_KEY}, line_no, regexp_extract({_strip('text')}, '{_ANCHOR}', 1, 'i') AS number, regexp_extract({_strip('text')}, '{_ANCHOR}', 2, 'i') AS separator FROM marked WHERE anchor",
        "caption_number_search": rf"SELECT {_KEY}, line_no, number, 'figure-' || lower(number) AS figure_id FROM (SELECT *, regexp_extract(text, '{_NUMBER}', 1, 'i') AS number FROM lines) WHERE number <> ''",
        "caption_paragraphs": f"SELECT {_KEY}, caption_no, number, 'Figure ' || number AS label, text, {_BOX} FROM captions",
        "caption_columns": f"SELECT {_KEY}, caption_no, cx0 AS x0, 0e0 AS top, cx1 AS x1, 792e0 AS bottom FROM columns_",
        "content_band_above": f"SELECT {_KEY}, caption_no, {_BOX} FROM bands WHERE direction = 'above'",
        "content_band_below": f"SELECT {_KEY}, caption_no, {_BOX} FROM bands WHERE direction = 'below'",
        "graphics_in_band": f"SELECT {_KEY}, caption_no, kind, {_BOX} FROM held WHERE direction = 'above'",
        "figure_region_detected": f"SELECT {_KEY}, caption_no, method, {_BOX} FROM detected WHERE direction = 'above'",
        "figure_region_located": f"SELECT {_KEY}, caption_no, method, direction, {_BOX} FROM located",
        "detection_method_counts": "SELECT method, direction, count(*) AS n, count(DISTINCT doc_id) AS docs FROM located GROUP BY method, direction",
        "figures_first_wins": f"SELECT {_KEY}, caption_no AS cand_no, figure_id, label, method, {_BOX} FROM first_wins",
        "figures_document_order": f"SELECT {_KEY}, seq, stem, figure_id FROM figures",
        "effective_dpi": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN longest * 300 / 72e0 > 4000 THEN greatest(72, CAST(floor(288000e0 / longest) AS BIGINT)) ELSE 300 END AS dpi FROM (SELECT *, CAST(l_extendedprice AS DOUBLE) / 20e0 AS longest FROM lineitem)",
        "crop_boxes_renderable": f"SELECT *, x1 - x0 >= 4 AND bottom - top >= 4 AS renderable FROM (SELECT {_KEY}, kind, greatest(x0 - 6e0, 0e0) AS x0, greatest(top - 6e0, 0e0) AS top, least(x1 + 6e0, 612e0) AS x1, least(bottom + 6e0, 792e0) AS bottom FROM graphics)",
        "regions_normalized": f"SELECT {_KEY}, region_no, label, x0, y0, x1, y1 FROM regions",
        "figure_regions_confident": f"SELECT {_KEY}, region_no, confidence FROM ordered",
        "regions_reading_order": f"SELECT {_KEY}, region_no, index FROM ordered",
        "region_points": f"SELECT {_KEY}, region_no, px0 AS x0, ptop AS top, px1 AS x1, pbottom AS bottom FROM points",
        "nearest_caption": f"SELECT {_KEY}, region_no, coalesce(caption_region, -1) AS caption_region, coalesce(gap, -1) AS gap, found_text AS caption_text FROM nearest",
        "synthesized_numbers": f"SELECT {_KEY}, region_no, number, 'figure-' || lower(number) AS figure_id, 'Figure ' || number AS label, coalesce(nullif(found_text, ''), '(Figure ' || number || ' — no caption text detected)') AS caption FROM named",
        "resolve_document": """WITH RECURSIVE fold AS (
          SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS page_number, CAST(NULL AS VARCHAR) AS path, CAST([] AS STRUCT(figure_id VARCHAR, cand_no BIGINT)[]) AS picked FROM turns
          UNION ALL
          SELECT doc_id, turn, list_concat(seen, list_transform(picked, lambda x: x.figure_id)), page_number, path, picked FROM (
            SELECT doc_id, turn, seen, page_number, CASE WHEN len(new_layout) > 0 THEN 'layout' ELSE 'heuristic' END AS path, CASE WHEN len(new_layout) > 0 THEN new_layout ELSE new_heuristic END AS picked FROM (
              SELECT f.doc_id, t.turn, f.seen, t.page_number, list_filter(t.layout, lambda x: NOT list_contains(f.seen, x.figure_id)) AS new_layout, list_filter(t.heuristic_, lambda x: NOT list_contains(f.seen, x.figure_id)) AS new_heuristic
              FROM fold f JOIN turns t ON t.doc_id = f.doc_id AND t.turn = f.turn + 1)))
        SELECT doc_id, page_number, path, x.figure_id AS figure_id, x.cand_no AS cand_no FROM (SELECT doc_id, page_number, path, unnest(picked) AS x FROM fold)""",
        "caption_spacing_repair": f"""SELECT {_KEY}, line_no, coalesce(best, plain) AS repaired FROM (SELECT *, CASE WHEN length(plain) <= 40 THEN NULL ELSE
            (SELECT arg_min(v, rank) FROM (SELECT v, (CASE WHEN n <= 0.25e0 * greatest(length(v), 1) THEN 0 ELSE 1 END) * 1e12 - n * 10 + k AS rank FROM (SELECT v, k, length(v) - length(replace(v, ' ', '')) AS n FROM (SELECT unnest(vs) AS v, unnest(range(4)) AS k) WHERE v <> ''))) END AS best
          FROM (SELECT *, replace(text, ' ', '') AS plain, [replace(text, ' ', ''), replace(text, 'e', 'e '), text, regexp_replace(text, '(.)', '\\1 ', 'g')] AS vs FROM lines))""",
        "whitespace_collapse": rf"SELECT doc_id, trim(regexp_replace(text, '{_WHITE}', ' ', 'g')) AS collapsed FROM documents",
        "safe_paper_name": r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(url, '([^/]+?)(\.[^./]+)?$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'paper') AS name,
          coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'paper') AS whole FROM pages""",
        "document_full_text": "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS full_text, count(*) AS pages FROM page_texts GROUP BY doc_id",
        "page_text_lookup": f"SELECT {_KEY}, text FROM page_texts WHERE page_number = 2",
        "upload_consecutive_dedup": "SELECT source, doc_id, digest FROM (SELECT source, doc_id, sha256(text) AS digest, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE before IS NULL OR before <> digest",
        "figure_metadata_json": f"""SELECT {_KEY}, figure_id, label, number, caption, method AS detection_method, dpi, {_BOX},
          greatest(1, CAST(floor((kx1 - kx0) * dpi / 72e0 + 0.5e0) AS BIGINT)) AS width, greatest(1, CAST(floor((kbottom - ktop) * dpi / 72e0 + 0.5e0) AS BIGINT)) AS height, stem || '.png' AS image, stem || '.txt' AS caption_file FROM figures""",
        "index_manifest": "SELECT doc_id, count(*) AS n, string_agg(stem, ',' ORDER BY seq) AS stems FROM figures GROUP BY doc_id",
    }.items()
}

#: What the sample files were drawn to give: the caption's figure is the frame, six points are added on each side for the crop.
_SAMPLES = """SELECT 'supplier ' || s_suppkey AS paper, CAST(1 AS BIGINT) AS page_number, 'figure-' || s_suppkey AS figure_id, 'Figure ' || s_suppkey AS label, CAST(s_suppkey AS VARCHAR) AS number,
    'Figure ' || s_suppkey || ': measured for supplier ' || s_suppkey || '.' AS caption, 'vector-cluster' AS method,
    CAST(x AS DOUBLE) AS x0, CAST(792 - y - high AS DOUBLE) AS top, CAST(x + wide AS DOUBLE) AS x1, CAST(792 - y AS DOUBLE) AS bottom,
    CAST(300 AS BIGINT) AS dpi, CAST(floor((wide + 12) * 300 / 72e0 + 0.5e0) AS BIGINT) AS width, CAST(floor((high + 12) * 300 / 72e0 + 0.5e0) AS BIGINT) AS height
  FROM (SELECT s_suppkey, 90 + s_suppkey % 40 AS x, 320 + s_suppkey % 30 AS y, 180 + s_suppkey % 200 AS wide, 120 + s_suppkey % 90 AS high FROM supplier)"""
ORACLE_SQL |= dict.fromkeys(("pdf_fixture_figures", "export_roundtrip", "pdf_stream_ingest"), _SAMPLES)
