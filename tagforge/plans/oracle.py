"""DuckDB SQL with the rows of each query."""

from __future__ import annotations

from tagforge.functions.text import CODE_KEYS
from tagforge.operators.records import LABELS, PRICES, SHOWN

_BOXES = """b AS (SELECT user_id AS track_id, event_id // 50 AS frame_idx, event_id AS box_idx, (event_id % 100) / 100.0::DOUBLE AS conf, value AS sharpness FROM events),
s AS (SELECT *, sharpness + 100 * conf AS score FROM b WHERE conf >= 0.3 AND track_id IS NOT NULL),
best AS (
  SELECT track_id, frame_idx, box_idx, conf, score, first_value(frame_idx) OVER f AS first_frame, first_value(box_idx) OVER f AS first_box,
    row_number() OVER (PARTITION BY track_id ORDER BY score DESC NULLS LAST, frame_idx, box_idx) AS place
  FROM s WINDOW f AS (PARTITION BY track_id ORDER BY frame_idx, box_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""

_END = r"(?:[^\pL\pN\pM_]|$)"
_DECIMAL = r"(\d{1,6})[.,\s\x{00a0}](\d{2})" + _END
_WHOLE = r"(?:^|[^\pL\pN\pM_])(\d{2,6})" + _END


def _price(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '{_DECIMAL}') THEN regexp_extract({x}, '{_DECIMAL}', 1) || '.' || regexp_extract({x}, '{_DECIMAL}', 2)
      WHEN regexp_matches({x}, '{_WHOLE}') THEN regexp_extract({x}, '{_WHOLE}', 1) || '.00' ELSE '' END"""


_PAYLOAD = """' Barcode =' || o_orderkey || ';p1=' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ';PRICE1 = ' || o_orderkey ELSE '' END || ';junk;ap=a=b; ac = ' || o_orderstatus || ' ;unknown=1;p2='"""
_PAIRS = "list_transform(list_filter(string_split(payload, ';'), lambda x: contains(x, '=')), lambda x: {'k': lower(trim(split_part(x, '=', 1))), 'v': trim(substr(x, instr(x, '=') + 1))})"
_CODES = ", ".join(f"coalesce(list_filter(kv, lambda e: e.k IN ({', '.join(repr(k) for k in keys)}))[-1].v, '') AS {name}" for name, keys in CODE_KEYS.items())
_N = "(trunc(l_discount * 1000 + l_quantity)::BIGINT % 150)::VARCHAR"
_TEXT = "coalesce(text, '')"
_CX, _CY = "(turn * 37 + conv_id * 11) % 200", f"(turn * 53 + length({_TEXT})) % 100"
_GRID = "list_transform(embedding, lambda x: floor(x::DOUBLE * 128)) AS g"
_SQ = "list_sum(list_transform({0}, lambda x: x * x)) / len({0}) - list_avg({0}) * list_avg({0})"


def _zone(top: bool, left: bool) -> str:
    return f"coalesce(string_agg({_TEXT}, ' ' ORDER BY turn) FILTER (WHERE {_CY} {'<' if top else '>='} 55 AND {_CX} {'<' if left else '>='} 100), '')"


def _turn(k: int) -> str:
    row, high = [("y", 6), ("x", 5), ("5 - y", 6), ("4 - x", 5)][k]
    return f"avg(c) FILTER (WHERE {row} >= {high // 2}) - avg(c) FILTER (WHERE {row} < {high // 2}) AS s{k}"


_KOPECKS = "regexp_replace({0}, '\\.00$', '.99')"
_RECORD = f"""
base AS (
  SELECT *, {_PAYLOAD} AS payload, CASE o_orderkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'unknown' END AS color, o_custkey % 130 AS cut,
    (o_orderkey % 900 + 100) || '.99' AS p0, (o_custkey % 700 + 100) || '.49' AS p1 FROM orders),
coded AS (SELECT *, {_PAIRS} AS kv FROM base),
parsed AS (SELECT *, {_CODES} FROM coded),
rec AS (
  SELECT 'video_' || o_orderkey % 10 || '.mp4' AS filename, 'Item ' || o_orderpriority AS product_name,
    CASE WHEN color = 'red' AND p0::DOUBLE < p1::DOUBLE THEN '' ELSE replace(p0, '.', ',') END AS price_default, '' AS price_card,
    CASE WHEN color = 'red' THEN replace(p1, '.', ',') ELSE '' END AS price_discount, payload AS barcode,
    CASE WHEN color = 'red' AND cut <= 100 THEN '-' || cut || '%' ELSE '' END AS discount_amount, '' AS id_sku, '' AS print_datetime, '' AS code, '' AS additional_info,
    color, '' AS special_symbols, o_orderkey * 40 AS frame_timestamp, (o_orderkey % 50)::INT AS x_min, (o_orderkey % 40)::INT AS y_min, (o_orderkey % 50 + 200)::INT AS x_max, (o_orderkey % 40 + 100)::INT AS y_max,
    'img/' || o_orderkey AS warped_image, ' Item ' || o_orderpriority || ' ' || (o_orderkey % 900 + 100) || ' -' || cut || ' ' || (o_custkey % 700 + 100) || ' 49' AS raw_text,
    {", ".join(f"replace({c}, '.', ',') AS {c}" if c in PRICES else c for c in CODE_KEYS)}
  FROM parsed)"""
_FIELDS = f"""
base AS (
  SELECT o_orderkey, o_orderkey AS k, o_custkey AS c, ' Item ' || o_orderpriority AS t1, 15 + o_orderkey % 3 * 12 AS y2,
    CASE WHEN o_orderkey % 5 = 0 THEN 'no price' ELSE (o_orderkey % 900 + 100)::VARCHAR END AS t2, (o_custkey % 800 + 100) || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') AS t3,
    CASE WHEN o_orderkey % 7 = 0 THEN 'abc' ELSE '-' || o_custkey % 130 || CASE WHEN o_orderkey % 2 = 0 THEN '%' ELSE '' END END AS t4,
    CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE (o_custkey % 700 + 100) || ' 49' END AS t5, CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE (o_custkey % 600 + 100) || ',00' END AS t6,
    8 + o_orderkey % 4 * 4 AS h5, 12 AS h6, CASE WHEN o_orderkey % 4 = 0 THEN 10 + o_orderkey % 3 * 20 END AS bottom, CASE o_orderkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'unknown' END AS color
  FROM orders),
priced AS (SELECT *, {_price("t2")} AS p2, {_price("t3")} AS p3, {_price("t5")} AS p5, {_price("t6")} AS p6, {_price("(t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 || ' ' || t5 || ' ' || t6)")} AS whole,
    coalesce(CASE WHEN contains(t4, '%') THEN nullif(regexp_extract(t4, '(-?\\d+)\\s*%', 1), '') END, nullif(regexp_extract(t4, '(-?\\d+)', 1), '')) AS n FROM base),
-- right-top lines below the code, or all of them if there are none
offered AS (SELECT *, CASE WHEN bottom IS NULL OR (y2 <= bottom AND 45 <= bottom) THEN [p2, p3] WHEN y2 > bottom AND 45 > bottom THEN [p2, p3] WHEN 45 > bottom THEN [p3] ELSE [p2] END AS near FROM priced),
chosen AS (
  SELECT *, coalesce(list_filter(near, lambda p: p <> '')[1], CASE WHEN color <> 'red' THEN whole END, '') AS d0,
    CASE WHEN color = 'red' AND abs(n::BIGINT) > 100 THEN '-' || ltrim(n, '-') ELSE '' END AS moved, CASE WHEN color = 'red' AND abs(n::BIGINT) <= 100 THEN '-' || ltrim(n, '-') || '%' ELSE '' END AS amount,
    CASE WHEN p5 <> '' AND (p6 = '' OR h5 >= h6) THEN p5 ELSE p6 END AS tall FROM offered),
ended AS (SELECT *, {_KOPECKS.format("d0")} AS d1, CASE WHEN color = 'red' THEN {_KOPECKS.format("coalesce(nullif(tall, ''), moved)")} ELSE '' END AS r1 FROM chosen)"""


def _level(c: int, y: str, x: str) -> str:
    """Channel c of pixel (y, x) of the picture of frame n; 0 outside of it."""
    red = f"200 + ({x} + {y}) % 50" if c == 2 else f"({x} * {y} + n) % 40"
    yellow = (f"20 + {y} % 9", f"190 + ({x} + n) % 9", "225")[c]
    plain = (f"n * 7 + {y} * 13 + {x} * 29", f"n * 3 + {y} * {y} + {x}", f"n + {x} * {x} * 5 + {y} * 3")[c]
    return f"""(CASE WHEN {x} < 0 OR {y} < 0 OR {x} > 31 OR {y} > 23 THEN 0
      WHEN n % 3 = 0 AND {y} >= 12 THEN {red} WHEN n % 3 = 1 AND {x} < 16 THEN {yellow} ELSE ({plain}) % 256 END)::DOUBLE"""


def _crop(tags: str) -> str:
    """CTEs from tags (id, n: the frame's number, x1, y1, x2, y2) to crop (id, h, w, y, x, b, g, r) and look (id, color, quarters)."""
    between = lambda c: f"floor(({_level(c, 'y0', 'x0')} * (1 - fx) + {_level(c, 'y0', '(x0 + 1)')} * fx) * (1 - fy) + ({_level(c, '(y0 + 1)', 'x0')} * (1 - fx) + {_level(c, '(y0 + 1)', '(x0 + 1)')} * fx) * fy + 0.5)::INT"
    half = lambda row, high: f"avg(colored) FILTER (WHERE {row} >= {high} // 2) - avg(colored) FILTER (WHERE {row} < {high} // 2)"
    return f"""
tag AS (SELECT *, trunc(x2 - x1)::INT AS w, trunc(y2 - y1)::INT AS h FROM ({tags})),
pixel AS (SELECT *, x1 + x * ((x2 - x1) / (w - 1)) AS sx, y1 + y * ((y2 - y1) / (h - 1)) AS sy FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM tag WHERE w >= 10 AND h >= 10))),
place AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM pixel),
crop AS (SELECT id, h, w, y, x, {between(0)} AS b, {between(1)} AS g, {between(2)} AS r FROM place),
vivid AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM crop),
angle AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(255 * d::DOUBLE / v + 0.5) END AS s,
  CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN 30 * (g - b) / d::DOUBLE WHEN v = g THEN 60 + 30 * (b - r) / d::DOUBLE ELSE 120 + 30 * (r - g) / d::DOUBLE END AS t FROM vivid),
hue AS (SELECT *, floor(CASE WHEN t < 0 THEN t + 180 ELSE t END + 0.5)::INT % 180 AS hh FROM angle),
mask AS (SELECT *, CASE WHEN (hh <= 10 OR hh >= 160) AND s >= 70 AND v >= 50 THEN 1 ELSE 0 END AS red, CASE WHEN hh BETWEEN 20 AND 35 AND s >= 70 AND v >= 50 THEN 1 ELSE 0 END AS yellow FROM hue),
masked AS (SELECT *, red + yellow AS colored FROM mask),
turns AS (SELECT id, CASE WHEN avg(red) > 0.05 THEN 'red' WHEN avg(yellow) > 0.05 THEN 'yellow' ELSE 'unknown' END AS color,
  [{half('y', 'h')}, {half('x', 'w')}, {half('h - 1 - y', 'h')}, {half('w - 1 - x', 'w')}] AS scores FROM masked GROUP BY id),
look AS (SELECT id, color, (list_position(list_transform(scores, lambda z: round(z, 12)), round(list_max(scores), 12)) - 1)::INT AS quarters FROM turns)"""


_TAG_K = "2 + k % 8 / 4.0::DOUBLE AS x1, 1 + k % 12 / 4.0::DOUBLE AS y1, 2 + k % 8 / 4.0::DOUBLE + 12 + k % 15 AS x2, 1 + k % 12 / 4.0::DOUBLE + 8 + k % 12 AS y2"
_EMPTY = ", ".join(f"'' AS {c}" for c in CODE_KEYS if c not in ("qr_code_barcode", "price1_qr"))
_NAMES = {k: f'"{v}"' for k, v in LABELS.items()}
_COLOR_SQL = "CASE color WHEN 'red' THEN 'красный' WHEN 'yellow' THEN 'жёлтый' ELSE 'неизвестно' END"
_SHOWN = ", ".join(f"coalesce(nullif({c}::VARCHAR, ''), '-') AS {c}" for c in SHOWN)

SQL = {
    "q01_track_best": f"WITH {_BOXES} SELECT track_id, frame_idx, box_idx, conf, round(score, 6) AS score, first_frame, first_box FROM best WHERE place = 1",
    "q02_frame_tracks": f"WITH {_BOXES} SELECT frame_idx, string_agg(track_id::VARCHAR, ',' ORDER BY first_frame, first_box, track_id) AS tracks, trunc(frame_idx / 29.97::DOUBLE * 1000)::BIGINT AS timestamp_ms FROM best WHERE place = 1 GROUP BY frame_idx",
    "q03_bbox": """
WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + l_extendedprice / 1000 AS x2, l_discount * 100 + l_tax * 1000 AS y2 FROM lineitem),
s AS (SELECT *, trunc(sqrt((x2 - x1) * (x2 - x1)))::INT AS w, trunc(sqrt((y2 - y1) * (y2 - y1)))::INT AS h FROM e)
SELECT l_orderkey, l_linenumber, trunc(least(x1, x2))::INT AS x_min, trunc(least(y1, y2))::INT AS y_min, trunc(greatest(x1, x2))::INT AS x_max, trunc(greatest(y1, y2))::INT AS y_max,
  CASE WHEN w >= 10 AND h >= 10 THEN w END AS warp_w, CASE WHEN w >= 10 AND h >= 10 THEN h END AS warp_h FROM s""",
    "q04_raw_text": f"SELECT conv_id, string_agg({_TEXT}, ' ' ORDER BY turn) AS raw_text FROM conversations GROUP BY conv_id",
    "q05_first_price": f"SELECT doc_id, coalesce(list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda x: {_price('x')}), lambda p: p <> '')[1], '') AS price FROM documents",
    "q06_zones": f"SELECT conv_id, {_zone(True, True)} AS left_top, {_zone(True, False)} AS right_top, {_zone(False, True)} AS left_bottom, {_zone(False, False)} AS right_bottom FROM conversations GROUP BY conv_id",
    "q07_discount": rf"""
WITH t AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN {_N} || '%' WHEN 1 THEN 'x -' || {_N} WHEN 2 THEN 'abc' ELSE '' END AS a,
    CASE WHEN l_orderkey % 2 = 0 THEN 'save ' || {_N} || ' %' ELSE 'x' END AS b FROM lineitem),
n AS (SELECT *, coalesce(nullif(regexp_extract(a, '(-?\d+)\s*%', 1), ''), nullif(regexp_extract(a, '(-?\d+)', 1), ''), nullif(regexp_extract(b, '(-?\d+)\s*%', 1), '')) AS n FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(n::BIGINT) <= 100 THEN '-' || ltrim(n, '-') || '%' ELSE '' END AS amount, CASE WHEN abs(n::BIGINT) > 100 THEN '-' || ltrim(n, '-') ELSE '' END AS price FROM n""",
    "q08_price_rules": f"""
WITH t AS (
  SELECT o_orderkey, (o_orderkey % 5000)::VARCHAR AS w, lpad((o_custkey % 100)::VARCHAR, 2, '0') AS c, (o_custkey * 7 % 5000) || '.99' AS a FROM orders),
d AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN w || '.00' WHEN 1 THEN w || '.' || c ELSE {_price("('N ' || w || ' ' || c)")} END AS b FROM t),
k AS (SELECT *, {_KOPECKS.format("b")} AS p FROM d)
SELECT o_orderkey, CASE WHEN p::DOUBLE < a::DOUBLE THEN '' ELSE replace(p, '.', ',') END AS price_default, replace(a, '.', ',') AS price_discount FROM k""",
    "q09_code_fields": f"""
WITH p AS (SELECT 'order ' || o_orderkey AS key, {_PAYLOAD} AS payload, ';' AS sep FROM orders
  UNION ALL SELECT 'page ' || page_id, replace(CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) ELSE '' END || '&p3=' || page_id, 'page=', 'P2='), '&' FROM pages),
k AS (SELECT key, {_PAIRS.replace("';'", "sep")} AS kv FROM p) SELECT key, {_CODES} FROM k""",
    "q10_code_fallback": """
SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END WHEN event_id % 5 = 0 THEN 'second' END, ''),
  CASE WHEN event_id % 7 <> 0 THEN user_id::VARCHAR END, '') AS qr_data FROM events""",
    "q11_tag_color": """
WITH p AS (SELECT l_orderkey AS image_id, (l_partkey % 256)::INT AS b, (l_suppkey * 3 % 256)::INT AS g, ((l_orderkey * 7 + l_linenumber * 31) % 256)::INT AS r FROM lineitem),
m AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM p),
a AS (SELECT image_id, v, CASE WHEN v = 0 THEN 0 ELSE floor(255 * d::DOUBLE / v + 0.5) END AS s,
  CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN 30 * (g - b) / d::DOUBLE WHEN v = g THEN 60 + 30 * (b - r) / d::DOUBLE ELSE 120 + 30 * (r - g) / d::DOUBLE END AS t FROM m),
h AS (SELECT *, floor(CASE WHEN t < 0 THEN t + 180 ELSE t END + 0.5)::INT % 180 AS h FROM a),
c AS (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE (h <= 10 OR h >= 160) AND s >= 70 AND v >= 50) / count(*) AS red, count(*) FILTER (WHERE h BETWEEN 20 AND 35 AND s >= 70 AND v >= 50) / count(*) AS yellow FROM h GROUP BY image_id)
SELECT image_id, n, round(red, 9) AS red_share, round(yellow, 9) AS yellow_share, CASE WHEN red > 0.05 THEN 'red' WHEN yellow > 0.05 THEN 'yellow' ELSE 'unknown' END AS color FROM c""",
    "q12_orientation": f"""
WITH p AS (SELECT p_partkey AS image_id, i // 5 AS y, i % 5 AS x, CASE WHEN p_partkey * (i + 1) % 7 < 2 THEN 1 ELSE 0 END AS c FROM part, range(30) AS v(i)),
s AS (SELECT image_id, {", ".join(map(_turn, range(4)))} FROM p GROUP BY image_id),
u AS (SELECT image_id, unnest([{{'k': 0, 's': s0}}, {{'k': 1, 's': s1}}, {{'k': 2, 's': s2}}, {{'k': 3, 's': s3}}]) AS t FROM s)
SELECT image_id, t.k AS quarters, round(t.s, 9) AS score FROM u QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(t.s, 12) DESC, t.k) = 1""",
    "q13_sharpness": f"""
WITH g AS (SELECT vec_id, {_GRID} FROM embeddings),
c AS (SELECT vec_id, i, g[i + 1] AS m, g[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1] + g[CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END + 1]
    + g[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1] + g[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1] AS around FROM g, range(64) AS v(i) WHERE len(g) = 64)
SELECT vec_id, round(var_pop(around - 4 * m) * 4096)::BIGINT AS sharpness_4096 FROM c GROUP BY vec_id UNION ALL SELECT vec_id, NULL FROM g WHERE g IS NULL OR len(g) <> 64""",
    "q14_frame_sampler": """
WITH e AS (SELECT user_id AS video, list({'v': value, 'id': event_id, 'kept': []::BIGINT[]} ORDER BY event_id) AS xs FROM events WHERE value >= 20 GROUP BY user_id)
SELECT video, array_to_string(list_reduce(xs, lambda a, x: CASE WHEN len(a.kept) < 5 AND (a.v IS NULL OR abs(x.v - a.v) > 10) THEN {'v': x.v, 'id': x.id, 'kept': list_append(a.kept, x.id)} ELSE a END,
  {'v': NULL::DOUBLE, 'id': 0::BIGINT, 'kept': []::BIGINT[]}).kept, ',') AS kept FROM e""",
    "q15_similarity": f"""
WITH g AS (SELECT vec_id, {_GRID} FROM embeddings),
m AS (SELECT a.vec_id, list_avg(a.g) AS x, list_avg(b.g) AS y, {_SQ.format("a.g")} AS vx, {_SQ.format("b.g")} AS vy,
  list_sum(list_transform(list_zip(a.g, b.g), lambda p: p[1] * p[2])) / len(a.g) - list_avg(a.g) * list_avg(b.g) AS xy FROM g a JOIN g b ON a.vec_id = b.vec_id + 1 AND len(a.g) = len(b.g))
SELECT vec_id, round((2 * x * y + 6.5025) * (2 * xy + 58.5225) / ((x * x + y * y + 6.5025) * (vx + vy + 58.5225)), 6) AS similarity FROM m""",
    "q16_progress": """
SELECT user_id AS task_id, event_id AS seq, value AS fraction FROM events
QUALIFY value >= greatest(0, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))""",
    "q17_record": f"WITH {_RECORD} SELECT * FROM rec",
    "q18_display": f"WITH {_RECORD} SELECT {_SHOWN} FROM rec",
    "q19_thumbnails": f"""WITH {_RECORD}
SELECT warped_image, md5(coalesce('data:image/png;base64,' || to_base64(encode(text)), '')) AS thumbnail_md5 FROM rec LEFT JOIN documents ON warped_image = 'img/' || doc_id""",
    "q20_keyframes": """
WITH b AS (SELECT 'v' || user_id % 3 AS video, user_id AS track_id, event_id // 50 AS frame_idx, event_id AS box_idx, (event_id % 100) / 100.0::DOUBLE AS conf, value AS sharpness FROM events),
s AS (SELECT *, sharpness + 100 * conf AS score FROM b WHERE conf >= 0.3 AND track_id IS NOT NULL),
best AS (
  SELECT *, first_value(frame_idx) OVER f AS first_frame, first_value(box_idx) OVER f AS first_box, row_number() OVER (PARTITION BY video, track_id ORDER BY score DESC NULLS LAST, frame_idx, box_idx) AS place
  FROM s WINDOW f AS (PARTITION BY video, track_id ORDER BY frame_idx, box_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
wanted AS (SELECT video, frame_idx, max(sharpness) AS sharpness, string_agg(track_id::VARCHAR, ',' ORDER BY first_frame, first_box) AS tracks, string_agg((box_idx % 70 + 60)::VARCHAR, ',' ORDER BY first_frame, first_box) AS right_edges FROM best WHERE place = 1 GROUP BY video, frame_idx),
videos AS (SELECT * FROM (VALUES ('v0', 30.0::DOUBLE), ('v1', 25.0::DOUBLE), ('v2', 29.97::DOUBLE)) AS v(video, fps))
SELECT w.video, w.frame_idx, trunc(w.frame_idx / fps * 1000)::BIGINT AS timestamp_ms, round(sharpness, 6) AS sharpness, tracks, right_edges, p_name
FROM wanted w JOIN videos v ON v.video = w.video JOIN part ON w.video = 'v' || p_partkey % 3 AND w.frame_idx = p_partkey // 3""",
    "q21_fields": f"""WITH {_FIELDS}
SELECT o_orderkey, trim(t1) AS product_name, CASE WHEN try_cast(d1 AS DOUBLE) < try_cast(r1 AS DOUBLE) THEN '' ELSE d1 END AS price_default, '' AS price_card, r1 AS price_discount, amount AS discount_amount FROM ended""",
    "q22_labelled": f"""WITH {_RECORD}
SELECT {", ".join(f"{_COLOR_SQL if c == 'color' else f"coalesce(nullif({c}::VARCHAR, ''), '-')"} AS {_NAMES[c]}" for c in SHOWN)},
  coalesce(md5('data:image/png;base64,' || to_base64(encode(text))), '-') AS {_NAMES["thumbnail"]} FROM rec LEFT JOIN documents ON warped_image = 'img/' || doc_id""",
    "q23_names": f"""
SELECT o_orderkey, 'frame_' || CASE WHEN o_orderkey * 40 > 999999 THEN (o_orderkey * 40)::VARCHAR ELSE lpad((o_orderkey * 40)::VARCHAR, 6, '0') END || '.png' AS frame,
  'frame_' || CASE WHEN o_orderkey * 40 > 999999 THEN (o_orderkey * 40)::VARCHAR ELSE lpad((o_orderkey * 40)::VARCHAR, 6, '0') END || '_quality=' || CASE WHEN o_custkey % 4 = 3 THEN o_custkey // 2 + 1 ELSE o_custkey // 2 END || '.png' AS best_frame,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'out/warped_tags/warped_' || o_orderkey * 40 || '_' || o_orderkey % 3 || '.png' ELSE '' END AS crop, substr({_PAYLOAD}, 1, 20) AS overlay,
  round(0.55::DOUBLE + 0.35::DOUBLE * (o_orderkey % 3 + 1) / 3, 9) AS progress FROM orders""",
    "q24_ocr_lines": f"""
WITH l AS (SELECT conv_id, list({_TEXT} ORDER BY turn, {_TEXT}) AS t, count(*) AS n FROM conversations GROUP BY conv_id), u AS (SELECT conv_id, t, n, unnest(range(n)) AS place FROM l)
SELECT conv_id, place::INT AS place, t[place + 1] AS text, CASE WHEN place < n // 2 THEN (place + 1)::DOUBLE / 10 ELSE 0 END AS conf, CASE WHEN place < n // 3 THEN 2.0::DOUBLE * place ELSE 0 END AS y FROM u""",
    "q25_evaluation": f"""WITH {_FIELDS}
SELECT 'price_discount' AS field, 'price_card' AS label, count(*) FILTER (WHERE r1 <> '') AS n, count(*) FILTER (WHERE r1 IN (SELECT (p_partkey % 300 + 100) || '.99' FROM part)) AS n_found FROM ended
UNION ALL SELECT 'discount_amount', 'discount_amount', count(*) FILTER (WHERE amount <> ''), count(*) FILTER (WHERE amount IN (SELECT '-' || p_partkey % 20 || '%' FROM part)) FROM ended
UNION ALL SELECT 'price_card', 'code', 0, 0""",
    "q26_crops": f"""WITH {_crop(f"SELECT k AS id, k AS n, {_TAG_K} FROM (SELECT p_partkey AS k FROM part)")},
sums AS (SELECT id, h, w, sum(b)::BIGINT AS blue, sum(g)::BIGINT AS green, sum(r)::BIGINT AS red,
  sum(b * ((y * w + x) * 3 % 97 + 1) + g * (((y * w + x) * 3 + 1) % 97 + 1) + r * (((y * w + x) * 3 + 2) % 97 + 1))::BIGINT AS checked FROM crop GROUP BY id, h, w)
SELECT id AS p_partkey, h, w, blue, green, red, checked, color, quarters FROM sums JOIN look USING (id)""",
    "q27_price_tags": f"""WITH
seen AS (SELECT p_partkey AS k, 'in/v' || p_partkey % 2 || '.avi' AS video, p_partkey // 4 + o AS n, o, 50.0::DOUBLE + CASE WHEN o = 0 THEN p_partkey % 7 ELSE p_partkey * 3 % 7 END AS sharp FROM part, range(2) AS v(o)),
best AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY k ORDER BY sharp DESC, n) = 1),
listed AS (SELECT *, (row_number() OVER (PARTITION BY video, n ORDER BY k // 4, k) - 1)::INT AS tag_ord FROM best),
{_crop(f"SELECT k AS id, n, {_TAG_K} FROM listed WHERE n % 11 <> 0")}
SELECT split_part(video, '/', 2) AS filename, CASE WHEN look.id IS NULL THEN '' ELSE p_brand END AS product_name,
  CASE WHEN look.id IS NULL THEN '' ELSE (k % 900 + 100) || ',99' END AS price_default, '' AS price_card, '' AS price_discount,
  CASE WHEN look.id IS NULL THEN '' ELSE 'p1=' || k || '.5;barcode=' || k END AS barcode, '' AS discount_amount, '' AS id_sku, '' AS print_datetime, '' AS code, '' AS additional_info,
  coalesce(color, 'unknown') AS color, '' AS special_symbols, trunc(listed.n / 25.0::DOUBLE * 1000)::BIGINT AS frame_timestamp, trunc(x1)::INT AS x_min, trunc(y1)::INT AS y_min, trunc(x2)::INT AS x_max, trunc(y2)::INT AS y_max,
  CASE WHEN look.id IS NULL THEN '' ELSE 'warped_tags/' || split_part(video, '/', 2) || '-' || substr(md5(video), 1, 8) || '/warped_' || trunc(listed.n / 25.0::DOUBLE * 1000)::BIGINT || '_' || tag_ord || '.png' END AS warped_image,
  CASE WHEN look.id IS NULL THEN '' ELSE p_brand || ' ' || (k % 900 + 100) END AS raw_text, {_EMPTY},
  CASE WHEN look.id IS NULL THEN '' ELSE k::VARCHAR END AS qr_code_barcode, CASE WHEN look.id IS NULL THEN '' ELSE k || ',5' END AS price1_qr, tag_ord
FROM listed JOIN tag ON tag.id = k JOIN part ON p_partkey = k LEFT JOIN look ON look.id = k""",
    "q28_numbered": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place FROM orders",
    "q29_shrunk": f"""
WITH cell AS (SELECT n, y // 2 AS ty, x // 2 AS tx, {_level(0, 'y', 'x')} AS b, {_level(1, 'y', 'x')} AS g, {_level(2, 'y', 'x')} AS r FROM (SELECT p_partkey AS n, y, unnest(range(32)) AS x FROM (SELECT p_partkey, unnest(range(24)) AS y FROM part))),
small AS (SELECT n, ty, tx, floor(avg(b) + 0.5)::BIGINT AS b, floor(avg(g) + 0.5)::BIGINT AS g, floor(avg(r) + 0.5)::BIGINT AS r FROM cell GROUP BY n, ty, tx)
SELECT n AS p_partkey, 12::INT AS h, 16::INT AS w, sum(b)::BIGINT AS blue, sum(g)::BIGINT AS green, sum(r)::BIGINT AS red,
  sum(b * ((ty * 16 + tx) * 3 % 97 + 1) + g * (((ty * 16 + tx) * 3 + 1) % 97 + 1) + r * (((ty * 16 + tx) * 3 + 2) % 97 + 1))::BIGINT AS checked FROM small GROUP BY n""",
    "q30_average_precision": """
WITH truths AS (SELECT 'l' || p_partkey % 3 AS label, count(*) AS n_truths FROM part GROUP BY label),
pred AS (
  SELECT DISTINCT l_partkey AS t, 'l' || l_partkey % 3 AS label, ((l_orderkey * 8 + l_linenumber) * 64 + l_quantity)::BIGINT * 1000000 + l_partkey AS id,
    (l_orderkey * 7 + l_partkey) % 101 / 101.0::DOUBLE AS conf, l_quantity % 12 AS off FROM lineitem WHERE l_linenumber < 3),
ranked AS (SELECT *, (20 - off) * 20 / (800 - (20 - off) * 20) AS overlap, row_number() OVER (PARTITION BY label ORDER BY conf DESC, id) AS place, count(*) OVER (PARTITION BY label) AS n_predictions FROM pred),
levelled AS (SELECT *, unnest([0.5::DOUBLE, 0.75::DOUBLE]) AS level FROM ranked),
-- boxes of other parts are too far away, so a part's most confident box that is near enough takes it
hit AS (SELECT * FROM levelled WHERE overlap >= level QUALIFY row_number() OVER (PARTITION BY level, t ORDER BY conf DESC, id) = 1),
counted AS (SELECT *, row_number() OVER (PARTITION BY level, label ORDER BY place) AS k FROM hit),
point AS (SELECT level, label, k * 100 // n_truths AS reach, k / place AS precision FROM counted JOIN truths USING (label)),
areas AS (SELECT level, label, sum(best) / 101 AS area FROM (SELECT level, label, g, coalesce(max(precision) FILTER (WHERE reach >= g), 0) AS best FROM point, range(101) AS v(g) GROUP BY level, label, g) GROUP BY level, label)
SELECT label, level, n_truths, n_predictions, count(*) AS n_matched, round(count(*) / n_predictions, 9) AS precision, round(count(*) / n_truths, 9) AS recall, round(any_value(area), 9) AS average_precision
FROM hit JOIN truths USING (label) JOIN areas USING (level, label) GROUP BY label, level, n_truths, n_predictions""",
}
