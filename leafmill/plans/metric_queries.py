"""Metrics of the current extraction records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.functions.text import SECTION_NAMES, SECTION_PATTERNS, classify, parse_number
from leafmill.operators import metrics, records as R
from leafmill.session import table


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.current_records(table(spark, sf_dir, "ir_records"))


def _of(operator):
    return lambda spark, sf_dir: operator(_current(spark, sf_dir))


def current_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).select("record_id", "runner", "paper_id", "runner_version")


def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_deliveries(table(spark, sf_dir, "ir_records")).select("record_id", "paper_id", "runner", "loaded_at")


def validate_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _current(spark, sf_dir)
    return r.select("record_id", R.violation().alias("violation"))


def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _current(spark, sf_dir).select("runner", R.violation().alias("violation"))
    return r.groupBy("runner", "violation").agg(F.count("*").alias("n"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one runner and paper with other content in another run."""
    r = R.first_deliveries(table(spark, sf_dir, "ir_records"))
    return r.select("record_id", R.content_hash(r).alias("content_hash"))


def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.cells(_current(spark, sf_dir)).select("text").distinct()
    return c.select("text", parse_number(F.col("text")).alias("value"))


def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.blocks(_current(spark, sf_dir)).filter("kind <> 'table'")
    return b.select("kind", classify(F.col("text")).alias("by_text")).groupBy("kind", "by_text").agg(F.count("*").alias("n"))


def arithmetic_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.total_series(_current(spark, sf_dir)).filter(~F.col("passed"))
    return s.select("runner", "paper_id", "table_idx", "page", "axis", "r", "c", F.round("summed", 4).alias("summed"), "printed")


def table_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.table_arithmetic(_current(spark, sf_dir)).select("runner", "paper_id", "checked", "passed", "pass_rate", F.coalesce(F.size("failures"), F.lit(0)).alias("failures"))


QUERIES = {
    "current_records": current_keys,
    "first_deliveries": first_deliveries,
    "validate_ir": validate_ir,
    "violation_counts": violation_counts,
    "content_hash": content_hash,
    "parse_number": parse_numbers,
    "classify_lines": classify_blocks,
    "chars_per_page": _of(R.chars_per_page),
    "page_text": _of(R.page_texts),
    "page_coverage": _of(metrics.page_coverage),
    "coverage": _of(metrics.coverage),
    "page_agreement": _of(metrics.page_agreement),
    "agreement_pairs": _of(metrics.agreement),
    "reading_order": _of(metrics.reading_order),
    "structure_proxy": _of(metrics.structure_proxy),
    "cost": _of(metrics.cost),
    "table_arithmetic": table_arithmetic,
    "table_failures": arithmetic_failures,
    "table_structure": _of(metrics.table_structure),
    "column_interleaving": _of(metrics.column_interleaving),
    "chunk_health": _of(metrics.chunk_health),
}

CURRENT = """
WITH d AS (SELECT * FROM ir_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at) = 1),
cur AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY runner, paper_id ORDER BY run_at DESC NULLS LAST, record_id DESC) = 1)"""
BLOCKS = CURRENT + """,
bl AS (SELECT runner, paper_id, unnest(blocks) AS b FROM cur),
tb AS (SELECT runner, paper_id, unnest(tables) AS t, unnest(range(len(tables))) AS table_idx FROM cur),
rw AS (SELECT runner, paper_id, table_idx, t.page AS page, unnest(t.cells) AS cells, unnest(range(len(t.cells))) AS r FROM tb),
ce AS (SELECT runner, paper_id, table_idx, page, r, unnest(cells) AS text, unnest(range(len(cells))) AS c FROM rw)"""
CHARS = BLOCKS + """,
cp AS (SELECT runner, paper_id, page, sum(n)::BIGINT AS chars FROM (
  SELECT runner, paper_id, unnest(range(1, greatest(pages, 1) + 1))::INT AS page, 0 AS n FROM cur
  UNION ALL SELECT runner, paper_id, b.page, length(coalesce(b.text, '')) FROM bl WHERE b.kind IN ('paragraph', 'section_header', 'caption', 'other')
  UNION ALL SELECT runner, paper_id, t.page, 0 FROM tb
  UNION ALL SELECT runner, paper_id, page, length(text) FROM ce WHERE text IS NOT NULL) GROUP BY ALL)"""
RATIO = CHARS + """,
fl AS (SELECT paper_id, page, chars AS floor_chars FROM cp WHERE runner = 'pdfplumber' AND chars >= 50),
ra AS (SELECT cur.runner, cur.paper_id, fl.page, coalesce(cp.chars, 0) / fl.floor_chars AS ratio
       FROM cur JOIN fl USING (paper_id) LEFT JOIN cp ON cp.runner = cur.runner AND cp.paper_id = cur.paper_id AND cp.page = fl.page),
cv AS (SELECT t.runner, t.paper_id, chars_total, coalesce(pages_compared, 0) AS pages_compared, median_ratio, min_ratio,
       coalesce(dropped_pages, []) AS dropped_pages, coalesce(dropped_count, 0) AS dropped_count
  FROM (SELECT runner, paper_id, sum(chars)::BIGINT AS chars_total FROM cp GROUP BY ALL) t
  SEMI JOIN (SELECT paper_id FROM cur WHERE runner = 'pdfplumber') f USING (paper_id)
  LEFT JOIN (SELECT runner, paper_id, count(*) AS pages_compared, quantile_cont(ratio, 0.5) AS median_ratio, min(ratio) AS min_ratio,
    list(page ORDER BY page) FILTER (WHERE ratio < 0.1) AS dropped_pages, count(*) FILTER (WHERE ratio < 0.1) AS dropped_count FROM ra GROUP BY ALL) a USING (runner, paper_id))"""
PAGE_TEXT = BLOCKS + """,
pt AS (SELECT runner, paper_id, page, string_agg(text, ' ' ORDER BY k, o, r, c) AS text FROM (
  SELECT runner, paper_id, b.page AS page, b.text AS text, 0 AS k, b."order" AS o, 0 AS r, 0 AS c FROM bl
    WHERE b.kind IN ('paragraph', 'section_header', 'caption', 'other') AND b.text <> ''
  UNION ALL SELECT runner, paper_id, page, text, 1, table_idx, r, c FROM ce WHERE text <> '') GROUP BY ALL)"""
AGREE = PAGE_TEXT + """,
gr AS (SELECT runner, paper_id, page, CASE WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) ELSE [] END AS g
  FROM (SELECT s.runner, s.paper_id, s.page, trim(regexp_replace(lower(coalesce(pt.text, '')), '[^a-z0-9]+', ' ', 'g')) AS t
        FROM (SELECT runner, paper_id, unnest(range(1, greatest(pages, 1) + 1))::INT AS page FROM cur) s LEFT JOIN pt USING (runner, paper_id, page))),
pr AS (SELECT a.runner AS left_runner, b.runner AS right_runner, a.paper_id, a.page, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS n
  FROM gr a JOIN gr b ON a.paper_id = b.paper_id AND a.page = b.page AND a.runner < b.runner),
sc AS (SELECT left_runner, right_runner, paper_id, page, i / (n - i) AS score FROM pr WHERE n - i > 0)"""
#: A number as Python reads it, after the marks that papers print are dropped.
NUMBER = r"""CASE WHEN regexp_full_match(u, '[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?')
  OR regexp_full_match(lower(u), '[+-]?(nan|inf|infinity)') THEN
  (CASE WHEN w THEN -1 ELSE 1 END) * try_cast(replace(u, '_', '') AS DOUBLE) END"""
PARSED = BLOCKS + rf""",
pn AS (SELECT *, {NUMBER} AS value FROM (SELECT *, regexp_replace(regexp_replace(v, '^[()]+|[()]+$', '', 'g'), ',', '', 'g') AS u, v LIKE '(%' AND v LIKE '%)' AS w FROM (
  SELECT *, translate(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '−–—% ' || chr(160), '---') AS v FROM ce))),
lb AS (SELECT *, coalesce(regexp_matches(text, '(?i)^\s*(total|totals|sum|sums|overall)\s*[:.]?\s*$'), false) AS label FROM pn),
ts AS (SELECT *, max(c < 2 AND label) OVER rw AND r >= 1 AS row_total, max(r < 2 AND label) OVER cl AND c >= 1 AS col_total,
  sum(value) FILTER (WHERE r >= 1) OVER up AS row_sum, count(value) FILTER (WHERE r >= 1) OVER up AS row_n,
  sum(value) FILTER (WHERE c >= 1) OVER lf AS col_sum, count(value) FILTER (WHERE c >= 1) OVER lf AS col_n FROM lb
  WINDOW rw AS (PARTITION BY runner, paper_id, table_idx, r), cl AS (PARTITION BY runner, paper_id, table_idx, c),
  up AS (PARTITION BY runner, paper_id, table_idx, c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  lf AS (PARTITION BY runner, paper_id, table_idx, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
se AS (SELECT *, abs(summed - printed) <= greatest(abs(printed) * 0.01, 0.01) AS ok FROM (
  SELECT runner, paper_id, table_idx, page, 'row' AS axis, r, c, row_sum AS summed, value AS printed FROM ts WHERE row_total AND value IS NOT NULL AND row_n >= 2
  UNION ALL SELECT runner, paper_id, table_idx, page, 'col', r, c, col_sum, value FROM ts WHERE col_total AND value IS NOT NULL AND col_n >= 2)),
ar AS (SELECT runner, paper_id, coalesce(checked, 0) AS checked, coalesce(passed, 0) AS passed, passed / nullif(checked, 0) AS pass_rate, failures FROM cur LEFT JOIN
  (SELECT runner, paper_id, count(*) AS checked, count(*) FILTER (WHERE ok) AS passed, least(count(*) FILTER (WHERE NOT ok), 20)::INT AS failures FROM se GROUP BY ALL) USING (runner, paper_id))"""
#: A word border where letters of all scripts, figures and _ are word characters.
_COUNTS = ", ".join(rf"len(list_filter(h, lambda t: coalesce(regexp_matches(lower(t), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({p})($|[^\p{{L}}\p{{M}}\p{{N}}_])'), false)))::INT AS {n}_headers" for n, p in SECTION_PATTERNS.items())
STRUCTURE = CURRENT + f""",
sp AS (SELECT *, {' + '.join(f'({n}_headers = 1)::INT' for n in SECTION_PATTERNS)} AS found_exactly_once,
  list_filter([{', '.join(f"CASE WHEN {n}_headers = 0 THEN '{n}' END" for n in SECTION_PATTERNS)}], lambda x: x IS NOT NULL) AS missing FROM (
  SELECT runner, paper_id, len(h)::INT AS section_headers, {_COUNTS} FROM (
    SELECT runner, paper_id, list_transform(list_filter(coalesce(blocks, []), lambda b: b.kind = 'section_header'), lambda b: b.text) AS h FROM cur)))"""
ORDERED = BLOCKS + """,
bx AS (SELECT runner, paper_id, b.page AS page, b.bbox AS bbox, lag(b.page) OVER w AS p0, lag(b.bbox) OVER w AS b0 FROM bl
  WHERE len(b.bbox) > 0 WINDOW w AS (PARTITION BY runner, paper_id ORDER BY b."order")),
ro AS (SELECT runner, paper_id, coalesce(len(blocks), 0)::INT AS blocks, coalesce(n, 0)::INT AS blocks_with_bbox, ok / nullif(n - 1, 0) AS monotonic_fraction, coalesce(mid, 0)::INT AS blocks_ending_midword FROM cur
  LEFT JOIN (SELECT runner, paper_id, count(*) AS n, count(*) FILTER (WHERE p0 IS NOT NULL AND CASE WHEN page = p0 THEN bbox[2] >= b0[2] - 2 OR bbox[1] > b0[3] ELSE page > p0 END) AS ok FROM bx GROUP BY ALL) USING (runner, paper_id)
  LEFT JOIN (SELECT runner, paper_id, count(*) AS mid FROM bl WHERE b.kind = 'paragraph' AND regexp_matches(regexp_replace(b.text, '[\\s\\p{Z}]+$', ''), '(-|[a-z])$') GROUP BY ALL) USING (runner, paper_id))"""
TABLES = BLOCKS + r""",
st AS (SELECT runner, paper_id, coalesce(tables, 0) AS tables, coalesce(cells, 0) AS cells, CASE WHEN cells > 0 THEN empty / n END AS empty_cell_ratio,
  CASE WHEN cells > 0 THEN num / n END AS numeric_cell_ratio, CASE WHEN cells > 0 THEN median_rows END AS median_rows, CASE WHEN cells > 0 THEN median_cols END AS median_cols
  FROM (SELECT runner, paper_id FROM cur) LEFT JOIN (SELECT runner, paper_id, count(*) AS tables, sum(t.rows * t.cols)::BIGINT AS cells, quantile_cont(t.rows::DOUBLE, 0.5) AS median_rows, quantile_cont(t.cols::DOUBLE, 0.5) AS median_cols FROM tb GROUP BY ALL) USING (runner, paper_id)
  LEFT JOIN (SELECT runner, paper_id, count(*) AS n, count(*) FILTER (WHERE coalesce(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') = '') AS empty,
    count(*) FILTER (WHERE regexp_matches(text, '\p{Nd}')) AS num FROM ce GROUP BY ALL) USING (runner, paper_id))"""
GUTTER = BLOCKS + """,
gp AS (SELECT runner, paper_id, length(b.text) AS n, b.bbox[1] AS x0, b.bbox[3] AS x1, max(b.bbox[3]) OVER (PARTITION BY runner, paper_id, b.page) AS w FROM bl WHERE b.kind = 'paragraph' AND len(b.bbox) = 4),
gs AS (SELECT *, x0 < 0.35 * w AND x1 > 0.65 * w AS s FROM gp WHERE w > 0),
gu AS (SELECT *, spanning / nullif(paragraphs, 0) AS ratio, spanning_large / nullif(paragraphs_large, 0) AS ratio_large FROM (
  SELECT runner, paper_id, coalesce(a, 0) AS paragraphs, coalesce(b, 0) AS spanning, coalesce(c, 0) AS paragraphs_large, coalesce(d, 0) AS spanning_large FROM (SELECT runner, paper_id FROM cur)
  LEFT JOIN (SELECT runner, paper_id, count(*) AS a, count(*) FILTER (WHERE s) AS b, count(*) FILTER (WHERE n >= 150) AS c, count(*) FILTER (WHERE s AND n >= 150) AS d FROM gs GROUP BY ALL) USING (runner, paper_id)))"""
HEALTH = CURRENT + """,
ck AS (SELECT runner, paper_id, unnest(chunks) AS k, list_transform(list_filter(blocks, lambda b: b.kind = 'section_header'), lambda b: b."order") AS heads FROM cur),
ch AS (SELECT runner, paper_id, coalesce(n, 0)::INT AS chunks, median_chars, p10_chars, p90_chars, coalesce(o, 0)::INT AS orphan_chunks, coalesce(m, 0)::INT AS midsentence_starts, coalesce(s, 0)::INT AS straddling_chunks
  FROM (SELECT runner, paper_id FROM cur) LEFT JOIN (SELECT runner, paper_id, count(*) AS n, quantile_cont(k.chars::DOUBLE, 0.5) AS median_chars,
    list(k.chars ORDER BY k.chars)[1 + least(count(*) - 1, floor(count(*) * 0.1::DOUBLE)::BIGINT)] AS p10_chars, list(k.chars ORDER BY k.chars)[1 + least(count(*) - 1, floor(count(*) * 0.9::DOUBLE)::BIGINT)] AS p90_chars,
    count(*) FILTER (WHERE k.chars < 100) AS o, count(*) FILTER (WHERE lower(k.text[1:1]) = k.text[1:1] AND upper(k.text[1:1]) <> k.text[1:1]) AS m,
    count(*) FILTER (WHERE len(list_filter(heads, lambda h: h > list_min(k.block_ids) AND h < list_max(k.block_ids))) > 0) AS s FROM ck GROUP BY ALL) USING (runner, paper_id))"""
_NAMES = ", ".join(f"'{n}'" for n in SECTION_NAMES)


def classified(source: str) -> str:
    """``source`` (with a text column) with its text trimmed as t and the kind its text says as by_text."""
    return rf"""(SELECT *, CASE WHEN t = '' THEN 'other' WHEN regexp_matches(t, '(?i)^(figure|fig\.?|table|scheme|plate)[\s\p{{Z}}]*\p{{Nd}}') THEN 'caption'
  WHEN lower(bare) IN ({_NAMES}) OR (num AND nw <= 8 AND NOT bare LIKE '%.') OR (nw <= 6 AND bare = upper(bare) AND lower(bare) <> bare AND length(bare) > 2) THEN 'section_header' ELSE 'paragraph' END AS by_text
FROM (SELECT *, len(list_filter(regexp_split_to_array(bare, '[\s\p{{Z}}]+'), lambda w: w <> '')) AS nw FROM (
  SELECT *, regexp_replace(regexp_replace(CASE WHEN num THEN rest ELSE t END, '[:.]+$', ''), '[\s\p{{Z}}]+$', '') AS bare FROM (
    SELECT *, rest <> '' AS num FROM (SELECT *, regexp_extract(t, '^(\p{{Nd}}+(?:\.\p{{Nd}}+)*)[.)]?[\s\p{{Z}}]+([A-Za-z](?s:.*))$', 2) AS rest FROM (
      SELECT *, regexp_replace(coalesce(text, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM {source}))))))"""


#: The first invariant that a current record breaks.
VALID = CURRENT + """,
va AS (SELECT record_id, runner, CASE
  WHEN paper_id IS NULL OR runner IS NULL OR runner_version IS NULL OR pdf_sha256 IS NULL OR blocks IS NULL OR tables IS NULL OR chunks IS NULL OR wall_seconds IS NULL THEN 'field'
  WHEN pages IS NULL OR pages < 1 THEN 'pages'
  WHEN len(list_filter(blocks, lambda b: NOT coalesce(b.kind IN ('paragraph', 'section_header', 'caption', 'table', 'other'), false))) > 0 THEN 'block kind'
  WHEN len(list_filter(blocks, lambda b: b.text IS NULL)) > 0 THEN 'block text'
  WHEN len(list_filter(blocks, lambda b: NOT coalesce(b.page >= 1, false))) > 0 THEN 'block page'
  WHEN len(list_filter(blocks, lambda b: b."order" IS NULL)) > 0 THEN 'block order'
  WHEN len(list_filter(blocks, lambda b: b.bbox IS NOT NULL AND (len(b.bbox) <> 4 OR len(list_filter(b.bbox, lambda v: v IS NULL)) > 0))) > 0 THEN 'block bbox'
  WHEN list_sort(list_transform(blocks, lambda b: b."order")) <> list_transform(blocks, lambda b: b."order") THEN 'blocks not sorted'
  WHEN len(list_filter(tables, lambda t: t.page IS NULL OR t.rows IS NULL OR t.cols IS NULL)) > 0 THEN 'table fields'
  WHEN len(list_filter(tables, lambda t: NOT coalesce(len(t.cells) = t.rows, false))) > 0 THEN 'table rows'
  WHEN len(list_filter(tables, lambda t: len(list_filter(t.cells, lambda r: NOT coalesce(len(r) = t.cols, false))) > 0)) > 0 THEN 'table cols'
  WHEN len(list_filter(chunks, lambda c: NOT coalesce(length(c.text) = c.chars, false))) > 0 THEN 'chunk text'
  WHEN len(list_filter(chunks, lambda c: c.block_ids IS NULL OR len(list_filter(c.block_ids, lambda i: i IS NULL OR NOT list_contains(list_transform(blocks, lambda b: b."order"), i))) > 0)) > 0 THEN 'chunk block ids'
  END AS violation FROM cur)"""
#: Records as JSON with their keys in alphabetical order.
_JSON = "to_json({blocks: list_transform(blocks, lambda b: {bbox: b.bbox, kind: b.kind, \"order\": b.\"order\", page: b.page, text: b.text}), chunks: list_transform(chunks, lambda c: {block_ids: c.block_ids, chars: c.chars, id: c.id, section: c.section, text: c.text}), pages: pages, paper_id: paper_id, pdf_sha256: pdf_sha256, runner: runner, runner_version: runner_version, tables: list_transform(tables, lambda t: {caption: t.caption, cells: t.cells, cols: t.cols, page: t.page, \"rows\": t.rows})})"

ORACLE = {
    "validate_ir": VALID + " SELECT record_id, violation FROM va",
    "violation_counts": VALID + " SELECT runner, violation, count(*) AS n FROM va GROUP BY ALL",
    "content_hash": CURRENT + f" SELECT record_id, sha256({_JSON}::VARCHAR) AS content_hash FROM d",
    "current_records": CURRENT + " SELECT record_id, runner, paper_id, runner_version FROM cur",
    "first_deliveries": CURRENT + " SELECT record_id, paper_id, runner, loaded_at FROM d",
    "parse_number": PARSED + " SELECT DISTINCT text, value FROM pn",
    "classify_lines": BLOCKS + f""" SELECT kind, by_text, count(*) AS n FROM {classified("(SELECT b.kind AS kind, b.text AS text FROM bl WHERE b.kind <> 'table')")} GROUP BY ALL""",
    "chars_per_page": CHARS + " SELECT * FROM cp",
    "page_text": PAGE_TEXT + " SELECT * FROM pt",
    "page_coverage": RATIO + " SELECT * FROM ra",
    "coverage": RATIO + " SELECT * FROM cv",
    "page_agreement": AGREE + " SELECT * FROM sc",
    "agreement_pairs": AGREE
    + """ SELECT left_runner, right_runner, paper_id, count(*) AS pages_compared, quantile_cont(score, 0.5) AS median,
  list(page ORDER BY score, page) FILTER (WHERE n <= 5) AS worst_pages, list(round_even(score, 3)::DOUBLE ORDER BY score, page) FILTER (WHERE n <= 5) AS worst_scores
  FROM (SELECT *, row_number() OVER (PARTITION BY left_runner, right_runner, paper_id ORDER BY score, page) AS n FROM sc) GROUP BY ALL""",
    "reading_order": ORDERED + " SELECT * FROM ro",
    "structure_proxy": STRUCTURE + " SELECT * FROM sp",
    "cost": CURRENT + " SELECT runner, paper_id, wall_seconds, wall_seconds / nullif(pages, 0) AS seconds_per_page FROM cur",
    "table_arithmetic": PARSED + " SELECT * REPLACE (coalesce(failures, 0) AS failures) FROM ar",
    "table_failures": PARSED + " SELECT runner, paper_id, table_idx::INT AS table_idx, page, axis, r::INT AS r, c::INT AS c, round(summed, 4) AS summed, printed FROM se WHERE NOT ok",
    "table_structure": TABLES + " SELECT * FROM st",
    "column_interleaving": GUTTER + " SELECT * FROM gu",
    "chunk_health": HEALTH + " SELECT * FROM ch",
}
