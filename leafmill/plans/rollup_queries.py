"""Roll-ups, structuring and manifest queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.functions.text import page_stem, sentences
from leafmill.operators import manifest as MF, records as R, rollup, structure as S
from leafmill.plans.metric_queries import AGREE, BLOCKS, CURRENT, GUTTER, HEALTH, ORDERED, PARSED, RATIO, STRUCTURE, TABLES, classified
from leafmill.session import table


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.current_records(table(spark, sf_dir, "ir_records"))


def runner_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.score(_current(spark, sf_dir))


def worst_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.worst_papers(_current(spark, sf_dir))


def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.pair_agreement(_current(spark, sf_dir))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))
    return d


def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _current(spark, sf_dir).select("record_id", S.chunk_blocks(F.col("blocks")).alias("c"))
    # A filter that inline would bring along goes below the join that picks the records, and packs them twice.
    return r.select("record_id", F.inline_outer("c")).filter("id IS NOT NULL")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines with boxes made by arithmetic: 40 lines a page, a wider gap before every seventh."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    top = F.expr("10 + (i % 40) * 14 + IF(i % 7 = 0, 9, 0)").cast("double")
    x0 = (F.col("doc_id") % 3 * 10).cast("double")
    box = F.array(x0, top, x0 + F.least(F.length("text") * 5, F.lit(500)), top + 10.0)
    return d.select("doc_id", F.expr("CAST(i DIV 40 AS INT) + 1").alias("page"), F.col("i").alias("line"), "text", F.when(F.expr("i % 11 <> 5"), box).alias("bbox"))


def group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_lines(text_lines(spark, sf_dir), ["doc_id"])


def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words at places made by arithmetic, so that some tops round to the next line's bucket."""
    w = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.filter(F.split("text", "[ \n]+"), lambda x: x != "")).alias("seq", "text"))
    w = w.select("doc_id", F.expr("CAST(seq DIV 200 AS INT) + 1").alias("page"), "seq", F.expr("CAST((seq * 37) % 10 * 50 AS DOUBLE)").alias("x0"), F.expr("CAST((seq % 200) DIV 10 * 12 + seq % 3 AS DOUBLE)").alias("top"), "text")
    w = w.withColumns({"x1": F.col("x0") + F.length("text") * 5.0, "bottom": F.col("top") + 10.0})
    return S.words_to_lines(w, ["doc_id"])


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest against the hashes that the current floor records saw."""
    disk = _current(spark, sf_dir).filter("runner = 'pdfplumber'").select(F.concat("paper_id", F.lit(".pdf")).alias("filename"), F.col("pdf_sha256").alias("sha256"))
    return MF.diff(table(spark, sf_dir, "corpus_manifest"), disk)


def cache_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that the current version of one runner hasn't read with the manifest's content."""
    corpus = table(spark, sf_dir, "corpus_manifest").select(page_stem(F.col("filename")).alias("paper_id"), "sha256").distinct()
    results = table(spark, sf_dir, "ir_records").filter("runner = 'docling-tuned'")
    return MF.work_list(corpus, results, "2.60.0+ocr")


def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "ir_records").filter("runner = 'docling-default'").select("paper_id").distinct()
    return MF.missing_sources(table(spark, sf_dir, "corpus_manifest"), files)


def match_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.first_deliveries(table(spark, sf_dir, "ir_records")).select("record_id", "paper_id", "pdf_sha256")
    return MF.match_manifest(r, table(spark, sf_dir, "corpus_manifest")).select("record_id", "filename", "manifest_pages", (F.col("pdf_sha256") == F.col("sha256")).alias("same_content"))


def describe_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows from all pages of the floor runner's records."""
    c = _current(spark, sf_dir).filter("runner = 'pdfplumber'")
    return MF.describe(R.all_pages(c).withColumnRenamed("paper_id", "filename")).drop("doi")


QUERIES = {
    "runner_rollup": runner_rollup,
    "worst_five": worst_five,
    "pair_agreement": pair_agreement,
    "sentence_split": sentence_split,
    "chunk_blocks": chunk_blocks,
    "group_lines": group_lines,
    "words_to_lines": words_to_lines,
    "manifest_diff": manifest_diff,
    "cache_worklist": cache_worklist,
    "missing_sources": missing_sources,
    "match_manifest": match_manifest,
    "describe_pdf": describe_pdf,
}


def _rest(sql: str) -> str:
    """The tables a query adds to those of the blocks query, or to the current records."""
    return sql[len(BLOCKS) :] if sql.startswith(BLOCKS) else sql[len(CURRENT) :]


_PIECES = r"string_split(regexp_replace({0}, '([.!?])[\s\p{{Z}}\x{{0B}}\x{{85}}]+', '\1' || chr(1), 'g'), chr(1))"
_TRIMMED = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{0B}}\x{{85}}]+|[\s\p{{Z}}\x{{0B}}\x{{85}}]+$', '', 'g')"

ORACLE = {
    "runner_rollup": BLOCKS
    + "".join(map(_rest, (RATIO, ORDERED, STRUCTURE, TABLES, GUTTER, PARSED, HEALTH)))
    + """
SELECT runner, papers, coalesce(covered_papers, 0) AS covered_papers, coverage, coalesce(dropped_pages, 0) AS dropped_pages, coalesce(chars, 0) AS chars, order_monotonic, midword, sections_found,
  tables, empty_cells, gutter, gutter_large, checked, passed, passed / nullif(checked, 0) AS pass_rate, chunks, median_chunk, orphans, straddling, seconds_per_page
FROM (SELECT runner, count(*) AS papers, CASE WHEN NOT bool_and(wall_seconds = 0) THEN avg(wall_seconds / nullif(pages, 0)) END AS seconds_per_page FROM cur GROUP BY 1)
LEFT JOIN (SELECT runner, count(*) AS covered_papers, avg(median_ratio) AS coverage, sum(dropped_count)::BIGINT AS dropped_pages, sum(chars_total)::BIGINT AS chars FROM cv GROUP BY 1) USING (runner)
LEFT JOIN (SELECT runner, avg(monotonic_fraction) AS order_monotonic, sum(blocks_ending_midword)::BIGINT AS midword FROM ro GROUP BY 1) USING (runner)
LEFT JOIN (SELECT runner, avg(found_exactly_once) AS sections_found FROM sp GROUP BY 1) USING (runner)
LEFT JOIN (SELECT runner, sum(tables)::BIGINT AS tables, sum(empty_cell_ratio * cells) / sum(cells) FILTER (WHERE empty_cell_ratio IS NOT NULL) AS empty_cells FROM st GROUP BY 1) USING (runner)
LEFT JOIN (SELECT runner, sum(spanning) / nullif(sum(paragraphs), 0) AS gutter, sum(spanning_large) / nullif(sum(paragraphs_large), 0) AS gutter_large FROM gu GROUP BY 1) USING (runner)
LEFT JOIN (SELECT runner, sum(checked)::BIGINT AS checked, sum(passed)::BIGINT AS passed FROM ar GROUP BY 1) USING (runner)
LEFT JOIN (SELECT runner, sum(chunks)::BIGINT AS chunks, avg(median_chars) AS median_chunk, sum(orphan_chunks)::BIGINT AS orphans, sum(straddling_chunks)::BIGINT AS straddling FROM ch GROUP BY 1) USING (runner)""",
    "worst_five": RATIO + " SELECT runner, n::INT AS rank, paper_id, round_even(median_ratio, 3)::DOUBLE AS median_ratio FROM (SELECT *, row_number() OVER (PARTITION BY runner ORDER BY median_ratio, paper_id) AS n FROM cv WHERE median_ratio IS NOT NULL) WHERE n <= 5",
    "pair_agreement": AGREE
    + """
SELECT left_runner, right_runner, papers, median_agreement FROM (SELECT a.runner AS left_runner, b.runner AS right_runner, count(*) AS papers FROM cur a JOIN cur b USING (paper_id) WHERE a.runner < b.runner GROUP BY ALL)
LEFT JOIN (SELECT left_runner, right_runner, avg(m) AS median_agreement FROM (SELECT left_runner, right_runner, paper_id, quantile_cont(score, 0.5) AS m FROM sc GROUP BY ALL) GROUP BY ALL) USING (left_runner, right_runner)""",
    "sentence_split": f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS n, s AS sentence FROM (
  SELECT doc_id, i, {_TRIMMED.format("p")} AS s FROM (SELECT doc_id, unnest(p) AS p, unnest(range(len(p))) AS i FROM (SELECT doc_id, {_PIECES.format("text")} AS p FROM documents WHERE text IS NOT NULL))) WHERE s <> ''""",
    "chunk_blocks": CURRENT.replace("WITH", "WITH RECURSIVE", 1)
    + rf""",
bl AS (SELECT record_id, unnest(blocks) AS b, unnest(range(len(blocks))) AS i FROM cur),
hd AS (SELECT *, sum((b.kind = 'section_header')::INT) OVER w AS sec,
  coalesce(last_value(CASE WHEN b.kind = 'section_header' THEN nullif({_TRIMMED.format("b.text")}, '') END IGNORE NULLS) OVER w, '(front matter)') AS section FROM bl
  WINDOW w AS (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pc AS (SELECT record_id, sec, section, i, b."order" AS o, {_PIECES.format("coalesce(b.text, '')")} AS p FROM hd WHERE b.kind IN ('paragraph', 'caption', 'other')),
ps AS (SELECT record_id, sec, section, i, o, {_TRIMMED.format("x")} AS s, j FROM (SELECT record_id, sec, section, i, o, unnest(p) AS x, unnest(range(len(p))) AS j FROM pc)),
sn AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY i, j) AS n FROM ps WHERE s <> ''),
fo AS (SELECT record_id, n, sec, length(s) AS used, 0 AS chunk FROM sn WHERE n = 1
  UNION ALL SELECT s.record_id, s.n, s.sec, CASE WHEN s.sec <> f.sec OR f.used + length(s.s) + 1 > 1200 THEN length(s.s) ELSE f.used + length(s.s) + 1 END,
    f.chunk + (s.sec <> f.sec OR f.used + length(s.s) + 1 > 1200)::INT FROM fo f JOIN sn s ON s.record_id = f.record_id AND s.n = f.n + 1)
SELECT record_id, chunk AS id, string_agg(s, ' ' ORDER BY n) AS text, list(DISTINCT o ORDER BY o) AS block_ids, any_value(section) AS section, length(string_agg(s, ' ' ORDER BY n))::INT AS chars
FROM fo JOIN sn USING (record_id, n) GROUP BY record_id, chunk""",
    "group_lines": f"""
WITH l AS (SELECT doc_id, unnest(p) AS text, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, (i // 40 + 1)::INT AS page, (10 + (i % 40) * 14 + CASE WHEN i % 7 = 0 THEN 9 ELSE 0 END)::DOUBLE AS y FROM l),
b AS (SELECT *, CASE WHEN i % 11 <> 5 THEN [doc_id % 3 * 10, y, doc_id % 3 * 10 + least(length(text) * 5, 500), y + 10]::DOUBLE[] END AS bbox FROM m),
k AS (SELECT doc_id, page, i, t, bbox, by_text FROM {classified("b")} WHERE t <> ''),
g AS (SELECT *, coalesce(1.6 * quantile_cont(bbox[4] - bbox[2], 0.5) OVER (PARTITION BY doc_id, page), 10.0) AS lim, coalesce(bbox[2] - lag(bbox[4]) OVER w, 0) AS gap, lag(i) OVER w IS NULL AS top, by_text <> 'paragraph' OR lag(by_text) OVER w <> 'paragraph' AS br FROM k WINDOW w AS (PARTITION BY doc_id, page ORDER BY i)),
n AS (SELECT *, sum((top OR gap > lim OR br)::INT) OVER (PARTITION BY doc_id, page ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS block FROM g),
j AS (SELECT doc_id, page, block, list_reduce(list(t ORDER BY i), lambda a, x: CASE WHEN a LIKE '%-' THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END) AS text,
  CASE WHEN count(bbox) > 0 THEN [min(bbox[1]), min(bbox[2]), max(bbox[3]), max(bbox[4])] END AS bbox FROM n GROUP BY ALL)
SELECT doc_id, page, block, by_text AS kind, text, bbox FROM {classified("j")}""",
    "words_to_lines": """
WITH w AS (SELECT doc_id, unnest(t) AS text, unnest(range(len(t))) AS seq FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, (seq // 200 + 1)::INT AS page, seq, ((seq * 37) % 10 * 50)::DOUBLE AS x0, ((seq % 200) // 10 * 12 + seq % 3)::DOUBLE AS top, text, length(text) * 5.0 AS n FROM w),
g AS (SELECT doc_id, page, round_even(top / 2.0, 0) AS k, string_agg(text, ' ' ORDER BY x0, seq) AS text, [min(x0), min(top), max(x0 + n), max(top + 10.0)]::DOUBLE[] AS bbox FROM p GROUP BY ALL)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1)::INT AS line, text, bbox FROM g""",
    "manifest_diff": CURRENT
    + """
SELECT DISTINCT filename, status FROM (SELECT filename, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' WHEN have <> want THEN 'changed' END AS status
  FROM (SELECT DISTINCT filename, sha256 AS want FROM corpus_manifest) FULL JOIN (SELECT paper_id || '.pdf' AS filename, pdf_sha256 AS have FROM cur WHERE runner = 'pdfplumber') USING (filename)) WHERE status IS NOT NULL""",
    "cache_worklist": r"""
SELECT DISTINCT paper_id, sha256 FROM (SELECT regexp_replace(filename, '\.[^.]*$', '') AS paper_id, sha256 FROM corpus_manifest) m
WHERE NOT EXISTS (SELECT 1 FROM ir_records r WHERE r.runner = 'docling-tuned' AND r.runner_version = '2.60.0+ocr' AND r.paper_id = m.paper_id AND r.pdf_sha256 = m.sha256)""",
    "missing_sources": r"SELECT DISTINCT regexp_replace(filename, '\.[^.]*$', '') AS paper_id FROM corpus_manifest m WHERE NOT EXISTS (SELECT 1 FROM ir_records r WHERE r.runner = 'docling-default' AND r.paper_id = regexp_replace(m.filename, '\.[^.]*$', ''))",
    "match_manifest": CURRENT
    + r"""
SELECT record_id, filename, m.pages AS manifest_pages, d.pdf_sha256 = m.sha256 AS same_content FROM d JOIN
  (SELECT *, regexp_replace(filename, '\.[^.]*$', '') AS paper_id FROM corpus_manifest QUALIFY row_number() OVER (PARTITION BY regexp_replace(filename, '\.[^.]*$', '') ORDER BY filename, sha256) = 1) m USING (paper_id)""",
    "describe_pdf": BLOCKS
    + """
SELECT paper_id AS filename, count(*)::INT AS pages, sum(chars)::BIGINT AS chars_text_layer, sum(chars) / count(*) < 200 AS scanned FROM (
  SELECT paper_id, page, coalesce(sum(n), 0) + greatest(count(n) - 1, 0) AS chars FROM (
    SELECT runner, paper_id, unnest(range(1, greatest(pages, 1) + 1))::INT AS page, NULL AS n FROM cur
    UNION ALL SELECT runner, paper_id, b.page, length(b.text) FROM bl WHERE b.kind <> 'table' AND b.text <> ''
    UNION ALL SELECT runner, paper_id, page, length(text) FROM ce WHERE text <> '') WHERE runner = 'pdfplumber' GROUP BY paper_id, page) GROUP BY 1""",
}
