"""Queries of problem 1."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.repeats import repeated_places, without_repeated_lines
from leafmill.session import drop_redelivered, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_places(table(spark, sf_dir, "ir_records"))


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks without the lines of p1_found."""
    return without_repeated_lines(drop_redelivered(table(spark, sf_dir, "ir_records").select("record_id", "source", "paper_id", "blocks", "loaded_at"), "record_id", "loaded_at"))


QUERIES = {"p1_found": p1_found, "p1_blocks": p1_blocks}

_LINES = r"""
WITH r AS (SELECT * FROM ir_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at) = 1),
b AS (SELECT record_id, source, paper_id, unnest(blocks) AS b FROM r WHERE source IS NOT NULL),
s AS (SELECT record_id, source, paper_id, b."order" AS block_order, string_split(b.text, chr(10)) AS parts FROM b
      WHERE b.text IS NOT NULL AND coalesce(b.kind, '') NOT IN ('section_header', 'table')),
l AS (SELECT record_id, source, paper_id, block_order, unnest(range(len(parts)))::INT AS line_no, unnest(parts) AS line FROM s),
n AS (SELECT *, trim(regexp_replace(lower(regexp_replace(line, '\p{Nd}+', '', 'g')), '[\s\p{Z}\x{0B}\x{85}]+', ' ', 'g')) AS norm FROM l),
w AS (SELECT * FROM n WHERE len(regexp_extract_all(norm, '\p{L}+')) >= 3),
t AS (SELECT source, count(DISTINCT paper_id) AS papers FROM r WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT source, norm FROM w JOIN t USING (source) GROUP BY source, norm, papers
      HAVING count(DISTINCT paper_id) >= 3 AND count(DISTINCT paper_id) * 5 >= papers)"""

ORACLE = {
    "p1_found": _LINES + "\nSELECT record_id, block_order, line_no FROM w SEMI JOIN f USING (source, norm)",
    "p1_blocks": _LINES
    + r""",
k AS (SELECT record_id, block_order, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT bad) AS kept
      FROM (SELECT n.*, f.norm IS NOT NULL AS bad FROM n LEFT JOIN f USING (source, norm)) GROUP BY ALL)
SELECT a.record_id, a.b."order" AS block_order, a.b.page AS page, a.b.kind AS kind,
       CASE WHEN k.record_id IS NULL THEN a.b.text ELSE coalesce(kept, '') END AS text
FROM (SELECT record_id, unnest(blocks) AS b FROM r) a LEFT JOIN k ON k.record_id = a.record_id AND k.block_order = a.b."order" """,
}
