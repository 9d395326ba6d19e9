"""Queries over the flat tables of nested extraction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.operators.flatten import flatten_nested, merged_schema, parse_records, record_child_keys
from leafmill.session import drop_redelivered, table


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, their schema merged from those of all files."""
    return spark.read.option("mergeSchema", "true").parquet(f"{sf_dir}/ir_records.parquet")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return flatten_nested(drop_redelivered(_merged(spark, sf_dir), "record_id", "loaded_at"), "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_child_keys(_merged(spark, sf_dir))


def p4_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long cell table with its parents' keys."""
    return _tables(spark, sf_dir)["tables.cells"].select("record_id", "i", "j", "k", F.col("value").alias("cell"))


def p4_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the blocks' boxes."""
    return _tables(spark, sf_dir)["blocks.bbox"]


def p4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["chunks"].select("record_id", "i", "id", "section", "chars", "text")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's references to blocks, those without a block too."""
    return _tables(spark, sf_dir)["chunks.block_ids"].select("record_id", "i", "j", F.col("value").alias("block_id"))


def p4_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the records as they come in JSON: one schema is merged from all texts, then every level is exploded."""
    records = drop_redelivered(table(spark, sf_dir, "ir_records").select("record_id", "loaded_at", "blocks"), "record_id", "loaded_at")
    texts = records.select("record_id", F.to_json(F.struct("blocks")).alias("json"))
    parsed = parse_records(texts, "json", merged_schema(texts, "json")).select("record_id", "record.*")
    b = flatten_nested(parsed, "record_id")["blocks"]
    return b.select("record_id", "i", F.col("page").cast("int").alias("page"), "kind", "text", F.col("order").cast("int").alias("order"))


QUERIES = {"p4_found": p4_found, "p4_cells": p4_cells, "p4_bbox": p4_bbox, "p4_chunks": p4_chunks, "p4_links": p4_links, "p4_json": p4_json}

_RECORDS = "WITH r AS (SELECT * FROM ir_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at) = 1)"

ORACLE = {
    "p4_found": _RECORDS
    + """,
b AS (SELECT record_id, unnest(blocks) AS b, unnest(range(len(blocks))) AS i FROM r),
t AS (SELECT record_id, unnest(tables) AS t, unnest(range(len(tables))) AS i FROM r),
tr AS (SELECT record_id, i, unnest(t.cells) AS cells, unnest(range(len(t.cells))) AS j FROM t),
c AS (SELECT record_id, unnest(chunks) AS c, unnest(range(len(chunks))) AS i FROM r),
l AS (SELECT record_id, i, unnest(c.block_ids) AS k, unnest(range(len(c.block_ids))) AS j FROM c)
SELECT record_id, 'block' AS child, i::INT AS i, -1 AS j, -1 AS k FROM b
UNION ALL SELECT record_id, 'bbox', i::INT, -1, -1 FROM b WHERE b.bbox IS NOT NULL
UNION ALL SELECT record_id, 'table', i::INT, -1, -1 FROM t
UNION ALL SELECT record_id, 'cell', i::INT, j::INT, unnest(range(len(cells)))::INT FROM tr
UNION ALL SELECT record_id, 'chunk', i::INT, -1, -1 FROM c
UNION ALL SELECT record_id, 'link', i::INT, j::INT, k::INT FROM l
WHERE EXISTS (SELECT 1 FROM b WHERE b.record_id = l.record_id AND b.b."order" = l.k)""",
    "p4_cells": _RECORDS
    + """,
t AS (SELECT record_id, unnest(tables) AS t, unnest(range(len(tables))) AS i FROM r),
tr AS (SELECT record_id, i, unnest(t.cells) AS cells, unnest(range(len(t.cells))) AS j FROM t)
SELECT record_id, i::INT AS i, j::INT AS j, unnest(range(len(cells)))::INT AS k, unnest(cells) AS cell FROM tr""",
    "p4_bbox": _RECORDS
    + """,
b AS (SELECT record_id, unnest(blocks) AS b, unnest(range(len(blocks))) AS i FROM r)
SELECT record_id, i::INT AS i, unnest(range(len(b.bbox)))::INT AS j, unnest(b.bbox) AS value FROM b""",
    "p4_chunks": _RECORDS + """, c AS (SELECT record_id, unnest(chunks) AS c, unnest(range(len(chunks))) AS i FROM r) SELECT record_id, i::INT AS i, c.id AS id, c.section AS section, c.chars AS chars, c.text AS text FROM c""",
    "p4_links": _RECORDS
    + """,
c AS (SELECT record_id, unnest(chunks) AS c, unnest(range(len(chunks))) AS i FROM r)
SELECT record_id, i::INT AS i, unnest(range(len(c.block_ids)))::INT AS j, unnest(c.block_ids) AS block_id FROM c""",
    "p4_json": _RECORDS
    + """, b AS (SELECT record_id, unnest(blocks) AS b, unnest(range(len(blocks))) AS i FROM r)
SELECT record_id, i::INT AS i, b.page AS page, b.kind AS kind, b.text AS text, b."order" AS "order" FROM b""",
}
