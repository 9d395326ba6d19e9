"""Queries of problem 3."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm.lookalikes import identical_pairs, items, one_form
from leafmill.session import drop_redelivered, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identical_pairs(table(spark, sf_dir, "ir_records"))


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's text in its one form."""
    records = drop_redelivered(table(spark, sf_dir, "ir_records").select("record_id", "paper_id", "blocks", "tables", "loaded_at"), "record_id", "loaded_at")
    return items(records).select("record_id", "item", one_form(F.col("text")).alias("text"))


QUERIES = {"p3_found": p3_found, "p3_texts": p3_texts}
ORACLE: dict[str, str] = {}
