"""Queries of problem 2."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.truncation import cut_blocks, shares
from leafmill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_blocks(table(spark, sf_dir, "ir_records")).select("record_id", "block_order")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return shares(table(spark, sf_dir, "ir_records"))


QUERIES = {"p2_found": p2_found, "p2_shares": p2_shares}
ORACLE: dict[str, str] = {}
