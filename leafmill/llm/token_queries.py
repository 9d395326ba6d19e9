"""Queries of problem 6."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.tokens import with_ids
from leafmill.session import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


QUERIES = {"p6_ids": p6_ids}
ORACLE: dict[str, str] = {}
