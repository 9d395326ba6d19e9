"""Queries of problem 8."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.sentences import sentences
from leafmill.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p8_found": p8_found}
ORACLE: dict[str, str] = {}
