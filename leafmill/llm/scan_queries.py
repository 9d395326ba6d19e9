"""Queries of problem 5."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.scans import noise, paragraphs
from leafmill.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(table(spark, sf_dir, "ir_records"), table(spark, sf_dir, "corpus_manifest"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of all scanned papers."""
    return paragraphs(table(spark, sf_dir, "ir_records"), table(spark, sf_dir, "corpus_manifest"))


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
ORACLE: dict[str, str] = {}
