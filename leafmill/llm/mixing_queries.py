"""Queries of problem 7."""

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.mixing import mix, report
from leafmill.session import table


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual shares of the mix."""
    return report(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p7_mix": p7_mix, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
