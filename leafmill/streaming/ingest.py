"""Incremental extraction: files that appear are extracted once for each content and extractor version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.functions.text import page_stem
from leafmill.operators.manifest import work_list
from leafmill.sources.extractors import extract


def ingest(spark: SparkSession, folder: str, results: str, runner: str, version: str, checkpoint: str):
    """A query over the PDFs of ``folder`` that writes new records below ``results``/runner=...; run with what is there.

    Each micro-batch drops papers whose content and version already have a result; a paper that fails gets no row.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def step(batch: DataFrame, _: int) -> None:
        corpus = batch.select(page_stem(F.element_at(F.split("path", "/"), -1)).alias("paper_id"), F.sha2("content", 256).alias("sha256"), "path", "content")
        todo = corpus
        try:
            todo = work_list(corpus, spark.read.parquet(f"{results}/runner={runner}"), version)
        except Exception as e:  # the first batch finds no results
            if "PATH_NOT_FOUND" not in str(e):
                raise
        extract(todo, runner, version).filter("error IS NULL").drop("error", "runner").write.mode("append").parquet(f"{results}/runner={runner}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
