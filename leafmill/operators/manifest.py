"""The corpus on disk, its manifest, and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.functions.text import page_stem

SCANNED_BELOW = 200


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, path, sha256, length) of every PDF in a folder, whatever the case of its suffix, not below it."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.sha2("content", 256).alias("sha256"), "length")


def describe(pages: DataFrame) -> DataFrame:
    """Manifest rows from all pages (filename, page, text), those without text too: pages, characters, scanned if under 200
    a page."""
    d = pages.groupBy("filename").agg(F.count("*").cast("int").alias("pages"), F.sum(F.length(F.coalesce("text", F.lit(""))).cast("bigint")).alias("chars_text_layer"))
    return d.withColumn("scanned", (F.col("pages") > 0) & (F.col("chars_text_layer") / F.col("pages") < SCANNED_BELOW)).withColumn("doi", F.lit(None).cast("string"))


def diff(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(filename, status): missing on disk, extra there, or changed."""
    m = manifest.select("filename", F.col("sha256").alias("want")).distinct()
    d = disk.select("filename", F.col("sha256").alias("have"))
    j = m.join(d, "filename", "full_outer")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "changed")
    return j.select("filename", status.alias("status")).filter(F.col("status").isNotNull()).distinct()


def entry(manifest: DataFrame, filename: str) -> DataFrame:
    """The entry of a file; one that isn't in the manifest is an error."""
    found = manifest.filter(F.col("filename") == filename)
    if not found.head(1):
        raise KeyError(f"{filename} isn't in the manifest")
    return found


def match_manifest(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records with their manifest entry, by file name without suffix; records without one drop, of several entries the
    smallest file name counts."""
    m = manifest.select(page_stem(F.col("filename")).alias("paper_id"), "filename", "sha256", F.col("pages").alias("manifest_pages"))
    m = m.groupBy("paper_id").agg(F.min_by(F.struct("filename", "sha256", "manifest_pages"), F.struct("filename", "sha256")).alias("m"))
    return records.join(m, "paper_id").select("*", "m.*").drop("m")


def work_list(corpus: DataFrame, results: DataFrame, version: str, force: bool = False, limit: int = 0) -> DataFrame:
    """Papers of the corpus (paper_id, sha256) that have no result of this content and extractor version."""
    c = corpus.orderBy("paper_id").limit(limit) if limit else corpus
    if force:
        return c
    done = results.filter(F.col("runner_version") == version).select("paper_id", F.col("pdf_sha256").alias("sha256"))
    return c.join(done, ["paper_id", "sha256"], "left_anti")


def missing_sources(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Papers of the manifest without a file to import."""
    return manifest.select(page_stem(F.col("filename")).alias("paper_id")).distinct().join(files.select("paper_id"), "paper_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))
