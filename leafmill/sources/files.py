"""Readers and writers of result files, manifests and layout-model documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.operators.structure import build_grid, chunk_blocks, flip_bbox, map_label, pad_rows
from leafmill.schema import MANIFEST, RECORD

_BOX = "STRUCT<l: DOUBLE, t: DOUBLE, r: DOUBLE, b: DOUBLE, coord_origin: STRING>"
_PROV = f"ARRAY<STRUCT<page_no: INT, bbox: {_BOX}>>"
_PAGE = "STRUCT<page_no: INT, size: STRUCT<width: DOUBLE, height: DOUBLE>>"
DOCUMENT = (
    f"pages STRING, texts ARRAY<STRUCT<self_ref: STRING, label: STRING, text: STRING, prov: {_PROV}>>, "
    f"tables ARRAY<STRUCT<self_ref: STRING, label: STRING, captions: ARRAY<STRUCT<`$ref`: STRING>>, prov: {_PROV}, data: STRUCT<num_rows: INT, "
    "num_cols: INT, grid: ARRAY<ARRAY<STRUCT<text: STRING>>>, table_cells: ARRAY<STRUCT<text: STRING, start_row_offset_idx: INT, "
    "start_col_offset_idx: INT, end_row_offset_idx: INT, end_col_offset_idx: INT>>>>>"
)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All <runner>.jsonl files of a folder; blank lines drop, of several lines of one paper the last counts."""
    raw = spark.read.text(f"{folder}/*.jsonl").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    raw = raw.filter(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    r = raw.select("file", "at", "line", F.from_json("value", RECORD).alias("r")).filter("r.paper_id IS NOT NULL")
    last = r.groupBy("file", F.col("r.paper_id").alias("p")).agg(F.max_by("r", F.struct("at", "line")).alias("r"))
    return last.select(F.regexp_replace("file", r"\.jsonl$", "").alias("_runner"), "r.*").drop("runner").withColumnRenamed("_runner", "runner")


def runners(spark: SparkSession, folder: str) -> list[str]:
    """Names of the runners that have a results file, sorted."""
    return sorted(p.stem for p in Path(folder).glob("*.jsonl"))


def write_results(records: DataFrame, folder: str) -> None:
    """Records as Parquet below runner=<name>; only the runners present are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("runner").parquet(folder)


def write_results_jsonl(records: DataFrame, folder: str) -> None:
    """One <runner>.jsonl for each runner, streamed; runners without records keep theirs. Papers that the old file has keep
    their places there, new ones follow by name."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for (runner,) in records.select("runner").distinct().orderBy("runner").collect():
        slots: dict[str, int] = {}
        if Path(f"{folder}/{runner}.jsonl").exists():
            with open(f"{folder}/{runner}.jsonl") as old:
                for line in filter(str.strip, old):
                    slots.setdefault(json.loads(line).get("paper_id"), len(slots))
        place = records.sparkSession.createDataFrame(list(slots.items()), "paper_id string, slot bigint")
        rows = records.filter(F.col("runner") == runner).join(place, "paper_id", "left").orderBy(F.asc_nulls_last("slot"), "paper_id").drop("slot")
        with open(f"{folder}/{runner}.jsonl", "w") as f:
            for line in rows.toJSON().toLocalIterator():
                f.write(line + "\n")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    if not Path(path).exists():
        raise FileNotFoundError(f"{path} is missing; build it with: manifest build")
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def write_manifest(manifest: DataFrame, path: str) -> None:
    rows = [r.asDict() for r in manifest.orderBy("filename").toLocalIterator()]
    Path(path).write_text(json.dumps(rows, indent=2, sort_keys=True) + "\n")


def read_documents(spark: SparkSession, paths: str) -> DataFrame:
    """Layout-model documents, one JSON file each, with the paper's id from the file's name."""
    d = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("paper_id"), F.from_json("value", DOCUMENT).alias("d"))
    return d.select("paper_id", "d.*")


def documents_to_records(documents: DataFrame, runner: str = "docling-default", version: str = "(imported)") -> DataFrame:
    """Layout-model documents as records, row by row: texts in their own order before the tables of each page, tables with
    their first caption that can be resolved, seconds 0. Blank texts and items without a page drop.
    """
    as_map = F.from_json("pages", f"MAP<STRING, {_PAGE}>")
    pages = F.when(F.ltrim("pages").startswith("["), F.from_json("pages", f"ARRAY<{_PAGE}>")).otherwise(F.map_values(as_map))
    d = documents.withColumn("pages", F.filter(F.coalesce(pages, F.array().cast(f"array<{_PAGE}>")), lambda p: p["page_no"].isNotNull()))
    height = lambda n: F.get(F.filter("pages", lambda p: p["page_no"] == n), F.lit(0))["size"]["height"]
    prov = lambda x: F.get(x["prov"], F.lit(0))
    texts = F.transform(
        F.filter(F.coalesce("texts", F.expr("array()")), lambda x: (F.trim(x["text"]) != "") & prov(x)["page_no"].isNotNull()),
        lambda x, i: F.struct(prov(x)["page_no"].alias("page"), F.lit(0).alias("late"), i.alias("i"), map_label(x["label"], x["text"]).alias("kind"), x["text"].alias("text"), flip_bbox(prov(x)["bbox"], height(prov(x)["page_no"])).alias("bbox")),
    )
    kept = F.filter(F.coalesce("tables", F.expr("array()")), lambda x: prov(x)["page_no"].isNotNull())
    late = F.transform(kept, lambda x, i: F.struct(prov(x)["page_no"].alias("page"), F.lit(1).alias("late"), i.alias("i"), F.lit("table").alias("kind"), F.lit("").alias("text"), flip_bbox(prov(x)["bbox"], height(prov(x)["page_no"])).alias("bbox")))
    ordered = F.array_sort(F.concat(texts, late), lambda a, b: F.when(a["page"] != b["page"], a["page"] - b["page"]).when(a["late"] != b["late"], a["late"] - b["late"]).otherwise(a["i"] - b["i"]))
    blocks = F.transform(ordered, lambda b, i: F.struct(b["page"].alias("page"), b["kind"].alias("kind"), b["text"].alias("text"), b["bbox"].alias("bbox"), i.alias("order")))
    said = lambda ref: F.get(F.filter("texts", lambda t: t["self_ref"] == ref), F.lit(0))["text"]
    caption = lambda x: F.get(F.filter(F.transform(F.coalesce(x["captions"], F.expr("array()")), lambda c: said(c["$ref"])), lambda t: t.isNotNull()), F.lit(0))
    grid = lambda x: pad_rows(build_grid(x["data"]))
    tables = F.transform(kept, lambda x: F.struct(prov(x)["page_no"].alias("page"), F.size(grid(x)).alias("rows"), F.coalesce(F.size(F.get(grid(x), F.lit(0))), F.lit(0)).alias("cols"), grid(x).alias("cells"), caption(x).alias("caption")))
    d = d.withColumn("blocks", blocks)
    count = F.coalesce(F.array_max(F.transform("pages", lambda p: p["page_no"])), F.array_max(F.transform("blocks", lambda b: b["page"])), F.lit(1))
    return d.select("paper_id", F.lit(runner).alias("runner"), F.lit(version).alias("runner_version"), count.alias("pages"), F.lit(0.0).alias("wall_seconds"), "blocks", tables.alias("tables"), chunk_blocks(F.col("blocks")).alias("chunks"))
