"""Retrieval bundles: papers, chunks with the page rectangles they come from, views of them, and the bundle's files."""

from __future__ import annotations

import hashlib
import json
import shutil
import warnings
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.operators.manifest import match_manifest
from leafmill.schema import BUNDLE_CHUNK, BUNDLE_PAPER


def regions(ids: Column, blocks: Column) -> Column:
    """Rectangles of the blocks a chunk points at, grouped by page: pages ascending, rectangles in the order of the ids.

    Ids are places in ``blocks``; those outside, and blocks without a box, add nothing. Row-local, no join or shuffle.
    """
    hits = F.filter(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.when(i >= 0, F.get(blocks, i))), lambda b: b.isNotNull() & b["bbox"].isNotNull())
    pages = F.array_sort(F.array_distinct(F.transform(hits, lambda b: b["page"])))
    return F.transform(pages, lambda p: F.struct(p.alias("page"), F.transform(F.filter(hits, lambda b: b["page"] == p), lambda b: b["bbox"]).alias("rects")))


def bundle_papers(records: DataFrame, manifest: DataFrame) -> DataFrame:
    m = match_manifest(records.select("paper_id"), manifest)
    return m.select("paper_id", "filename", F.col("manifest_pages").alias("pages"), "sha256")


def bundle_chunks(records: DataFrame) -> DataFrame:
    """(id, paper_id, section, text, chars, regions) of every chunk; the id is "paper#chunk"."""
    c = records.select("paper_id", "blocks", F.explode("chunks").alias("c"))
    return c.select(F.concat_ws("#", "paper_id", F.col("c.id").cast("string")).alias("id"), "paper_id", "c.section", "c.text", "c.chars", regions(F.col("c.block_ids"), F.col("blocks")).alias("regions"))


def chunks_per_paper(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id").agg(F.count("*").alias("chunks"))


def page_view(chunks: DataFrame, paper_id: str, page: int) -> DataFrame:
    """The chunks of one paper with their rectangles on one page."""
    c = chunks.filter(F.col("paper_id") == paper_id)
    return c.select("id", "section", "text", F.flatten(F.transform(F.filter("regions", lambda r: r["page"] == page), lambda r: r["rects"])).alias("rects"))


def hit_rows(hits: DataFrame, chunks: DataFrame, snippet: int = 180) -> DataFrame:
    """Hits (chunk_id, rank, score) with their chunk's fields and the beginning of its text."""
    c = chunks.select(F.col("id").alias("chunk_id"), "paper_id", "section", F.substring("text", 1, snippet).alias("snippet"))
    return hits.join(c, "chunk_id")


def page_scale(rendered: Column, points: Column) -> Column:
    """Rendered width over width in points; 0 gives 1."""
    return F.when(points == 0, 1.0).otherwise(rendered / points)


def rect_style(rect: Column, scale: Column) -> Column:
    """left, top, width, height of a rectangle at a scale; never negative sizes."""
    x0, y0, x1, y1 = (F.get(rect, F.lit(i)) for i in range(4))
    return F.struct((F.least(x0, x1) * scale).alias("left"), (F.least(y0, y1) * scale).alias("top"), (F.abs(x1 - x0) * scale).alias("width"), (F.abs(y1 - y0) * scale).alias("height"))


def longest_chunks(chunks: DataFrame) -> DataFrame:
    """Of each paper the longest chunk that has a region, with its first region."""
    c = chunks.filter(F.size("regions") > 0)
    best = F.max_by(F.struct("id", "chars", F.get("regions", F.lit(0)).alias("region")), F.struct("chars", "id"))
    return c.groupBy("paper_id").agg(best.alias("b")).select("paper_id", "b.*")


def missing_flags(papers: DataFrame, missing: list[str]) -> DataFrame:
    """Papers with ``missing``: whether their PDF is among the bundle's missing ones."""
    m = papers.sparkSession.createDataFrame([(f, True) for f in sorted(set(missing))], "filename string, missing boolean")
    return papers.join(F.broadcast(m), "filename", "left").withColumn("missing", F.coalesce("missing", F.lit(False)))  # a bundle's list


def write_bundle(records: DataFrame, manifest: DataFrame, out: str, pdf_dir: str | None = None, runner: str | None = None, corpus_id: str | None = None, name: str | None = None) -> dict:
    """Write papers.json, chunks.json and manifest.json, and copy the PDFs to pdfs/; a vector file that is there stays as
    it is. The corpus is named after the folder unless told otherwise.

    A bundle is what one browser loads: its rows pass through the driver one at a time and are streamed to the file.
    """
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    counts, files, papers = {}, {}, []
    for table, df in (("papers", bundle_papers(records, manifest).orderBy("paper_id")), ("chunks", bundle_chunks(records).orderBy("paper_id", "id"))):
        digest, n = hashlib.sha256(), 0
        with (folder / f"{table}.json").open("wb") as f:
            for row in df.toJSON().toLocalIterator():
                part = (b"[" if n == 0 else b",\n") + row.encode()
                f.write(part)
                digest.update(part)
                n += 1
                if table == "papers":
                    papers.append(json.loads(row)["filename"])
            end = b"]" if n else b"[]"
            f.write(end)
            digest.update(end)
        counts[table], files[f"{table}.json"] = n, digest.hexdigest()
    missing = []
    for p in papers:
        if pdf_dir and (Path(pdf_dir) / p).exists():
            (folder / "pdfs").mkdir(exist_ok=True)
            shutil.copy2(Path(pdf_dir) / p, folder / "pdfs" / p)
        else:
            missing.append(p)
    first = records.orderBy("paper_id").select(*[c for c in ("runner", "runner_version") if c in records.columns]).head()
    by = first.asDict() if first else {}
    head = {
        "corpus_id": corpus_id or folder.name, "name": name or folder.name, "built_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "source_runner": runner or by.get("runner"), "runner_version": by.get("runner_version"), "embed_model": None, "dim": None,
        "counts": counts, "files": files, "missing_pdfs": sorted(missing),
    }
    (folder / "manifest.json").write_text(json.dumps(head, indent=2, sort_keys=True) + "\n")
    return head


def load_bundle(spark: SparkSession, folder: str, model: str | None = None) -> tuple[dict, DataFrame, DataFrame, str]:
    """(manifest, papers, chunks, status): status is "available", "no-vectors" or "embed-model-mismatch"; vectors of
    another model, or a file that is missing or of the wrong length, are refused, and search stays lexical."""
    head = json.loads((Path(folder) / "manifest.json").read_text())
    papers = spark.read.schema(BUNDLE_PAPER).json(f"{folder}/papers.json", multiLine=True)
    chunks = spark.read.schema(BUNDLE_CHUNK).json(f"{folder}/chunks.json", multiLine=True)
    vectors, n, dim = Path(folder) / "vectors.bin", head["counts"]["chunks"], head.get("dim")
    if head.get("embed_model") is None:
        status = "no-vectors"
    elif head["embed_model"] != model:
        status = "embed-model-mismatch"
    else:
        status = "available" if vectors.exists() and vectors.stat().st_size == n * 4 + n * dim else "no-vectors"
    return head, papers, chunks, status


def bundle_vectors(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame | None:
    """(chunk_id, embedding) of a bundle's chunks, the file's n-th row being the n-th chunk; None, with a warning where a
    file is missing or of the wrong length, if search has to stay lexical."""
    from leafmill.sources.vectors import read_vectors

    head, _, _, status = load_bundle(spark, folder, model)
    if status != "available":
        if head.get("embed_model") == model and model is not None:
            warnings.warn(f"{folder}/vectors.bin can't be used, search stays lexical", stacklevel=2)
        return None
    chunks = numbered_chunks(spark, folder)
    rows = read_vectors(spark, f"{folder}/vectors.bin", head["counts"]["chunks"], head["dim"])
    return chunks.join(rows, "row").select(F.col("id").alias("chunk_id"), "embedding")


def numbered_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(row, id, text) of a bundle's chunks with their places in chunks.json."""
    text = spark.read.text(f"{folder}/chunks.json", wholetext=True)
    each = text.select(F.posexplode(F.from_json("value", "array<struct<id:string,text:string>>")).alias("row", "c"))
    return each.select(F.col("row").cast("bigint").alias("row"), "c.id", "c.text")
