"""Command line: manifest build|verify, run, compare, import-baseline, export, search."""

from __future__ import annotations

import argparse
import sys
from importlib import import_module
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from leafmill.functions.text import page_stem
from leafmill.operators import bundle, lexical, manifest, rollup, vectors
from leafmill.session import build_session
from leafmill.sources import extractors, files, vectors as vector_file


def _manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    disk = manifest.scan_corpus(spark, a.corpus)
    if a.action == "build":
        found = extractors.extract(disk.join(spark.read.format("binaryFile").load(f"{a.corpus}/*").select("path", "content"), "path").select(page_stem(F.col("filename")).alias("paper_id"), "sha256", "content"), a.runner, "manifest")
        chars = F.aggregate(F.coalesce("blocks", F.expr("array()")), F.lit(0).cast("bigint"), lambda s, b: s + F.length(F.coalesce(b["text"], F.lit(""))))
        d = found.select("paper_id", F.coalesce("pages", F.lit(0)).alias("pages"), chars.alias("chars_text_layer"))
        d = d.withColumn("scanned", (F.col("pages") > 0) & (F.col("chars_text_layer") / F.greatest("pages", F.lit(1)) < manifest.SCANNED_BELOW)).withColumn("doi", F.lit(None).cast("string"))
        d = disk.withColumn("paper_id", page_stem(F.col("filename"))).join(d, "paper_id").select("filename", "sha256", "pages", "chars_text_layer", "scanned", "doi")
        files.write_manifest(d, a.manifest)
        return 0
    drift = manifest.diff(files.read_manifest(spark, a.manifest), disk).orderBy("status", "filename").collect()
    for r in drift:
        print(f"{r['status']}: {r['filename']}")
    return 1 if drift else 0


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.runner not in extractors.names():
        print(f"unknown runner {a.runner}; there are: {', '.join(extractors.names())}", file=sys.stderr)
        return 2
    version = a.version or extractors.VERSIONS[a.runner]()
    disk = manifest.scan_corpus(spark, a.corpus)
    if manifest.diff(files.read_manifest(spark, a.manifest), disk).head(1):
        print("the corpus differs from its manifest; see: manifest verify", file=sys.stderr)
        return 1
    old = files.read_results(spark, a.results).filter(F.col("runner") == a.runner) if a.runner in files.runners(spark, a.results) else None
    corpus = disk.select(page_stem(F.col("filename")).alias("paper_id"), "sha256", "path")
    todo = manifest.work_list(corpus, old, version, a.force, a.limit) if old is not None else manifest.work_list(corpus, corpus.select("paper_id", F.col("sha256").alias("pdf_sha256"), F.lit("").alias("runner_version")), version, a.force, a.limit)
    content = spark.read.format("binaryFile").load(f"{a.corpus}/*").select("path", "content")
    new = extractors.extract(todo.join(content, "path"), a.runner, version).cache()
    for r in new.filter("error IS NOT NULL").select("paper_id", "error").toLocalIterator():
        print(f"failed: {r['paper_id']}: {r['error']}", file=sys.stderr)
    new = new.filter("error IS NULL").drop("error")
    merged = manifest.upsert(old.select(*new.columns), new, ["paper_id"]) if old is not None else new
    files.write_results_jsonl(merged.cache(), a.results)
    return 0


def _compare(spark: SparkSession, a: argparse.Namespace) -> int:
    records = files.read_results(spark, a.results).cache()
    print(rollup.write_report(records, a.out, a.floor))
    return 0


def _import(spark: SparkSession, a: argparse.Namespace) -> int:
    entries = files.read_manifest(spark, a.manifest).select(page_stem(F.col("filename")).alias("paper_id"), F.col("sha256").alias("pdf_sha256"))
    docs = files.documents_to_records(files.read_documents(spark, f"{a.folder}/*.json"))
    missing = entries.join(docs.select("paper_id"), "paper_id", "left_anti").orderBy("paper_id").collect()
    for r in missing:
        print(f"missing: {r['paper_id']}", file=sys.stderr)
    files.write_results_jsonl(docs.join(entries, "paper_id").cache(), a.results)
    return 1 if missing else 0


def _export(spark: SparkSession, a: argparse.Namespace) -> int:
    records = files.read_results(spark, a.results).filter(F.col("runner") == a.runner)
    head = bundle.write_bundle(records, files.read_manifest(spark, a.manifest), a.out, a.corpus, a.runner)
    print(f"{head['counts']['papers']} papers, {head['counts']['chunks']} chunks, {len(head['missing_pdfs'])} PDFs missing")
    if a.no_embed or not a.embedder:
        print("no vectors: search in the bundle is lexical")
        return 0
    module, _, name = a.embedder.partition(":")
    embedder = getattr(import_module(module), name)
    v = vectors.embed(bundle.numbered_chunks(spark, a.out), "text", embedder, a.dim)
    stats = vector_file.write_vectors(v, a.out, a.model or a.embedder, "row")
    print(f"{stats['count']} vectors, mean cosine error {stats['mean_error']:.5f}, worst cosine {stats['worst_cosine']:.4f}")
    return 0


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    _, _, chunks, _ = bundle.load_bundle(spark, a.bundle)
    top = lexical.rank(chunks, a.query, a.k, ["id"]).select(F.col("id").alias("chunk_id"), "rank", "score")
    for h in bundle.hit_rows(top, chunks).orderBy("rank").collect():
        print(f"{h['rank']:>3} {h['score']:.3f} {h['chunk_id']} — {h['section']}: {h['snippet']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leafmill")
    p.add_argument("--results", default="results")
    p.add_argument("--manifest", default="corpus.manifest.json")
    p.add_argument("--corpus", default="corpus")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("manifest")
    m.add_argument("action", choices=["build", "verify"])
    m.add_argument("--runner", default="pdfplumber")
    r = sub.add_parser("run")
    r.add_argument("runner")
    r.add_argument("--version", help="instead of what the runner's provider says")
    r.add_argument("--limit", type=int, default=0)
    r.add_argument("--force", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("--floor", default=rollup.FLOOR_RUNNER)
    c.add_argument("--out", default="REPORT.md")
    i = sub.add_parser("import-baseline")
    i.add_argument("folder")
    e = sub.add_parser("export")
    e.add_argument("runner")
    e.add_argument("--out", required=True)
    e.add_argument("--no-embed", action="store_true")
    e.add_argument("--embedder", help="module:function from a list of texts to vectors")
    e.add_argument("--model", help="the name under which the vectors are noted")
    e.add_argument("--dim", type=int, default=384)
    s = sub.add_parser("search")
    s.add_argument("bundle")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=10)
    a = p.parse_args(argv)
    run = {"manifest": _manifest, "run": _run, "compare": _compare, "import-baseline": _import, "export": _export, "search": _search}[a.command]
    return run(build_session(), a)


if __name__ == "__main__":
    sys.exit(main())
