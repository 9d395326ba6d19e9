"""Extractors: functions from a PDF's bytes to pages of lines and tables, registered by name and run one task a file.

An extractor takes (bytes, paper_id) and returns {"pages": n, "blocks": [...], "tables": [...]}; blocks have page, kind,
text and bbox. A converter returns a layout model's document instead, which becomes a record in Spark's columns. Either may
need a library that isn't there: it is imported inside, and what it raises becomes the row's error. Each has a version
provider, which says what a run would produce now without running it: results of another version aren't up to date.
"""

from __future__ import annotations

import json
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from importlib import metadata
from importlib.util import find_spec
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from leafmill.operators.structure import pack
from leafmill.schema import RECORD

Extractor = Callable[[bytes, str], dict]
EXTRACTORS: dict[str, Extractor] = {}
CONVERTERS: dict[str, Callable[[bytes, str], dict]] = {}
VERSIONS: dict[str, Callable[[], str]] = {}
#: Where the text items of a PDF are printed, and the library that does it.
ITEMS_SCRIPT, ITEMS_LIBRARY = Path(__file__).with_name("pdf_items.mjs"), Path("node_modules/pdfjs-dist/package.json")


def register(name: str, version: Callable[[], str] = lambda: "1", converter: bool = False) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        (CONVERTERS if converter else EXTRACTORS)[name] = f
        VERSIONS[name] = version
        return f

    return add


def names() -> list[str]:
    return sorted({*EXTRACTORS, *CONVERTERS})


def library_version(library: str) -> str:
    try:
        return f"{library}=={metadata.version(library)}"
    except metadata.PackageNotFoundError:
        return f"{library}==unknown"


def ocr_engine() -> str:
    """The engine that recognises text on this machine, as it is noted in a version: results of different ones differ."""
    wanted = [("ocrmac",)] * (sys.platform == "darwin") + [("rapidocr", "onnxruntime")]
    found = [libs[0] for libs in wanted if all(find_spec(x) for x in libs)]
    return f"+{found[0]}" if found else "+ocr-unknown"


def _with_path(content: bytes, use: Callable[[str], dict]) -> dict:
    """``use`` of a file with the content; other processes and libraries read files."""
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        return use(f.name)


@register("docling-default", lambda: library_version("docling"), converter=True)
def by_layout_model(content: bytes, paper_id: str) -> dict:
    """The layout model with all its options as they are."""
    from docling.document_converter import DocumentConverter

    return _with_path(content, lambda path: DocumentConverter().convert(path).document.export_to_dict())


@register("docling-tuned", lambda: library_version("docling") + ocr_engine(), converter=True)
def by_tuned_layout_model(content: bytes, paper_id: str) -> dict:
    """The layout model with every page recognised anew, accurate tables, and its parser named, so that a new default of
    the library doesn't change results."""
    from docling.backend.docling_parse_v4_backend import DoclingParseV4DocumentBackend
    from docling.datamodel.base_models import InputFormat
    from docling.datamodel.pipeline_options import PdfPipelineOptions, TableFormerMode
    from docling.document_converter import DocumentConverter, PdfFormatOption

    o = PdfPipelineOptions(do_ocr=True, do_table_structure=True, generate_page_images=False)
    o.ocr_options.force_full_page_ocr = True
    o.table_structure_options.mode, o.table_structure_options.do_cell_matching = TableFormerMode.ACCURATE, True
    how = {InputFormat.PDF: PdfFormatOption(pipeline_options=o, backend=DoclingParseV4DocumentBackend)}
    return _with_path(content, lambda path: DocumentConverter(format_options=how).convert(path).document.export_to_dict())


def items_version() -> str:
    try:
        return f"pdfjs-dist=={json.loads(ITEMS_LIBRARY.read_text())['version']}"
    except (OSError, ValueError, KeyError):
        return "pdfjs-dist==unknown"


@register("pdfjs-node", items_version)
def by_items(content: bytes, paper_id: str) -> dict:
    """Text items printed by a script in Node, put into lines and blocks here; no tables."""
    from leafmill.sources.layout import blocks_of_lines, lines_of_items

    pages = command(["node", str(ITEMS_SCRIPT)])(content, paper_id)["pages"]
    return {"pages": len(pages), "blocks": [b for n, p in enumerate(pages, 1) for b in blocks_of_lines(lines_of_items(p["items"], p["height"]), n)], "tables": []}


@register("pdfplumber", lambda: library_version("pdfplumber"))
def by_plumber(content: bytes, paper_id: str) -> dict:
    """The text layer as words; a page that fails is an empty one."""
    import io

    import pdfplumber

    from leafmill.sources.layout import blocks_of_words, padded

    blocks, tables = [], []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            try:
                words = [{"text": w["text"], "x0": w["x0"], "top": w["top"], "x1": w["x1"], "bottom": w["bottom"]} for w in page.extract_words()]
                blocks += blocks_of_words(words, n)
                tables += padded([t for t in page.extract_tables() if t], n)
            except Exception:
                continue
        return {"pages": len(pdf.pages), "blocks": blocks, "tables": tables}


def command(argv: list[str]) -> Extractor:
    """An extractor in another process: it gets a file's path and prints one JSON line."""

    def run(content: bytes, paper_id: str) -> dict:
        done = _with_path(content, lambda path: subprocess.run([*argv, path], capture_output=True, text=True))
        if done.returncode:
            raise RuntimeError(done.stderr[-500:])
        return json.loads(done.stdout)

    return run


def extract(files: DataFrame, runner: str, version: str, extractor: Extractor | None = None) -> DataFrame:
    """Files (paper_id, sha256, content) as records, with ``error`` where a file failed; other files aren't affected."""
    if extractor is None and runner in CONVERTERS:
        return convert(files, runner, version, CONVERTERS[runner])
    f = extractor or EXTRACTORS[runner]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for paper_id, sha, content in zip(part["paper_id"], part["sha256"], part["content"]):
                began, row = time.time(), {"paper_id": paper_id, "runner": runner, "runner_version": version, "pdf_sha256": sha}
                try:
                    r = f(bytes(content), paper_id)
                    blocks = [{**b, "bbox": b.get("bbox"), "order": i} for i, b in enumerate(r["blocks"])]
                    row |= {"pages": int(r["pages"]), "wall_seconds": round(time.time() - began, 3), "blocks": blocks, "tables": r.get("tables") or [], "chunks": pack(blocks), "error": None}
                except Exception as e:
                    row |= {"pages": None, "wall_seconds": None, "blocks": None, "tables": None, "chunks": None, "error": f"{type(e).__name__}: {e}"[:500]}
                out.append(row)
            yield pd.DataFrame(out, columns=["paper_id", "runner", "runner_version", "pdf_sha256", "pages", "wall_seconds", "blocks", "tables", "chunks", "error"])

    return files.select("paper_id", "sha256", "content").mapInPandas(run, RECORD + ", error STRING")


def convert(files: DataFrame, runner: str, version: str, converter: Callable[[bytes, str], dict]) -> DataFrame:
    """``extract`` by a layout model: tasks only make documents, Spark's columns make records of them."""
    from leafmill.session import cut
    from leafmill.sources.files import DOCUMENT, documents_to_records

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for paper_id, sha, content in zip(part["paper_id"], part["sha256"], part["content"]):
                began, document, error = time.time(), None, None
                try:
                    document = json.dumps(converter(bytes(content), paper_id))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                out.append((paper_id, sha, document, round(time.time() - began, 3), error))
            yield pd.DataFrame(out, columns=["paper_id", "pdf_sha256", "document", "seconds", "error"])

    done = cut(files.select("paper_id", "sha256", "content").mapInPandas(run, "paper_id string, pdf_sha256 string, document string, seconds double, error string"))
    good = done.filter("error IS NULL")
    r = documents_to_records(good.select("paper_id", F.from_json("document", DOCUMENT).alias("d")).select("paper_id", "d.*"), runner, version)
    r = r.join(good.select("paper_id", "pdf_sha256", "seconds"), "paper_id").withColumn("wall_seconds", F.col("seconds")).withColumn("error", F.lit(None).cast("string"))
    names_ = [f.name for f in T.DataType.fromDDL(RECORD).fields] + ["error"]
    bad = done.filter("error IS NOT NULL").select("paper_id", F.lit(runner).alias("runner"), F.lit(version).alias("runner_version"), "pdf_sha256", "error")
    return r.select(*names_).unionByName(bad, allowMissingColumns=True)
