"""The shapes of the data: extraction records, manifest entries, bundles and hits."""

from __future__ import annotations

BLOCK = "STRUCT<page: INT, kind: STRING, text: STRING, bbox: ARRAY<DOUBLE>, `order`: INT>"
TABLE = "STRUCT<page: INT, `rows`: INT, cols: INT, cells: ARRAY<ARRAY<STRING>>, caption: STRING>"
CHUNK = "STRUCT<id: INT, text: STRING, block_ids: ARRAY<INT>, section: STRING, chars: INT>"

RECORD = (
    "paper_id STRING, runner STRING, runner_version STRING, pdf_sha256 STRING, pages INT, wall_seconds DOUBLE, "
    f"blocks ARRAY<{BLOCK}>, tables ARRAY<{TABLE}>, chunks ARRAY<{CHUNK}>"
)
MANIFEST = "filename STRING, sha256 STRING, pages INT, chars_text_layer BIGINT, scanned BOOLEAN, doi STRING"
REGION = "STRUCT<page: INT, rects: ARRAY<ARRAY<DOUBLE>>>"
BUNDLE_PAPER = "paper_id STRING, filename STRING, pages INT, sha256 STRING"
BUNDLE_CHUNK = f"id STRING, paper_id STRING, section STRING, text STRING, chars INT, regions ARRAY<{REGION}>"
BUNDLE_MANIFEST = (
    "corpus_id STRING, name STRING, built_at STRING, source_runner STRING, runner_version STRING, embed_model STRING, dim INT, counts STRUCT<papers: INT, chunks: INT>, "
    "files MAP<STRING, STRING>, missing_pdfs ARRAY<STRING>"
)

BLOCK_KINDS = ("paragraph", "section_header", "caption", "table", "other")
TEXT_KINDS = ("paragraph", "section_header", "caption", "other")
CHUNKABLE_KINDS = ("paragraph", "caption", "other")
#: The extractor every coverage is measured against.
FLOOR_RUNNER = "pdfplumber"
