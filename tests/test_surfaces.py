"""Extractors and their versions, the command line, incremental extraction, bundles with vectors, search state."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill import cli
from leafmill.operators import ask, bundle, manifest, search
from leafmill.sources import extractors, files, layout
from leafmill.streaming.ingest import ingest


@pytest.fixture()
def fake(monkeypatch):
    """An extractor that knows its calls; "bad" files fail."""
    calls = []

    def run(content, paper_id):
        if content.startswith(b"bad"):
            raise ValueError("no page")
        return {"pages": 1, "blocks": [{"page": 1, "kind": "paragraph", "text": content.decode() + " ran.", "bbox": None}], "tables": []}

    monkeypatch.setitem(extractors.EXTRACTORS, "fake", run)
    monkeypatch.setitem(extractors.VERSIONS, "fake", lambda: "fake==1")
    return calls


def embed(texts):
    return np.array([[len(t), 1.0, 2.0] for t in texts], np.float32)


def corpus(tmp_path, **content):
    folder = tmp_path / "corpus"
    folder.mkdir(exist_ok=True)
    rows = []
    for name, text in content.items():
        (folder / f"{name}.pdf").write_bytes(text)
        rows.append({"filename": f"{name}.pdf", "sha256": hashlib.sha256(text).hexdigest(), "pages": 1, "chars_text_layer": 9, "scanned": False, "doi": None})
    (tmp_path / "m.json").write_text(json.dumps(rows))
    return ["--corpus", str(folder), "--manifest", str(tmp_path / "m.json"), "--results", str(tmp_path / "r")]


def lines(tmp_path, runner="fake"):
    return [json.loads(x) for x in (tmp_path / "r" / f"{runner}.jsonl").read_text().splitlines()]


def test_versions_and_layout_models(spark):
    assert extractors.names() == sorted(extractors.names()) and {"pdfplumber", "pdfjs-node", "docling-default", "docling-tuned"} <= set(extractors.names())
    assert extractors.library_version("pyspark").startswith("pyspark==4") and extractors.library_version("no-such-thing") == "no-such-thing==unknown"
    assert extractors.VERSIONS["docling-tuned"]().startswith("docling==") and "+" in extractors.VERSIONS["docling-tuned"]()
    assert extractors.VERSIONS["pdfjs-node"]() == "pdfjs-dist==unknown"

    def model(content, paper_id):
        if content == b"bad":
            raise RuntimeError("broken")
        return {"pages": {"1": {"page_no": 1, "size": {"width": 10.0, "height": 100.0}}}, "texts": [{"self_ref": "#/texts/0", "label": "text", "text": "It ran.", "prov": [{"page_no": 1, "bbox": {"l": 1.0, "t": 90.0, "r": 5.0, "b": 80.0}}]}], "tables": []}

    d = spark.createDataFrame([("a", "s1", b"good"), ("b", "s2", b"bad")], "paper_id STRING, sha256 STRING, content BINARY")
    got = {r.paper_id: r for r in extractors.convert(d, "docling-default", "9", model).collect()}
    assert got["a"].blocks[0].bbox == [1.0, 10.0, 5.0, 20.0] and got["a"].pdf_sha256 == "s1" and got["a"].chunks[0].text == "It ran." and got["a"].error is None
    assert got["b"].blocks is None and got["b"].error == "RuntimeError: broken"


def test_items_become_lines():
    items = [{"x": 50, "baseline": 88, "width": 10, "height": 10, "text": "right"}, {"x": 5, "baseline": 88.4, "width": 9, "height": 10, "text": " left  side "}, {"x": 5, "baseline": 50, "width": 9, "height": 10, "text": "  "}]
    assert [(x["text"], x["bbox"][0]) for x in layout.lines_of_items(items, 100)] == [("left side right", 5)]


def test_run_keeps_what_is_up_to_date(spark, fake, tmp_path, capsys, monkeypatch):
    where = corpus(tmp_path, b=b"two", a=b"one", c=b"bad file")
    assert cli.main([*where, "run", "fake"]) == 0 and "failed: c: ValueError: no page" in capsys.readouterr().err
    assert [x["paper_id"] for x in lines(tmp_path)] == ["a", "b"] and lines(tmp_path)[0]["runner_version"] == "fake==1"
    made = lines(tmp_path)[0]["blocks"][0]["text"]
    monkeypatch.setitem(extractors.EXTRACTORS, "fake", lambda content, _: {"pages": 1, "blocks": [{"page": 1, "kind": "paragraph", "text": "new", "bbox": None}], "tables": []})
    assert cli.main([*where, "run", "fake"]) == 0
    assert {x["paper_id"]: x["blocks"][0]["text"] for x in lines(tmp_path)} == {"a": made, "b": "two ran.", "c": "new"}  # only c was missing
    monkeypatch.setitem(extractors.VERSIONS, "fake", lambda: "fake==2")
    assert cli.main([*where, "run", "fake", "--limit", "1"]) == 0
    assert [(x["paper_id"], x["runner_version"]) for x in lines(tmp_path)] == [("a", "fake==2"), ("b", "fake==1"), ("c", "fake==1")]  # others stay, in place
    (tmp_path / "corpus" / "a.pdf").write_bytes(b"changed")
    assert cli.main([*where, "run", "fake"]) == 1 and cli.main([*where, "manifest", "verify"]) == 1
    assert cli.main([*where, "run", "nobody"]) == 2


def test_export_search_and_compare(spark, fake, tmp_path, capsys):
    where = corpus(tmp_path, a=b"the reactor", b=b"the long column of water")
    assert cli.main([*where, "run", "fake"]) == 0
    out = str(tmp_path / "bundle")
    assert cli.main([*where, "export", "fake", "--out", out, "--no-embed"]) == 0 and bundle.bundle_vectors(spark, out, "m") is None
    head = json.loads((tmp_path / "bundle" / "manifest.json").read_text())
    assert head["corpus_id"] == "bundle" and head["source_runner"] == "fake" and head["runner_version"] == "fake==1" and head["missing_pdfs"] == []
    assert (tmp_path / "bundle" / "pdfs" / "a.pdf").exists()
    assert cli.main([*where, "export", "fake", "--out", out, "--embedder", "tests.test_surfaces:embed", "--model", "m", "--dim", "3"]) == 0
    got = {r.chunk_id: r.embedding for r in bundle.bundle_vectors(spark, out, "m").collect()}
    assert set(got) == {"a#0", "b#0"} and got["a#0"][0] == pytest.approx(16 / (16**2 + 5) ** 0.5, abs=0.02)
    assert bundle.bundle_vectors(spark, out, "other") is None
    (tmp_path / "bundle" / "vectors.bin").write_bytes(b"short")
    with pytest.warns(UserWarning, match="lexical"):
        assert bundle.bundle_vectors(spark, out, "m") is None
    capsys.readouterr()
    assert cli.main(["search", out, "water column"]) == 0 and "b#0" in capsys.readouterr().out
    assert cli.main([*where, "compare", "--floor", "fake", "--out", str(tmp_path / "R.md")]) == 0 and "fake" in (tmp_path / "R.md").read_text()
    _, papers, _, _ = bundle.load_bundle(spark, out)
    assert {r.filename: r.missing for r in bundle.missing_flags(papers, ["b.pdf"]).collect()} == {"a.pdf": False, "b.pdf": True}


def test_import_reports_what_is_missing(spark, tmp_path, capsys):
    where = corpus(tmp_path, a=b"x", b=b"y")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps({"pages": {}, "texts": [{"self_ref": "#", "label": "text", "text": "t", "prov": [{"page_no": 1}]}], "tables": []}))
    assert cli.main([*where, "import-baseline", str(tmp_path / "docs")]) == 1 and "missing: b" in capsys.readouterr().err
    assert [x["paper_id"] for x in lines(tmp_path, "docling-default")] == ["a"]


def test_ingest_extracts_new_files_once(spark, fake, tmp_path):
    corpus(tmp_path, a=b"one", b=b"bad one")
    go = lambda: ingest(spark, str(tmp_path / "corpus"), str(tmp_path / "out"), "fake", "1", str(tmp_path / "cp")).awaitTermination()
    go()
    (tmp_path / "corpus" / "c.pdf").write_bytes(b"three")
    (tmp_path / "corpus" / "a2.PDF").write_bytes(b"four")
    go()
    assert sorted(r.paper_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "a2", "c"]


def test_the_query_model_is_loaded_once_and_tried_again(spark):
    tries = []

    def load():
        tries.append(1)
        if len(tries) == 1:
            raise OSError("offline")
        return lambda texts: [[3.0, 4.0]]

    q = search.QueryEmbedder(load)
    with pytest.raises(OSError):
        q(spark, "x")
    assert q(spark, "x").head().embedding == [0.6, 0.8] and q(spark, "y").count() == 1 and len(tries) == 2


def test_an_index_is_made_once_for_each_bundle(spark):
    c = spark.createDataFrame([("a#0", "two words"), ("a#1", None)], "id STRING, text STRING")
    cache = search.IndexCache()
    assert cache(c)[0] is cache(c)[0] and cache(c)[0].count() == 2 and cache(c.filter("id = 'a#1'"))[0].count() == 0


def test_entries_and_replies(spark):
    m = spark.createDataFrame([("a.pdf",)], "filename STRING")
    assert manifest.entry(m, "a.pdf").count() == 1
    with pytest.raises(KeyError):
        manifest.entry(m, "b.pdf")
    rows = [(403, "allowed", None, 403), (None, "day-cap", None, 429), (None, "allowed", "rate-limit", 429), (None, "allowed", "auth", 500), (None, "allowed", "timeout", 502), (None, "allowed", None, 200)]
    d = spark.createDataFrame(rows, "g INT, q STRING, f STRING, want INT")
    assert all(r.got == r.want for r in d.withColumn("got", ask.reply_status(F.col("g"), F.col("q"), F.col("f"))).collect())


def test_results_files_keep_their_last_lines(spark, tmp_path):
    (tmp_path / "r").mkdir()
    rec = {"paper_id": "p", "runner": "x", "runner_version": "1", "pdf_sha256": "s", "pages": 1, "wall_seconds": 0.0, "blocks": [], "tables": [], "chunks": []}
    (tmp_path / "r" / "x.jsonl").write_text("\n".join(json.dumps(dict(rec, pages=n)) for n in (1, 2)) + "\n\n")
    assert files.runners(spark, str(tmp_path / "r")) == ["x"] and [r.pages for r in files.read_results(spark, str(tmp_path / "r")).collect()] == [2]
