"""Operators of the engine on fixtures with known answers, and against loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import ask, bundle, lexical, manifest, metrics, records as R, rollup, structure as S, vectors as V
from leafmill.sources import extractors, files, layout
from leafmill.sources.vectors import read_vectors, write_vectors
from leafmill.streaming import quota
from tests.conftest import block

GOOD = {
    "record_id": 1, "paper_id": "p", "runner": "pdfplumber", "runner_version": "1", "pdf_sha256": "s", "pages": 2, "wall_seconds": 1.0,
    "blocks": [block("Results", "section_header", 1, 0, [0.0, 0.0, 9.0, 9.0]), block("Some words here that are long enough to count as a page of text.", "paragraph", 1, 1, [0.0, 10.0, 9.0, 19.0]), block("", "table", 2, 2)],
    "tables": [(2, 4, 3, [["k", "a", "b"], ["x", "10", "1.5"], ["y", "15", "2.5"], ["Total", "25", "4.0"]], None)],
    "chunks": [(0, "Some words", [1], "Results", 10)],
}


def one(spark, column, *values, kind="STRING"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"t {kind}").select(column(F.col("t"))).collect()]


def test_parse_number(spark):
    given_ = ["1,234", "(12.5)", "−3", "45%", "n/a", "", None, "1 000", "(-5)", "5d", "0x1p3", "1e3", ".5", "-", ".", "1_0", "inf"]
    assert one(spark, X.parse_number, *given_) == [1234, -12.5, -3, 45, None, None, None, 1000, 5, None, None, 1000, 0.5, None, None, 10, math.inf]


def test_classify(spark):
    texts = ["", "  ", "Fig. 3 shows", "Table 12. x", "2.1 Reactor design", "3 samples were taken", "RESULTS", "Methods:", "A plain line of text", "1. This one is a long sentence, with more than eight words in it.", None]
    assert one(spark, X.classify, *texts) == ["other", "other", "caption", "caption", "section_header", "section_header", "section_header", "section_header", "paragraph", "paragraph", "other"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["Fig. 1 a", "Methods", "plain text here", "3.2 Setup", "ALL CAPS", "Ünïcode Größe", "é 1. x", ""]), min_size=1, max_size=4))
def test_worker_classifier_agrees(spark, parts):
    text = " ".join(parts)
    assert one(spark, X.classify, text) == [layout.kind_of(text)]


def test_words_to_lines_rounds_half_to_even(spark):
    w = spark.createDataFrame([("d", 1, 0, 30.0, 11.0, 40.0, 20.0, "b"), ("d", 1, 1, 0.0, 12.0, 9.0, 21.0, "a"), ("d", 1, 2, 0.0, 13.0, 9.0, 22.0, "c")], "doc STRING, page INT, seq INT, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE, text STRING")
    rows = S.words_to_lines(w, ["doc"]).orderBy("line").collect()
    assert [(r.line, r.text, r.bbox) for r in rows] == [(0, "a c b", [0.0, 11.0, 40.0, 22.0])]


def test_items_to_lines(spark):
    i = spark.createDataFrame([("d", 1, 0, 5.0, 90.0, 10.0, 8.0, 100.0, "two"), ("d", 1, 1, 0.0, 90.0, 4.0, 8.0, 100.0, "one "), ("d", 1, 2, 0.0, 50.0, 4.0, 8.0, 100.0, "  ")], "doc STRING, page INT, seq INT, x DOUBLE, baseline DOUBLE, width DOUBLE, height DOUBLE, page_height DOUBLE, text STRING")
    r = S.items_to_lines(i, ["doc"]).collect()
    assert [(x.text, x.bbox) for x in r] == [("one two", [0.0, 2.0, 15.0, 10.0])]


def test_group_and_join_lines(spark):
    rows = [("d", 1, 0, "long-", [0.0, 0.0, 9.0, 10.0]), ("d", 1, 1, "wrapped text", [0.0, 12.0, 9.0, 22.0]), ("d", 1, 2, "after a gap", [0.0, 50.0, 9.0, 60.0]), ("d", 1, 3, " ", None), ("d", 1, 4, "RESULTS", None)]
    g = S.group_lines(spark.createDataFrame(rows, "doc STRING, page INT, line INT, text STRING, bbox ARRAY<DOUBLE>"), ["doc"]).orderBy("block").collect()
    assert [(x.kind, x.text) for x in g] == [("paragraph", "longwrapped text"), ("paragraph", "after a gap"), ("section_header", "RESULTS")]
    assert g[0].bbox == [0.0, 0.0, 9.0, 22.0] and g[2].bbox is None


def test_flip_bbox_is_an_involution(spark):
    d = spark.createDataFrame([((1.0, 90.0, 5.0, 80.0, None), 100.0), ((1.0, 10.0, 5.0, 20.0, "TOPLEFT"), 100.0), ((1.0, 90.0, 5.0, 80.0, None), None), (None, 100.0)], "b STRUCT<l: DOUBLE, t: DOUBLE, r: DOUBLE, b: DOUBLE, coord_origin: STRING>, h DOUBLE")
    assert [r[0] for r in d.select(S.flip_bbox(F.col("b"), F.col("h"))).collect()] == [[1.0, 10.0, 5.0, 20.0], [1.0, 10.0, 5.0, 20.0], None, None]


def test_pack_respects_budget_and_sections():
    bs = [{"kind": k, "text": t, "order": i} for i, (k, t) in enumerate([("paragraph", "One. Two. Three."), ("section_header", "Methods"), ("table", "x"), ("caption", "Four."), ("section_header", " "), ("other", "Five.")])]
    c = S.pack(bs, 10)
    assert [(x["text"], x["section"], x["block_ids"]) for x in c] == [("One. Two.", "(front matter)", [0]), ("Three.", "(front matter)", [0]), ("Four.", "Methods", [3]), ("Five.", "Methods", [5])]
    assert S.pack(None) == [] and S.pack([{"kind": "paragraph", "text": "x" * 3000, "order": 0}])[0]["chars"] == 3000


def test_validation_order(records):
    bad = [dict(GOOD), dict(GOOD, pages=0), dict(GOOD, blocks=[block("t", "odd")]), dict(GOOD, blocks=[block("t", order=1), block("t", order=0)]), dict(GOOD, tables=[(1, 2, 1, [["a"]], None)]), dict(GOOD, chunks=[(0, "abc", [0], "s", 4)]), dict(GOOD, chunks=[(0, "abc", [9], "s", 3)]), dict(GOOD, paper_id=None)]
    r = records(*[dict(b, record_id=i) for i, b in enumerate(bad)])
    assert [x[0] for x in r.orderBy("record_id").select(R.violation()).collect()] == [None, "pages", "block kind", "blocks not sorted", "table rows", "chunk text", "chunk block ids", "field"]


def test_content_hash_ignores_timing(records):
    r = records(GOOD, dict(GOOD, record_id=2, wall_seconds=9.0), dict(GOOD, record_id=3, pages=3))
    h = [x[0] for x in r.orderBy("record_id").select(R.content_hash(r)).collect()]
    assert h[0] == h[1] != h[2]


def test_arithmetic(records):
    bad = dict(GOOD, record_id=2, paper_id="q", tables=[(2, 4, 3, [["k", "a", "b"], ["x", "10", "1.5"], ["y", "15", "2.5"], ["Total", "26", "4.0"]], None)])
    cols = dict(GOOD, record_id=3, paper_id="r", tables=[(1, 3, 4, [["k", "a", "b", "Total"], ["x", "1", "2", "3"], ["y", "1", "2", "4"]], None), (1, 2, 2, [["k", "Total biomass (g/L)"], ["x", "5"]], None)])
    got = {r.paper_id: r for r in metrics.table_arithmetic(records(GOOD, bad, cols)).collect()}
    assert [(got[p].checked, got[p].passed) for p in "pqr"] == [(2, 2), (2, 1), (2, 1)]
    assert got["q"].failures[0].summed == 25 and got["r"].failures[0].axis == "col" and got["p"].pass_rate == 1.0


def test_metrics_are_null_without_evidence(records):
    r = records({"record_id": 1, "paper_id": "p", "runner": "pdfplumber", "pages": 1, "wall_seconds": 0.0})
    assert metrics.reading_order(r).head().monotonic_fraction is None
    t, c, g = metrics.table_structure(r).head(), metrics.chunk_health(r).head(), metrics.column_interleaving(r).head()
    assert t.tables == 0 and t.empty_cell_ratio is None and c.chunks == 0 and c.median_chars is None and g.ratio is None
    assert metrics.coverage(r).head().median_ratio is None and rollup.score(r).head().seconds_per_page is None


def test_coverage_and_agreement_with_itself(records):
    r = records(GOOD, dict(GOOD, record_id=2, runner="other"))
    assert {x.median_ratio for x in metrics.coverage(r).collect()} == {1.0}
    a = metrics.agreement(r).collect()
    assert len(a) == 1 and a[0].median == 1.0 and (a[0].left_runner, a[0].right_runner) == ("other", "pdfplumber")


def test_chunk_health_straddles(records):
    r = records(dict(GOOD, blocks=[block("a", order=0), block("H", "section_header", 1, 1), block("b", order=2)], chunks=[(0, "low", [0, 2], "s", 3), (1, "Up", [0], "s", 120)]))
    c = metrics.chunk_health(r).head()
    assert (c.straddling_chunks, c.orphan_chunks, c.midsentence_starts, c.median_chars) == (1, 1, 1, 61.5)


def test_current_records_take_the_last_run(records):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    r = records(dict(GOOD, record_id=1, run_at=day(1)), dict(GOOD, record_id=2, run_at=day(2), loaded_at=day(3)), dict(GOOD, record_id=2, run_at=day(2), loaded_at=day(4)))
    assert [x.record_id for x in R.current_records(r).collect()] == [2]
    assert R.first_deliveries(r).count() == 2


def test_report_keeps_findings(records, tmp_path):
    f = tmp_path / "r.md"
    f.write_text("old\n\n## Findings\n\nkept *as is*\n")
    text = rollup.write_report(records(GOOD), str(f))
    assert text.endswith("## Findings\n\nkept *as is*\n") and "old" not in text and text.count("| `pdfplumber` |") == 1


def test_manifest(spark, tmp_path):
    for n, c in (("a.pdf", b"one"), ("B.PDF", b"two"), ("c.txt", b"x")):
        (tmp_path / n).write_bytes(c)
    disk = manifest.scan_corpus(spark, str(tmp_path))
    assert {r.filename for r in disk.collect()} == {"a.pdf", "B.PDF"}
    import hashlib

    m = spark.createDataFrame([("a.pdf", hashlib.sha256(b"one").hexdigest()), ("B.PDF", "no"), ("gone.pdf", "x")], "filename STRING, sha256 STRING")
    assert {tuple(r) for r in manifest.diff(m, disk).collect()} == {("B.PDF", "changed"), ("gone.pdf", "missing")}
    assert {tuple(r) for r in manifest.diff(m.limit(0), disk).collect()} == {("B.PDF", "extra"), ("a.pdf", "extra")}


def test_bm25_against_a_loop(spark):
    docs = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry date apple"), (4, ""), (5, None)]
    d = spark.createDataFrame(docs, "doc INT, text STRING")
    toks = {i: lexical.query_terms(t or "") for i, t in docs}
    mean = sum(map(len, toks.values())) / len(docs)

    def score(i, q):
        s = 0.0
        for w in lexical.query_terms(q):
            df, tf = sum(w in t for t in toks.values()), toks[i].count(w)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean))
        return s

    for q in ("apple cherry", "apple apple", "x", "zebra", "Banana!"):
        want = sorted(((i, score(i, q)) for i in toks if score(i, q) > 0), key=lambda x: -x[1])
        got = [(r.doc, r.score) for r in lexical.rank(d, q, 10, ["doc"]).orderBy("rank").collect()]
        assert [g[0] for g in got] == [w[0] for w in want] or len({round(w[1], 9) for w in want}) < len(want)
        assert got == [(i, pytest.approx(score(i, q))) for i, _ in got]
    p, n = lexical.index(d.filter("text IS NOT NULL"), key="doc")
    many = lexical.rank_many(p, n, spark.createDataFrame([(7, "apple cherry")], "query_id BIGINT, text STRING"), 1).collect()
    assert [(r.query_id, r["rank"]) for r in many] == [(7, 1)]


def test_batches_rank_like_single_queries(spark, monkeypatch):
    import random

    r = random.Random(5)
    docs = [(i, " ".join(r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(60, None)]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    q = [(7, "alpha beta"), (8, "zeta zeta delta"), (9, "nothing"), (10, "")]
    want = {(i, x["rank"], x.doc_id, round(x.score, 9)) for i, t in q for x in lexical.rank(d, t, 5, ["doc_id"]).collect()}
    monkeypatch.setattr(lexical, "BATCH", 2)
    got = {(x.query_id, x["rank"], x.doc, round(x.score, 9)) for x in lexical.rank_batches(d, spark.createDataFrame(q, "query_id BIGINT, text STRING"), 5).collect()}
    assert got == want
    assert lexical.rank_batches(d, spark.createDataFrame(q, "query_id BIGINT, text STRING").limit(0), 5).count() == 0
    assert lexical.rank_batches(d.limit(0), spark.createDataFrame(q[:1], "query_id BIGINT, text STRING"), 5).count() == 0


def test_gram_codes_are_the_grams(spark):
    texts = ["Hello, World 42!", "ab", "", None, "zzz zzz", "日本 abc"]
    a = one(spark, lambda c: F.size(X.grams(c)), *texts)
    b = one(spark, lambda c: F.size(metrics._gram_codes(X.level(c))), *texts)
    assert [x or 0 for x in a] == b


def test_scope_keeps_statistics(spark):
    d = spark.createDataFrame([(1, "a1", "apple pear"), (2, "b1", "apple apple")], "doc INT, p STRING, text STRING")
    whole = {r.doc: r.score for r in lexical.rank(d, "apple", 5, ["doc", "p"]).collect()}
    assert {r.doc: r.score for r in lexical.rank(d, "apple", 5, ["doc", "p"], scope=F.col("p") == "a1").collect()} == {1: whole[1]}


def test_vectors_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(64, 48)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(64, [0.0] * 48)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    e = V.quantization_error(d.filter("vec_id < 64")).head()
    assert e.mean_error < 1e-3 and e.worst_cosine > 0.99
    (tmp_path / "manifest.json").write_text('{"files": {}}')
    out = write_vectors(d, str(tmp_path), "m")
    back = {r.row: np.array(r.embedding) for r in read_vectors(spark, str(tmp_path / "vectors.bin"), out["count"], out["dim"]).collect()}
    assert out["bytes"] == 65 * 4 + 65 * 48 and all(back[i] @ x[i] / np.linalg.norm(x[i]) > 0.99 for i in range(64)) and not back[64].any()
    with pytest.raises(Exception):
        read_vectors(spark, str(tmp_path / "vectors.bin"), 3, 48).collect()


def test_cosine(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-3.0, 0.0]), (3, [5.0, 0.0]), (4, [0.0, 0.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = [(r.vec_id, round(r.score, 6)) for r in V.cosine_topk(d, d.filter("vec_id = 0"), 9).orderBy("rank").collect()]
    assert got == [(0, 1.0), (3, 1.0), (1, 0.0), (4, 0.0), (2, -1.0)]
    many = V.cosine_topk_many(d, d.filter("vec_id < 2").withColumnRenamed("vec_id", "query_id"), 2)
    assert sorted((r.query_id, r.vec_id) for r in many.collect()) == [(0, 0), (0, 3), (1, 0), (1, 1)]
    assert V.cosine_topk_many(d, d.limit(0).withColumnRenamed("vec_id", "query_id"), 2).count() == 0


def test_embed_checks_the_shape(spark):
    d = spark.createDataFrame([("a",), (None,)], "t STRING")
    ok = V.embed(d, "t", lambda ts: np.array([[len(t), 1.0] for t in ts]), 2).collect()
    assert ok[1].embedding == [0.0, 1.0]
    with pytest.raises(Exception):
        V.embed(d, "t", lambda ts: np.zeros((len(ts), 3)), 2).collect()


def test_search_and_ask(spark):
    from leafmill.operators import search as Q

    c = spark.createDataFrame([("p#0", "p", None, "apple pear"), ("q#0", "q", "Results", "apple apple plum"), ("q#1", "q", "Results", "fig")], "id STRING, paper_id STRING, section STRING, text STRING")
    v = spark.createDataFrame([("p#0", [1.0, 0.0]), ("q#0", [0.0, 1.0]), ("q#1", [0.6, 0.8])], "chunk_id STRING, embedding ARRAY<FLOAT>")
    assert [r.chunk_id for r in Q.search(c, "apple", "lexical").orderBy("rank").collect()] == ["q#0", "p#0"]
    assert [r.chunk_id for r in Q.search(c, "x", "semantic", 2, v, v.limit(1)).orderBy("rank").collect()] == ["p#0", "q#1"]
    assert Q.search(c, "  ", "semantic").count() == 0
    for bad in ("semantic", "both"):
        with pytest.raises(ValueError):
            Q.search(c, "x", bad)
    passages, messages = Q.ask_prompt(c, "apple", "p")
    assert [p.chunk_id for p in passages.collect()] == ["p#0"] and "[1] p — no section\napple pear" in messages.head().user
    assert Q.ask_prompt(c, "zebra")[1].count() == 0
    assert spark.range(1).select(Q.url_path(F.lit("a b"), F.lit("c"))).head()[0] == "a%20b/c"


def test_compare_rankings(spark):
    mk = lambda ids: spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id INT, rank INT")
    assert tuple(V.compare_rankings(mk([3, 1, 2]), mk([9, 1]), "id").head()) == (1, [3, 2], [9])


def test_bundle(records, spark, tmp_path):
    r = records(dict(GOOD, blocks=[block("a", order=0, page=2, bbox=[1.0, 1.0, 2.0, 2.0]), block("b", order=1, page=1, bbox=[3.0, 3.0, 4.0, 4.0]), block("c", order=2)], chunks=[(0, "Text of one", [0, 1, 2, 9], "s", 11)]))
    c = bundle.bundle_chunks(r).head()
    assert c.id == "p#0" and [(x.page, x.rects) for x in c.regions] == [(1, [[3.0, 3.0, 4.0, 4.0]]), (2, [[1.0, 1.0, 2.0, 2.0]])]
    m = spark.createDataFrame([("p.pdf", "s", 2), ("q.pdf", "t", 1)], "filename STRING, sha256 STRING, pages INT")
    head = bundle.write_bundle(r, m, str(tmp_path / "b"))
    assert head["counts"] == {"papers": 1, "chunks": 1} and head["missing_pdfs"] == ["p.pdf"]
    _, papers, chunks, status = bundle.load_bundle(spark, str(tmp_path / "b"))
    assert papers.count() == 1 and chunks.head().regions[1].page == 2 and status == "no-vectors"


def test_citations_and_segments(spark):
    d = spark.createDataFrame([("see [2] and [1][2], not [7] or [0]", ["a", "b"]), ("", ["a"]), (None, ["a"])], "t STRING, ids ARRAY<STRING>")
    rows = d.select(ask.cited(F.col("t"), F.col("ids")).alias("c"), ask.segments(F.col("t"), F.col("ids")).alias("s")).collect()
    assert rows[0].c == ["b", "a"] and rows[1].c == []
    assert [(s.kind, s.text or s.chunk_id) for s in rows[0].s] == [("text", "see "), ("citation", "b"), ("text", " and "), ("citation", "a"), ("citation", "b"), ("text", ", not [7] or [0]")]


def quota_loop(rows, per_day, per_visitor):
    days, visitors, out = {}, {}, {}
    for rid, day, v, at in sorted(rows, key=lambda r: (r[3], r[0])):
        if days.get(day, 0) >= per_day:
            out[rid] = "day-cap"
        elif visitors.get((day, v), 0) >= per_visitor:
            out[rid] = "visitor-cap"
        else:
            days[day], visitors[day, v] = days.get(day, 0) + 1, visitors.get((day, v), 0) + 1
            out[rid] = "allowed"
    return out


def _requests(seed, n=60):
    import datetime

    rng = np.random.default_rng(seed)
    return [(i, f"2024-01-0{rng.integers(1, 4)}", f"v{rng.integers(0, 5)}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(rng.integers(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_quota_against_a_loop(spark, seed):
    rows = _requests(seed)
    d = spark.createDataFrame(rows, "request_id BIGINT, day STRING, visitor STRING, at TIMESTAMP")
    assert {r.request_id: r.decision for r in quota.decide(d, 6, 2).collect()} == quota_loop(rows, 6, 2)


def test_quota_stream(spark, tmp_path):
    rows = _requests(9)
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "request_id BIGINT, day STRING, visitor STRING, at TIMESTAMP").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("request_id BIGINT, day STRING, visitor STRING, at TIMESTAMP").parquet(src)
    q = quota.decide_stream(s, 6, 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.request_id: r.decision for r in spark.read.parquet(str(tmp_path / "out")).collect()} == quota_loop(rows, 6, 2)


def test_results_files(spark, records, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"paper_id":"p","pages":1}\n\n{"paper_id":"q","pages":1}\n{"paper_id":"p","pages":3}\n')
    assert sorted((r.runner, r.paper_id, r.pages) for r in files.read_results(spark, str(tmp_path)).collect()) == [("x", "p", 3), ("x", "q", 1)]
    assert files.runners(spark, str(tmp_path)) == ["x"]


def test_layout_documents(spark, tmp_path):
    import json

    box = {"l": 10, "t": 190, "r": 90, "b": 180}
    doc = {
        "pages": {"1": {"page_no": 1, "size": {"width": 200, "height": 200}}},
        "texts": [{"self_ref": "#/texts/0", "label": "section_header", "text": "Methods", "prov": [{"page_no": 1, "bbox": box}]}, {"self_ref": "#/texts/1", "label": "text", "text": " ", "prov": []}, {"self_ref": "#/texts/2", "label": "caption", "text": "Table 1. Things", "prov": [{"page_no": 1}]}],
        "tables": [{"self_ref": "#/tables/0", "captions": [{"$ref": "#/no"}, {"$ref": "#/texts/2"}], "prov": [{"page_no": 1, "bbox": box}], "data": {"num_rows": 2, "num_cols": 2, "grid": [], "table_cells": [{"text": "a", "start_row_offset_idx": 0, "start_col_offset_idx": 0, "end_row_offset_idx": 1, "end_col_offset_idx": 1}, {"text": "z", "start_row_offset_idx": 1, "start_col_offset_idx": 1, "end_row_offset_idx": 2, "end_col_offset_idx": 2}, {"text": "out", "start_row_offset_idx": 9, "start_col_offset_idx": 0, "end_row_offset_idx": 10, "end_col_offset_idx": 1}]}}],
    }
    (tmp_path / "p.json").write_text(json.dumps(doc))
    (tmp_path / "q.json").write_text(json.dumps({"pages": [{"page_no": 2, "size": {"height": 100}}], "texts": [], "tables": []}))
    got = {r.paper_id: r for r in files.documents_to_records(files.read_documents(spark, f"{tmp_path}/*.json")).collect()}
    p = got["p"]
    assert [(b.kind, b.text, b.bbox) for b in p.blocks] == [("section_header", "Methods", [10.0, 10.0, 90.0, 20.0]), ("caption", "Table 1. Things", None), ("table", "", [10.0, 10.0, 90.0, 20.0])]
    assert p.tables[0].cells == [["a", ""], ["", "z"]] and p.tables[0].caption == "Table 1. Things" and (p.pages, got["q"].pages) == (1, 2)
    assert [c.section for c in p.chunks] == ["Methods"]


def test_extraction_isolates_failures(spark):
    def fake(content, paper_id):
        if content == b"bad":
            raise ValueError("broken")
        return {"pages": 1, "blocks": [{"page": 1, "kind": "paragraph", "text": "Hi. There.", "bbox": None}], "tables": []}

    d = spark.createDataFrame([("a", "s", bytearray(b"ok")), ("b", "t", bytearray(b"bad"))], "paper_id STRING, sha256 STRING, content BINARY")
    got = {r.paper_id: r for r in extractors.extract(d, "fake", "1", fake).collect()}
    assert got["a"].chunks[0].text == "Hi. There." and got["a"].error is None and got["b"].error == "ValueError: broken"


def test_work_list_and_upsert(spark):
    corpus = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "paper_id STRING, sha256 STRING")
    done = spark.createDataFrame([("a", "1", "v1"), ("b", "old", "v1"), ("c", "3", "v0")], "paper_id STRING, pdf_sha256 STRING, runner_version STRING")
    names = lambda d: sorted(r.paper_id for r in d.collect())
    assert names(manifest.work_list(corpus, done, "v1")) == ["b", "c"] and names(manifest.work_list(corpus, done, "v1", force=True)) == ["a", "b", "c"] and names(manifest.work_list(corpus, done, "v9", limit=1)) == ["a"]
    assert sorted(map(tuple, manifest.upsert(corpus, spark.createDataFrame([("a", "9")], corpus.schema), ["paper_id"]).collect())) == [("a", "9"), ("b", "2"), ("c", "3")]


def test_rect_style(spark):
    d = spark.createDataFrame([([5.0, 8.0, 1.0, 2.0],)], "b ARRAY<DOUBLE>").select(bundle.rect_style(F.col("b"), F.lit(2.0)).alias("s")).head().s
    assert tuple(d) == (2.0, 4.0, 8.0, 12.0)
