"""Defined cases and plans of the core operators that the SQL doesn't reach."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill import session
from leafmill.operators import ask, flatten, lexical, manifest, metrics, records as R, rollup, vectors
from leafmill.streaming.quota import decide
from tests.conftest import block


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "other", "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_sides_are_measured(spark):
    long = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"), F.array(F.struct(F.repeat(F.lit("y"), 5000).alias("u"))).alias("a"))
    assert session.measured(long) > 1_500_000 and session.measured(spark.range(0)) == 0
    assert "broadcast" in session.small_or_shuffled(spark.range(9))._jdf.queryExecution().logical().toString().lower()


def test_deliveries_that_tie_and_records_without_id(records):
    late, early = datetime.datetime(2024, 2, 1), datetime.datetime(2024, 1, 1)
    r = records(
        {"record_id": 1, "runner": "a", "paper_id": "p", "loaded_at": early}, {"record_id": 1, "runner": "a", "paper_id": "p", "loaded_at": early},
        {"record_id": 2, "runner": "a", "paper_id": "p", "run_at": late}, {"record_id": None, "runner": "b", "paper_id": "p"}, {"record_id": 3, "runner": None, "paper_id": "p"},
    )
    assert sorted(str(x.record_id) for x in R.first_deliveries(r).collect()) == ["1", "2", "3", "None"]
    assert [x.record_id for x in R.current_records(r).collect()] == [2]


def test_pages_without_text_are_described(records):
    r = records({"record_id": 1, "runner": "f", "paper_id": "scan", "pages": 3}, {"record_id": 2, "runner": "f", "paper_id": "text", "pages": 1, "blocks": [block("x" * 300)]})
    got = {x.filename: (x.pages, x.chars_text_layer, x.scanned) for x in manifest.describe(R.all_pages(r).withColumnRenamed("paper_id", "filename")).collect()}
    assert got == {"scan": (3, 0, True), "text": (1, 300, False)}


def test_child_rows_come_from_the_levels_found(records, monkeypatch):
    r = records({"record_id": 1, "blocks": [block("a", bbox=[1.0, 2.0, 3.0, 4.0]), block("b", order=1)], "chunks": [(0, "t", [1, 7, None], "s", 1)]}, {"record_id": None, "blocks": [block("c")]})
    got = sorted((str(x.record_id), x.child, x.i, x.j, x.k) for x in flatten.record_child_keys(r).collect())
    assert got == [("1", "bbox", 0, -1, -1), ("1", "block", 0, -1, -1), ("1", "block", 1, -1, -1), ("1", "chunk", 0, -1, -1), ("1", "link", 0, 0, 1), ("None", "block", 0, -1, -1)]
    found = flatten.levels(r.schema)
    monkeypatch.setattr(flatten, "levels", lambda *_: [x for x in found if x.name != "blocks.bbox"])
    assert {x.child for x in flatten.record_child_keys(r).collect()} == {"block", "chunk", "link"}


def test_equal_vectors_keep_the_smallest_keys(spark):
    v = [(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(50, [0.0, 1.0]), (51, [0.0, 0.0])]
    d = spark.createDataFrame(v, "vec_id BIGINT, embedding ARRAY<DOUBLE>").coalesce(1)
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0])], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = sorted((r.query_id, r.rank, r.vec_id) for r in vectors.cosine_topk_many(d, q, 3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(7, 1, 1), (7, 2, 2), (7, 3, 3), (8, 1, 50), (8, 2, 1), (8, 3, 2)]


def test_queries_in_several_blocks_are_ranked_as_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 12))) for i in range(80)] + [(90, None), (91, "")], "doc_id BIGINT, text STRING")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(7)] + [(8, None)], "query_id BIGINT, text STRING")
    key = lambda d: sorted((r.query_id, r.rank, r.doc, round(r.score, 8)) for r in d.collect())
    whole = key(lexical.rank_batches(docs, q, 4))
    monkeypatch.setattr(lexical, "BATCH", 3)
    monkeypatch.setattr(lexical, "DOCS", 5)
    assert key(lexical.rank_batches(docs, q, 4)) == whole and len(whole) == 28
    alone = {r.doc_id: r.score for r in lexical.scores(docs, q.filter("query_id = 0").head().text, ["doc_id"]).collect()}
    assert all(abs(alone[d] - s) < 1e-7 for i, _, d, s in whole if i == 0)


def test_no_day_is_sorted_whole(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, "d1" if i % 9 else "d2", f"v{i % 4}" if i % 3 else "busy", at + datetime.timedelta(minutes=i // 2)) for i in range(200)]
    d = spark.createDataFrame(rows, "request_id BIGINT, day STRING, visitor STRING, at TIMESTAMP")
    got = {r.request_id: r.decision for r in decide(d, 4, 2).collect()}
    want, total, seen = {}, {}, {}
    for i, day, v, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if total.get(day, 0) >= 4:
            want[i] = "day-cap"
        elif seen.get((day, v), 0) >= 2:
            want[i] = "visitor-cap"
        else:
            total[day], seen[day, v], want[i] = total.get(day, 0) + 1, seen.get((day, v), 0) + 1, "allowed"
    assert got == want
    plan = decide(d, 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Window [sum" not in plan
    assert {r.decision for r in decide(d, 0, 2).collect()} == {"day-cap"}


def test_segments_of_a_long_answer(spark):
    text = "a [x] [9] " * 4000 + "[1][2] end [02] [99999999999999999999]"
    ids = F.array(F.lit("c1"), F.lit("c2"))
    got = spark.range(1).select(F.explode(ask.segments(F.lit(text), ids)).alias("s")).select("s.*").collect()
    assert [(g.kind, g.label, g.chunk_id) for g in got] == [("text", None, None), ("citation", 1, "c1"), ("citation", 2, "c2"), ("text", None, None), ("citation", 2, "c2"), ("text", None, None)]
    assert got[0].text == "a [x] [9] " * 4000 and got[-1].text == " [99999999999999999999]"
    assert spark.range(1).select(ask.segments(F.lit(""), ids).alias("s")).head().s == []


def test_the_rollup_reads_the_records_once(records, spark, tmp_path):
    r = records({"record_id": 1, "runner": "pdfplumber", "paper_id": "p", "pages": 1, "wall_seconds": 1.0, "blocks": [block("x" * 80, bbox=[1.0, 2.0, 3.0, 4.0])], "tables": [], "chunks": []})
    r.write.parquet(f"{tmp_path}/r")
    plan = rollup.score(spark.read.parquet(f"{tmp_path}/r"))._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/r" not in plan and rollup.score(spark.read.parquet(f"{tmp_path}/r")).head().chars == 80


def test_grams_are_made_once(records):
    r = records(*[{"record_id": i, "runner": n, "paper_id": "p", "pages": 2, "blocks": [block("The same text.", order=0), block(t, page=2, order=1)]} for i, (n, t) in enumerate((("a", "one"), ("b", "two")))])
    d = metrics.page_agreement(r)
    assert "ArrowEvalPython" not in d._jdf.queryExecution().executedPlan().toString()
    assert {x.page: x.score for x in d.collect()} == {1: 1.0, 2: 0.0}
