"""Retrieval, bundle, asking and quota queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.operators import ask as A, bundle as B, lexical as L, records as R, vectors as V
from leafmill.operators.search import both_rankings
from leafmill.plans.metric_queries import CURRENT
from leafmill.session import table
from leafmill.streaming.quota import decide

QUERY = "light attenuation in the granular reactor light"
K = 10
#: Every row whose id this divides is a query against all rows.
QUERY_STEP = 20
RUNNER = "docling-default"


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.current_records(table(spark, sf_dir, "ir_records")).filter(F.col("runner") == RUNNER)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _bundle(spark, sf_dir).select("paper_id", F.explode("chunks").alias("c"))
    return c.select(F.concat_ws("#", "paper_id", F.col("c.id").cast("string")).alias("id"), "paper_id", F.col("c.id").alias("n"), "c.section", "c.text")


def bundle_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bundle_papers(_bundle(spark, sf_dir), table(spark, sf_dir, "corpus_manifest"))


def chunk_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.bundle_chunks(_bundle(spark, sf_dir)).select("id", F.inline("regions"))
    return c.select("id", "page", "rects")


def papers_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chunks_per_paper(_chunks(spark, sf_dir))


def longest_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.longest_chunks(B.bundle_chunks(_bundle(spark, sf_dir))).select("paper_id", "id", "chars", F.col("region.page").alias("page"))


def rect_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block rectangles at the scale of a page 800 wide."""
    b = R.blocks(_bundle(spark, sf_dir)).filter(F.size("bbox") == 4)
    scale = B.page_scale(F.lit(800.0), F.lit(612.0))
    return b.select("paper_id", F.col("order").alias("block"), B.rect_style(F.col("bbox"), scale).alias("s")).select("paper_id", "block", "s.*")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rank(_chunks(spark, sf_dir), QUERY, K, ["paper_id", "n"]).select("rank", "paper_id", "n", "score")


def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents for one query."""
    return L.scores(table(spark, sf_dir, "documents"), QUERY, ["doc_id"])


def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, _ = L.index(table(spark, sf_dir, "documents"), key="doc_id")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for the questions of every 20th request."""
    docs = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "ask_requests").filter((F.col("request_id") % QUERY_STEP == 0) & F.col("question").isNotNull())
    q = q.select(F.col("request_id").alias("query_id"), F.col("question").alias("text")).distinct()
    return L.rank_batches(docs, q, 3).select("query_id", "rank", "doc", F.round("score", 9).alias("score"))


def scope_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks inside papers of one first letter; the statistics are the whole bundle's."""
    return L.rank(_chunks(spark, sf_dir), QUERY, K, ["paper_id", "n"], scope=F.col("paper_id").startswith("S")).select("rank", "paper_id", "n", "score")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks with their sections and snippets."""
    h = bm25_topk(spark, sf_dir).select("rank", F.concat_ws("#", "paper_id", F.col("n").cast("string")).alias("chunk_id"))
    return B.hit_rows(h, _chunks(spark, sf_dir)).select("rank", "chunk_id", "section", "snippet")


def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.scale(F.col("embedding")).cast("double").alias("scale"), F.transform(V.quantize(F.col("embedding")), lambda q: q.cast("int")).alias("codes"))


def quantization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quantization_error(table(spark, sf_dir, "embeddings"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return V.cosine_topk(e, e.filter("vec_id = 0"), K).select("rank", "vec_id", F.round("score", 9).alias("score"))


def cosine_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.cosine_topk_many(e, q, K).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def compare_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors to vector 0 against the best documents for the query; ids of equal value stand for each other."""
    e = table(spark, sf_dir, "embeddings")
    semantic = V.cosine_topk(e, e.filter("vec_id = 0"), 100).select(F.col("vec_id").alias("id"), "rank")
    lexical = L.rank(table(spark, sf_dir, "documents"), QUERY, 100, ["doc_id"]).select(F.col("doc_id").alias("id"), "rank")
    return V.compare_rankings(semantic, lexical, "id")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings side by side; documents and vectors of one id stand for each other."""
    d = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "text")
    e = table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), "embedding", "vec_id")
    h = both_rankings(d, QUERY, K, e.drop("vec_id"), e.filter("vec_id = 0"))
    return h.select("mode", "rank", "chunk_id", F.round("score", 9).alias("score"))


def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = L.rank(_chunks(spark, sf_dir), QUERY, A.SENT_PASSAGES, ["paper_id", "n"])
    h = h.join(_chunks(spark, sf_dir), ["paper_id", "n"]).select("rank", "paper_id", "section", "text")
    return A.prompt(h, QUERY)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: their whole texts with markers that can and can't be resolved."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    answer = F.concat("text", F.lit(" [1] and [3][1] but [9], [0] or ["), (F.col("doc_id") % 6).cast("string"), F.lit("] end"))
    return d.select("doc_id", answer.alias("answer"), F.array(*[F.lit(f"c{i}") for i in range(1, 5)]).alias("ids"))


def cited_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", A.cited(F.col("answer"), F.col("ids")).alias("cited"))


def answer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).select("doc_id", F.posexplode(A.segments(F.col("answer"), F.col("ids"))).alias("n", "s"))
    return a.select("doc_id", "n", "s.*")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "ask_requests")
    return r.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in r.columns if c != "request_id"]), "received_at").alias("r")).select("request_id", "r.*")


def ask_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of each request, its log fields read as a request."""
    r = _requests(spark, sf_dir)
    fields = {
        "method": F.when(F.col("request_id") % 13 == 0, "OPTIONS").when(F.col("request_id") % 17 == 0, "GET").otherwise("POST"),
        "origin": F.when(F.col("request_id") % 19 == 0, None).otherwise("https://reader"),
        "path": F.when(F.col("request_id") % 23 == 0, "/other").otherwise("/ask"),
        "body_ok": F.col("request_id") % 29 != 0,
        "question": F.col("question"),
        "passages": F.when(F.col("request_id") % 31 != 0, 12),
        "model_ok": F.col("request_id") % 37 != 0,
        "has_key": F.col("request_id") % 41 != 0,
    }
    capped = F.col("outcome").isin("day-cap", "visitor-cap")
    failed = F.when(~capped & (F.col("outcome") != "answered"), F.col("outcome"))
    return r.select("request_id", A.reply_status(A.gate(fields, "https://reader"), F.when(capped, F.col("outcome")).otherwise("allowed"), failed).alias("status"))


def ask_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir)
    kind = A.error_kind(F.lit("https://ask"), F.col("request_id") % 11 != 0, F.col("outcome") == "answered", F.col("outcome"))
    return r.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def quota_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions at 8 answers a day and 2 for each visitor, at which both caps bite."""
    r = _requests(spark, sf_dir).select("request_id", F.date_format("asked_at", "yyyy-MM-dd").alias("day"), F.coalesce("visitor", F.lit("unknown")).alias("visitor"), F.col("asked_at").alias("at"))
    return decide(r, 8, 2).select("request_id", "day", "visitor", "decision")


def quota_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_decisions(spark, sf_dir).groupBy("day").pivot("decision", ["allowed", "day-cap", "visitor-cap"]).count().na.fill(0)


def ask_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and tokens by UTC day and outcome, each request once."""
    r = _requests(spark, sf_dir)
    return r.groupBy("day_utc", "outcome").agg(F.count("*").alias("requests"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.percentile("ms", 0.5).alias("median_ms"))


QUERIES = {f.__name__: f for f in (
    bundle_papers, chunk_regions, papers_chunk_counts, longest_chunk, rect_styles, bm25_topk, bm25_documents, bm25_index_stats, bm25_many,
    scope_topk, hits, search_hits, quantize_int8, quantization_error, cosine_topk, cosine_topk_many, compare_rankings, build_prompt, cited_chunk_ids,
    answer_segments, ask_gate, ask_errors, quota_decisions, quota_days, ask_usage,
)}

_TERMS = "(VALUES ('light', 0, 2), ('attenuation', 1, 1), ('in', 2, 1), ('the', 3, 1), ('granular', 4, 1), ('reactor', 5, 1)) AS q(term, place, times)"
BUNDLE = CURRENT + f""",
bu AS (SELECT * FROM cur WHERE runner = '{RUNNER}'),
ck AS (SELECT paper_id, blocks, unnest(chunks) AS k FROM bu),
cx AS (SELECT paper_id || '#' || k.id AS id, paper_id, k.id AS n, k.section AS section, k.text AS text, k.chars AS chars, k.block_ids AS block_ids, blocks FROM ck),
rg AS (SELECT id, paper_id, chars, b.page AS page, list(b.bbox ORDER BY j) AS rects FROM (
  SELECT id, paper_id, chars, j, blocks[i + 1] AS b FROM (SELECT id, paper_id, chars, blocks, unnest(block_ids) AS i, unnest(range(len(block_ids))) AS j FROM cx) WHERE i >= 0 AND i < len(blocks)) WHERE b.bbox IS NOT NULL GROUP BY ALL)"""


def _bm25(source: str, key: str) -> str:
    """Scores of the rows of ``source`` for the query, as the tables tk (terms) and sco (scores)."""
    return f""",
tk AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) > 1) AS t FROM {source}),
po AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(t) AS term FROM tk) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sta AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM tk),
sco AS (SELECT {key}, sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))) AS score, min(place)::INT AS first_term
  FROM po JOIN {_TERMS} USING (term) JOIN dfs USING (term) JOIN tk USING ({key}), sta GROUP BY {key})"""


_CHUNKS = BUNDLE + _bm25("cx", "paper_id, n")
_TOP = " SELECT row_number() OVER (ORDER BY round(score, 9) DESC, first_term, paper_id, n)::INT AS rank, paper_id, n, score FROM sco {0} ORDER BY round(score, 9) DESC, first_term, paper_id, n LIMIT {1}"
_COS = "WITH u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)), v AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM u)"
_REQ = "WITH r AS (SELECT * FROM ask_requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY received_at) = 1)"
_QUOTA = _REQ + """,
q AS (SELECT request_id, strftime(asked_at, '%Y-%m-%d') AS day, coalesce(visitor, 'unknown') AS visitor, asked_at FROM r),
e AS (SELECT *, row_number() OVER (PARTITION BY day, visitor ORDER BY asked_at, request_id) <= 2 AS ok FROM q),
f AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY day ORDER BY asked_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
g AS (SELECT request_id, day, visitor, CASE WHEN before >= 8 THEN 'day-cap' WHEN ok THEN 'allowed' ELSE 'visitor-cap' END AS decision FROM f)"""
_ANSWER = "WITH a AS (SELECT doc_id, text || ' [1] and [3][1] but [9], [0] or [' || doc_id % 6 || '] end' AS answer FROM documents WHERE text IS NOT NULL)"

ORACLE = {
    "bundle_papers": BUNDLE + r" SELECT paper_id, filename, m.pages AS pages, sha256 FROM bu JOIN (SELECT *, regexp_replace(filename, '\.[^.]*$', '') AS paper_id FROM corpus_manifest QUALIFY row_number() OVER (PARTITION BY regexp_replace(filename, '\.[^.]*$', '') ORDER BY filename, sha256) = 1) m USING (paper_id)",
    "chunk_regions": BUNDLE + " SELECT id, page, rects FROM rg",
    "papers_chunk_counts": BUNDLE + " SELECT paper_id, count(*) AS chunks FROM cx GROUP BY 1",
    "longest_chunk": BUNDLE + " SELECT * FROM (SELECT paper_id, id, chars, min(page) AS page FROM rg GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY chars DESC, id DESC) = 1",
    "rect_styles": BUNDLE + """ SELECT paper_id, b."order" AS block, least(b.bbox[1], b.bbox[3]) * (800.0::DOUBLE / 612) AS "left", least(b.bbox[2], b.bbox[4]) * (800.0::DOUBLE / 612) AS top, abs(b.bbox[3] - b.bbox[1]) * (800.0::DOUBLE / 612) AS width, abs(b.bbox[4] - b.bbox[2]) * (800.0::DOUBLE / 612) AS height FROM (SELECT paper_id, unnest(blocks) AS b FROM bu) WHERE len(b.bbox) = 4""",
    "bm25_topk": _CHUNKS + _TOP.format("", K),
    "bm25_documents": "WITH x AS (SELECT 1)" + _bm25("documents", "doc_id") + " SELECT * FROM sco WHERE score > 0",
    "bm25_index_stats": "WITH x AS (SELECT 1)" + _bm25("documents", "doc_id") + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY 1",
    "bm25_many": "WITH x AS (SELECT * FROM documents)" + _bm25("x", "doc_id")
    + """,
qs AS (SELECT DISTINCT request_id AS query_id, question FROM ask_requests WHERE request_id % 20 = 0 AND question IS NOT NULL),
qw AS (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS place FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda t: length(t) > 1) AS t FROM qs)),
qt AS (SELECT query_id, term, count(*) AS times, min(place) AS place FROM qw GROUP BY ALL),
qr AS (SELECT query_id, doc_id AS doc, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))), 9) AS score, min(place) AS place
  FROM qt JOIN po USING (term) JOIN dfs USING (term) JOIN tk USING (doc_id), sta GROUP BY ALL)
SELECT query_id, rank::INT AS rank, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, doc) AS rank FROM qr) WHERE rank <= 3""",
    "scope_topk": _CHUNKS + _TOP.format("WHERE paper_id LIKE 'S%'", K),
    "hits": _CHUNKS + f" SELECT rank, paper_id || '#' || n AS chunk_id, section, substring(text, 1, 180) AS snippet FROM ({_TOP.format('', K)}) JOIN cx USING (paper_id, n)",
    "quantize_int8": "SELECT vec_id, s::DOUBLE AS scale, list_transform(e, lambda x: round_even(((x / s)::FLOAT * 127::FLOAT)::FLOAT, 0)::INT) AS codes FROM (SELECT vec_id, embedding AS e, coalesce(nullif(list_max(list_transform(embedding, lambda x: abs(x))), 0), 1)::FLOAT AS s FROM embeddings)",
    "cosine_topk": _COS + ", s AS (SELECT v.vec_id, round(list_sum(list_transform(list_zip(v.e, q.e), lambda z: z[1] * z[2])), 9) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q) SELECT row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10",
    "cosine_topk_many": _COS + ", s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(v.e, q.e), lambda z: z[1] * z[2])), 9) AS score FROM v, (SELECT * FROM v WHERE vec_id % 20 = 0) q) SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10",
    "compare_rankings": _COS
    + _bm25("documents", "doc_id")
    + """,
s AS (SELECT v.vec_id AS id, row_number() OVER (ORDER BY round(list_sum(list_transform(list_zip(v.e, q.e), lambda z: z[1] * z[2])), 12) DESC, v.vec_id) AS rank FROM v, (SELECT e FROM v WHERE vec_id = 0) q QUALIFY rank <= 100),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, first_term, doc_id) AS rank FROM sco WHERE score > 0 QUALIFY rank <= 100)
SELECT count(*) FILTER (WHERE s.id IS NOT NULL AND l.id IS NOT NULL) AS overlap, coalesce(list(s.id ORDER BY s.rank) FILTER (WHERE l.id IS NULL), []) AS only_semantic, coalesce(list(l.id ORDER BY l.rank) FILTER (WHERE s.id IS NULL), []) AS only_lexical FROM s FULL JOIN l ON s.id = l.id""",
    "search_hits": _COS
    + _bm25("documents", "doc_id")
    + """
SELECT 'lexical' AS mode, row_number() OVER (ORDER BY round(score, 9) DESC, first_term, doc_id)::INT AS rank, lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, round(score, 9) AS score FROM sco WHERE score > 0 QUALIFY rank <= 10
UNION ALL SELECT 'semantic', row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank, lpad(vec_id::VARCHAR, 12, '0'), score FROM (
  SELECT v.vec_id, round(list_sum(list_transform(list_zip(v.e, q.e), lambda z: z[1] * z[2])), 9) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q) QUALIFY rank <= 10""",
    "build_prompt": _CHUNKS
    + f""" SELECT '{A.SYSTEM}' AS system, 'Passages:' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || paper_id || ' — ' || coalesce(section, 'no section') || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: {QUERY}' AS user
FROM ({_TOP.format('', A.SENT_PASSAGES)}) JOIN cx USING (paper_id, n)""",
    "cited_chunk_ids": _ANSWER + r""", m AS (SELECT doc_id, unnest(x) AS i, unnest(range(len(x))) AS j FROM (SELECT doc_id, regexp_extract_all(answer, '\[(\d+)\]', 1) AS x FROM a))
SELECT doc_id, coalesce(list(c ORDER BY j) FILTER (WHERE c IS NOT NULL), []) AS cited FROM a LEFT JOIN (SELECT doc_id, 'c' || i AS c, min(j) AS j FROM m WHERE try_cast(i AS HUGEINT) BETWEEN 1 AND 4 GROUP BY ALL) USING (doc_id) GROUP BY doc_id""",
    "answer_segments": _ANSWER + r""",
p AS (SELECT doc_id, regexp_split_to_array(answer, '\[0*[1-4]\]') AS t, list_transform(regexp_extract_all(answer, '\[(0*[1-4])\]', 1), lambda x: x::INT) AS m FROM a),
s AS (SELECT doc_id, 2 * unnest(range(len(t))) AS pos, 'text' AS kind, unnest(t) AS text, NULL::INT AS label, NULL AS chunk_id FROM p
  UNION ALL SELECT doc_id, 2 * unnest(range(len(m))) + 1, 'citation', NULL, unnest(m), 'c' || unnest(m) FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS n, kind, text, label, chunk_id FROM s WHERE kind = 'citation' OR text <> ''""",
    "ask_gate": _REQ
    + r""" SELECT request_id, CASE WHEN request_id % 13 = 0 THEN 204 WHEN request_id % 19 = 0 THEN 403 WHEN request_id % 17 = 0 THEN 405 WHEN request_id % 23 = 0 THEN 404 WHEN request_id % 29 = 0 THEN 400
  WHEN length(coalesce(trim(question), '')) = 0 OR length(trim(question)) > 500 THEN 400 WHEN request_id % 31 = 0 THEN 400 WHEN request_id % 37 = 0 THEN 500 WHEN request_id % 41 = 0 THEN 500
  WHEN outcome IN ('day-cap', 'visitor-cap', 'rate-limit') THEN 429 WHEN outcome IS NULL OR outcome = 'answered' THEN 200 WHEN outcome IN ('auth', 'no-key') THEN 500 ELSE 502 END AS status FROM r""",
    "ask_errors": _REQ + " SELECT CASE WHEN request_id % 11 = 0 THEN 'offline' WHEN outcome = 'answered' THEN NULL WHEN outcome IN ('day-cap', 'visitor-cap', 'rate-limit') THEN outcome ELSE 'server' END AS kind, count(*) AS n FROM r GROUP BY 1",
    "quota_decisions": _QUOTA + " SELECT * FROM g",
    "quota_days": _QUOTA + """ SELECT day, count(*) FILTER (WHERE decision = 'allowed') AS allowed, count(*) FILTER (WHERE decision = 'day-cap') AS "day-cap", count(*) FILTER (WHERE decision = 'visitor-cap') AS "visitor-cap" FROM g GROUP BY 1""",
    "ask_usage": _REQ + " SELECT day_utc, outcome, count(*) AS requests, sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens, quantile_cont(ms::DOUBLE, 0.5) AS median_ms FROM r GROUP BY ALL",
    "quantization_error": """WITH q AS (SELECT e, list_transform(e, lambda x: round_even(((x / s)::FLOAT * 127::FLOAT)::FLOAT, 0)::DOUBLE * (s::DOUBLE / 127)) AS w FROM (SELECT embedding AS e, coalesce(nullif(list_max(list_transform(embedding, lambda x: abs(x))), 0), 1)::FLOAT AS s FROM embeddings)),
c AS (SELECT list_sum(list_transform(list_zip(e, w), lambda z: z[1]::DOUBLE * z[2])) / sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x)) * list_sum(list_transform(w, lambda x: x * x))) AS c FROM q)
SELECT avg(1 - c) AS mean_error, min(c) AS worst_cosine, count(*) AS vectors FROM c""",
}
