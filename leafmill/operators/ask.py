"""Question answering over ranked chunks, as batch transforms: prompts, citations, gates, error kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_QUESTION, MAX_PASSAGES, SENT_PASSAGES, CORPUS_K = 500, 12, 8, 24
CITATION = r"\[(\d+)\]"
#: Fixed value: what the model is told.
SYSTEM = (
    "You answer questions about scientific papers using only the numbered passages provided. "
    "Cite every claim with the bracketed number of the passage it came from, like [2]. "
    "If the passages do not contain the answer, say the corpus does not cover it. "
    "Never cite a number that was not provided, and never invent a figure."
)


def user_message(passages: Column, question: Column) -> Column:
    """The numbered passages (structs paper_id, section, text) and the question."""
    one = lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["paper_id"], F.lit("")), F.lit(" — "), F.coalesce(p["section"], F.lit("no section")), F.lit("\n"), F.coalesce(p["text"], F.lit("")))
    return F.concat(F.lit("Passages:\n\n"), F.array_join(F.transform(passages, one), "\n\n"), F.lit("\n\nQuestion: "), question)


def prompt(hits: DataFrame, question: str) -> DataFrame:
    """One row with the messages for ranked hits (rank, paper_id, section, text)."""
    p = hits.agg(F.sort_array(F.collect_list(F.struct("rank", "paper_id", "section", "text"))).alias("p"))
    return p.select(F.lit(SYSTEM).alias("system"), user_message(F.col("p"), F.lit(question)).alias("user"))


def cited(answer: Column, ids: Column) -> Column:
    """Ids of the passages an answer cites, each once, as first cited; numbers out of range don't count."""
    n = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("bigint"))
    at = F.filter(n, lambda i: (i >= 1) & (i <= F.size(ids)))
    return F.array_distinct(F.transform(at, lambda i: F.get(ids, (i - 1).cast("int"))))


def segments(answer: Column, ids: Column) -> Column:
    """An answer as text and citation segments in order; a marker that can't be resolved stays text. The pieces between
    two citations are joined at once, so the time is linear in the answer."""
    pieces = F.regexp_extract_all(answer, F.lit(r"\[\d+\]|[^\[]+|\["), F.lit(0))
    number = lambda m: F.regexp_extract(m, r"^\[(\d+)\]$", 1).try_cast("int")
    found = F.filter(F.transform(pieces, lambda m, i: F.struct(i.alias("i"), number(m).alias("n"))), lambda x: F.coalesce((x["n"] >= 1) & (x["n"] <= F.size(ids)), F.lit(False)))
    ends = F.concat(F.transform(found, lambda x: x["i"]), F.array(F.size(pieces)))

    def part(end: Column, j: Column) -> Column:
        begin = F.when(j == 0, 0).otherwise(F.get(ends, j - 1) + 1)
        text = F.array_join(F.slice(pieces, begin + 1, F.greatest(end - begin, F.lit(0))), "")
        n = F.get(found, j)["n"]
        none = F.lit(None).cast("string")
        said = F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("int").alias("label"), none.alias("chunk_id"))
        cites = F.struct(F.lit("citation").alias("kind"), none.alias("text"), n.alias("label"), F.get(ids, n - 1).alias("chunk_id"))
        return F.array(F.when(text != "", said), F.when(n.isNotNull(), cites))

    return F.filter(F.flatten(F.transform(ends, part)), lambda x: x.isNotNull())


def gate(r: dict[str, Column], origin: str) -> Column:
    """HTTP status of a request by the first gate it fails, null where it reaches the quota.

    ``r``: method, origin, path, body_ok, question, passages, model_ok, has_key.
    """
    q = F.length(F.coalesce(F.regexp_replace(r["question"], r"(?U)^\s+|\s+$", ""), F.lit("")))
    return (
        F.when(r["method"] == "OPTIONS", 204)
        .when(~r["origin"].eqNullSafe(F.lit(origin)), 403)
        .when(r["method"] != "POST", 405)
        .when(r["path"] != "/ask", 404)
        .when(~r["body_ok"], 400)
        .when((q == 0) | (q > MAX_QUESTION), 400)
        .when(F.coalesce(r["passages"], F.lit(0)) == 0, 400)
        .when(~r["model_ok"], 500)
        .when(~r["has_key"], 500)
    )


def reply_status(gated: Column, decision: Column, failed: Column) -> Column:
    """HTTP status of a request that was gated (its status or null), then decided by the quota, then answered or failed by
    a kind: 429 beyond the quota or where the model is asked too often, 500 for a key that fails, 502 for any other."""
    model = F.when(failed.isNull(), 200).when(failed == "rate-limit", 429).when(failed.isin("auth", "no-key"), 500).otherwise(502)
    return F.coalesce(gated, F.when(decision != "allowed", 429), model)


def error_kind(url: Column, reached: Column, ok: Column, error: Column) -> Column:
    """What went wrong for the reader: not-configured, offline, one of three known bodies, else server; null if nothing."""
    known = error.isin("day-cap", "visitor-cap", "rate-limit")
    return F.when(F.coalesce(url, F.lit("")) == "", "not-configured").when(~reached, "offline").when(ok, F.lit(None)).when(known, error).otherwise("server")


def in_scope(hits: DataFrame, paper_id: str | None, keep: int = SENT_PASSAGES) -> DataFrame:
    """The first hits inside a paper, or of all; the scope comes after ranking, never before."""
    h = hits if paper_id is None else hits.filter(F.col("paper_id") == paper_id)
    return h.orderBy("rank").limit(keep)
