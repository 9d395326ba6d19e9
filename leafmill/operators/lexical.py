"""Lexical ranking: BM25 over chunks or documents. Statistics always cover the whole corpus; a scope filters scores."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.functions.text import tokens
from leafmill.operators.vectors import best_of
from leafmill.session import cut

K1, B = 1.2, 0.75
#: Queries of one batch, whose term counts are broadcast as a matrix; documents that are scored at a time.
BATCH, DOCS = 1024, 256


def query_terms(query: str) -> list[str]:
    """The query's terms in order; a repeated one counts each time."""
    return [t for t in re.split("[^a-z0-9]+", query.lower()) if len(t) > 1]


def index(docs: DataFrame, text: str = "text", key: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): term, document and frequency; each document's number of terms. For many queries."""
    t = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t"))
    return t.select("doc", F.explode("t").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf")), t.select("doc", F.size("t").alias("length"))


def _part(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def scores(docs: DataFrame, query: str, key: list[str], text: str = "text") -> DataFrame:
    """(*key, score, first_term) of every document with a positive score, for one query.

    Only the query's terms are counted, inside each row; the corpus statistics are one row, which is joined back. Nothing
    but that row is shuffled. ``first_term`` is the place in the query of the first term found, the tie rule.
    """
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    t = tokens(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(*key, t.alias("_t"))
    if not terms:
        return d.select(*key, F.lit(0.0).alias("score"), F.lit(0).alias("first_term")).limit(0)

    def frequency(term: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == term))

    d = d.select(*key, F.size("_t").alias("_len"), *[frequency(w).alias(f"_tf{i}") for i, w in enumerate(distinct)])
    stats = d.agg(F.count("*").alias("_n"), F.when(F.count("*") > 0, F.avg("_len")).otherwise(1.0).alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(distinct))])
    d = d.filter(" OR ".join(f"_tf{i} > 0" for i in range(len(distinct)))).crossJoin(F.broadcast(stats))  # one row
    each = [F.when(F.col(f"_tf{i}") > 0, _part(_idf(F.col("_n"), F.col(f"_df{i}")), F.col(f"_tf{i}"), F.col("_len"), F.col("_mean"))).otherwise(0.0) for i in range(len(distinct))]
    total = sum((each[distinct.index(w)] for w in terms[1:]), each[distinct.index(terms[0])])
    first = F.coalesce(*[F.when(F.col(f"_tf{i}") > 0, F.lit(terms.index(w))) for i, w in enumerate(distinct)])
    return d.select(*key, total.alias("score"), first.alias("first_term")).filter("score > 0")


def rank(docs: DataFrame, query: str, k: int, key: list[str], text: str = "text", scope: Column | None = None) -> DataFrame:
    """The k best documents of a query with their rank. A scope leaves the corpus statistics as they are."""
    s = scores(docs, query, key, text)
    s = s.filter(scope) if scope is not None else s
    order = [F.desc(F.round("score", 9)), "first_term", *key]  # sums of another order don't make other ranks
    return s.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def rank_many(postings: DataFrame, lengths: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc, score) of the k best documents of each query (query_id, text), from a kept index.

    Postings are reduced to the queries' terms before they are joined; ranks are taken for each query apart.
    """
    q = queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("place", "term"))
    q = q.groupBy("query_id", "term").agg(F.count("*").alias("times"), F.min("place").alias("place"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    p = postings.join(q.select("term").distinct(), "term", "left_semi")
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    s = p.join(df, "term").join(lengths, "doc").crossJoin(F.broadcast(stats))  # one row
    s = s.withColumn("part", _part(_idf(F.col("n"), F.col("df")), F.col("tf"), F.col("length"), F.col("mean")))
    s = q.join(s, "term").groupBy("query_id", "doc").agg(F.sum(F.col("part") * F.col("times")).alias("score"), F.min("place").alias("first_term"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first_term", "doc")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def rank_batches(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc, score) of the k best documents for each of many queries (query_id, text) without an index.

    A stated query set meets the documents in blocks: a batch of queries is a matrix of term counts, a few documents one of
    term weights, their product the scores. A task carries its k best for each query from batch to batch, so no (query,
    document) pair is ever a row before that. Documents are tokenised once for all batches of queries. A null text is a
    document without terms.
    """
    q = queries.select("query_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).orderBy("query_id")
    starts = range(0, q.count(), BATCH)
    d = docs.select(F.col(key).cast("bigint").alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    d = cut(d) if len(starts) > 1 else d
    stats = d.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).head()
    parts = [_rank_batch(d, q.offset(s).limit(BATCH).toPandas(), k, stats["n"], stats["mean"] or 1.0) for s in starts]
    empty = docs.sparkSession.createDataFrame([], "query_id bigint, doc bigint, score double, first_term int")
    best = reduce(DataFrame.unionByName, parts, empty)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first_term", "doc")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def _rank_batch(d: DataFrame, batch, k: int, n_docs: int, mean: float) -> DataFrame:
    spark = d.sparkSession
    terms = sorted({t for ts in batch["t"] for t in ts})
    at = {t: i for i, t in enumerate(terms)}
    ids = batch["query_id"].to_numpy(np.int64)
    times = np.zeros((len(ids), len(terms)), np.float32)
    place = np.full((len(ids), len(terms)), 1 << 30, np.int32)
    for i, ts in enumerate(batch["t"]):
        for n, t in enumerate(ts):
            times[i, at[t]] += 1
            place[i, at[t]] = min(place[i, at[t]], n)
    asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))  # at most the batch's terms
    found = d.select(F.explode(F.array_distinct("t")).alias("term")).join(asked, "term").groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(len(terms))
    for r in found.collect():  # at most the batch's terms
        df[at[r["term"]]] = r["df"]
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * (K1 + 1)
    sent = spark.sparkContext.broadcast((ids, times, idf, place, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, times, idf, place, terms = sent.value
        weights, values = times * idf, pa.array(terms, pa.string())
        none = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)
        kept = [none] * len(ids)
        for big in batches:
            for first_row in range(0, big.num_rows, DOCS):
                b = big.slice(first_row, DOCS)
                doc, t = b.column(0).to_numpy(), b.column(1)
                sizes = pc.list_value_length(t).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(doc)), sizes)
                which = pc.fill_null(pc.index_in(t.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False)
                tf = np.zeros((len(doc), len(terms)))
                np.add.at(tf, (row[which >= 0], which[which >= 0]), 1)
                part = tf / (tf + K1 * (1 - B + B * sizes[:, None] / mean))
                for i, s in enumerate(weights @ part.T):
                    hit = np.flatnonzero(s > 0)
                    if not len(hit):
                        continue
                    if len(hit) > k:  # the k-th best, and all that tie with it
                        hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k] - 1e-8]
                    first = np.where(tf[hit] > 0, place[i], 1 << 30).min(1).astype(np.int32)
                    old = kept[i]
                    docs, score, first = np.append(old[0], doc[hit]), np.append(old[1], s[hit]), np.append(old[2], first)
                    top = best_of(score, [first, docs], k)
                    kept[i] = docs[top], score[top], first[top]
        sizes = [len(x[0]) for x in kept]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), *[pa.array(np.concatenate([x[c] for x in kept])) for c in range(3)]], ["query_id", "doc", "score", "first_term"])

    return d.mapInArrow(run, "query_id bigint, doc bigint, score double, first_term int")
