"""Dense vectors: normalisation, int8 codes, exact cosine ranking, comparison of rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Queries of one block, which is broadcast; digits to which scores are told apart.
BATCH, DIGITS = 2048, 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def scale(v: Column) -> Column:
    """The largest magnitude, 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(top == 0, F.lit(1.0)).otherwise(top).cast("float")


def quantize(v: Column) -> Column:
    """Codes of one byte: round(v / scale * 127), half to even, in single precision."""
    s = scale(v)
    return F.transform(v, lambda x: F.bround((x.cast("float") / s).cast("float") * F.lit(127.0).cast("float")).cast("tinyint"))


def dequantize(codes: Column, s: Column) -> Column:
    return F.transform(codes, lambda q: q.cast("double") * (s.cast("double") / 127.0))


def quantization_error(vectors: DataFrame, v: str = "embedding") -> DataFrame:
    """Mean cosine error and worst cosine of the round trip; a zero vector has no cosine and makes them NaN."""
    d = vectors.select(F.col(v).alias("v"), dequantize(quantize(F.col(v)), scale(F.col(v))).alias("w"))
    n = norm(F.col("v")) * norm(F.col("w"))
    cos = F.when(n == 0, F.lit(float("nan"))).otherwise(dot(F.col("v"), F.col("w")) / n)
    return d.select(cos.alias("c")).agg(F.avg(1 - F.col("c")).alias("mean_error"), F.min("c").alias("worst_cosine"), F.count("*").alias("vectors"))


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """The k rows nearest to the one vector of ``query``, all scored exactly, negatives kept, ties by key."""
    q = query.select(normalise(F.col(v)).alias("_q")).limit(1)
    s = vectors.crossJoin(F.broadcast(q)).select(key, dot(normalise(F.col(v)), F.col("_q")).alias("score"))  # one query vector
    top = s.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def cosine_topk_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) for a stated query set: blocks of BATCH queries meet partitions of rows as matrices.

    A block is sent as one broadcast of bounded size; each Arrow batch of rows is scored with one matrix product. A task
    carries its k best for each query, by rounded score and key, from batch to batch; only those are shuffled.
    """
    q = queries.orderBy("query_id").select("query_id", F.col(v).alias("v"))
    parts = [_cosine_block(vectors, q.offset(s).limit(BATCH).toPandas(), k, key, v) for s in range(0, q.count(), BATCH)]
    empty = vectors.sparkSession.createDataFrame([], f"query_id bigint, {key} bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), key)
    return reduce(DataFrame.unionByName, parts, empty).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_of(score: np.ndarray, ties: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the k best scores, rounded; equal ones by ``ties``. Only those that can be among them are sorted."""
    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 10.0**-DIGITS)
    return some[np.lexsort((*[t[some] for t in reversed(ties)], -np.round(score[some], DIGITS)))[:k]]


def _cosine_block(vectors: DataFrame, qs, k: int, key: str, v: str) -> DataFrame:
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    sent = vectors.sparkSession.sparkContext.broadcast((qs["query_id"].to_numpy(np.int64), unit(np.stack(qs["v"].to_numpy()).astype(np.float64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        kept = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1))
            keys = batch.column(0).to_numpy()
            for i, s in enumerate(m @ x.T):
                top = best_of(s, [keys], k)
                both, score = np.append(kept[i][0], keys[top]), np.append(kept[i][1], s[top])
                top = best_of(score, [both], k)
                kept[i] = both[top], score[top]
        sizes = [len(a) for a, _ in kept]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([a for a, _ in kept])), pa.array(np.concatenate([s for _, s in kept]))], ["query_id", key, "score"])

    return vectors.select(key, v).filter(F.col(v).isNotNull()).mapInArrow(run, f"query_id bigint, {key} bigint, score double")


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], dim: int, into: str = "embedding") -> DataFrame:
    """Unit vectors of a text column by an injected model; it is made once in each worker. A wrong shape is an error."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            v = np.asarray(embedder([x or "" for x in batch.to_pylist()]), np.float32)
            if v.shape != (len(batch), dim):
                raise ValueError(f"the embedder gave {v.shape}, not {(len(batch), dim)}")
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(n == 0, 1, n)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel(), pa.float32()))

    return df.withColumn(into, run(text))


def compare_rankings(semantic: DataFrame, lexical: DataFrame, key: str) -> DataFrame:
    """Overlap of two rankings (key, rank), and what only one of them has, in its order. They are never merged."""
    j = semantic.select(key, F.col("rank").alias("s")).join(lexical.select(key, F.col("rank").alias("l")), key, "full_outer")
    ordered = lambda r, other: F.transform(F.sort_array(F.collect_list(F.when(F.col(other).isNull(), F.struct(r, key)))), lambda x: x[key])
    return j.agg(F.count_if(F.col("s").isNotNull() & F.col("l").isNotNull()).alias("overlap"), ordered("s", "l").alias("only_semantic"), ordered("l", "s").alias("only_lexical"))
