"""Search in one of two modes, and the path from a question to a prompt. The two rankings stand side by side, never merged."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.operators import ask, lexical
from leafmill.operators.bundle import hit_rows
from leafmill.operators.vectors import cosine_topk
from leafmill.session import cut

class QueryEmbedder:
    """A question's vector by a model that is loaded at the first question and kept; a load that failed is tried again."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.load, self.model = load, None

    def __call__(self, spark: SparkSession, text: str) -> DataFrame:
        """One row with the vector of unit length."""
        if self.model is None:
            self.model = self.load()
        v = np.asarray(self.model([text]), np.float64)[0]
        return spark.createDataFrame([((v / (np.linalg.norm(v) or 1.0)).tolist(),)], "embedding array<double>")


class IndexCache:
    """The lexical index of each bundle, written to the shared folder once for as long as the bundle is in use."""

    def __init__(self) -> None:
        self.kept: WeakKeyDictionary[DataFrame, tuple[DataFrame, DataFrame]] = WeakKeyDictionary()

    def __call__(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        if chunks not in self.kept:
            self.kept[chunks] = tuple(cut(part) for part in lexical.index(chunks, key="id"))
        return self.kept[chunks]


HITS = "chunk_id string, score double, mode string, rank int"


def search(chunks: DataFrame, query: str, mode: str, k: int = 10, vectors: DataFrame | None = None, query_vector: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score, mode, rank) for a query. A blank query has no hits; semantic search without vectors is an error.

    ``vectors`` (chunk_id, embedding) are the bundle's; ``query_vector`` is one row with the query's embedding.
    """
    if mode not in ("lexical", "semantic"):
        raise ValueError(f"no such mode: {mode}")
    if not query.strip():
        return chunks.sparkSession.createDataFrame([], HITS)
    if mode == "lexical":
        top = lexical.rank(chunks.withColumnRenamed("id", "chunk_id"), query, k, ["chunk_id"])
    elif vectors is None or query_vector is None:
        raise ValueError("semantic search isn't available: the bundle has no vectors of this model")
    else:
        top = cosine_topk(vectors, query_vector, k, "chunk_id")
    return top.select("chunk_id", "score", F.lit(mode).alias("mode"), "rank")


def ask_prompt(chunks: DataFrame, question: str, paper_id: str | None = None, vectors: DataFrame | None = None, query_vector: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(passages, messages) for a question: the better mode there is, ranked over the whole corpus, then scoped to a paper,
    the first eight kept. Without passages there is no message and nothing is asked."""
    mode = "semantic" if vectors is not None and query_vector is not None else "lexical"
    k = chunks.count() if paper_id is not None else ask.CORPUS_K
    hits = search(chunks, question, mode, max(k, 1), vectors, query_vector)
    rows = hits.join(chunks.select(F.col("id").alias("chunk_id"), "paper_id", "section", "text"), "chunk_id")
    passages = ask.in_scope(rows, paper_id)
    messages = ask.prompt(passages, question).filter(F.lit(passages.limit(1).count() > 0))
    return passages, messages


def both_rankings(chunks: DataFrame, query: str, k: int, vectors: DataFrame, query_vector: DataFrame) -> DataFrame:
    """Hits of both modes, lexical and semantic, each with its own ranks."""
    return search(chunks, query, "lexical", k).unionByName(search(chunks, query, "semantic", k, vectors, query_vector))


def shown(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits as they are listed: with section and snippet, by rank."""
    return hit_rows(hits, chunks).orderBy("mode", "rank")


def url_path(*parts: Column) -> Column:
    """Path parts percent-encoded, a space as %20."""
    return F.concat_ws("/", *[F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")) for p in parts])
