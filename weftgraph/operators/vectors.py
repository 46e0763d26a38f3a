"""Vectors of nodes: normalised on the way in, exact nearest neighbours, and an injected embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import dot, embed_text, normalised
from .search import search_fts

Embedder = Callable[[list[str]], list[list[float]]]


def normalised_vectors(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """(id, embedding) of unit length; rows of another dimension are left out."""
    own = vectors if dimension is None else vectors.where(F.size("embedding") == dimension)
    return own.withColumn("embedding", normalised("embedding"))


def upserted(old: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    fresh = normalised_vectors(new, dimension)
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): cosine to the query over all unit vectors, best first, ties by id; k rows leave each task at most."""
    length = sum(x * x for x in query) ** 0.5 or 1.0
    unit = F.array(*(F.lit(float(x / length)) for x in query))
    return vectors.select("id", dot("embedding", unit).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def semantic_search(nodes: DataFrame, vectors: DataFrame, query: str, k: int = 15, embedder: Embedder | None = None, stamp: str | None = None, model: str | None = None) -> tuple[DataFrame, bool]:
    """(nodes with score, degraded): by vectors, or by words where there is no embedder or the model is another one."""
    if embedder is None or stamp != model:
        return search_fts(nodes, query, k), True
    (vector,) = embedder([query])
    return knn(vectors, vector, k).join(nodes, "id").orderBy(F.desc("score"), "id"), False


def embedded(nodes: DataFrame, embedder: Embedder, chunk: int = 1024) -> DataFrame:
    """(id, embedding) of all nodes but files, embedded chunk by chunk on the executors."""
    texts = nodes.where("label <> 'File'").select("id", embed_text("name", "label", "file_path", F.col("text") if "text" in nodes.columns else F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), chunk):
                part = frame.iloc[i : i + chunk]
                yield pd.DataFrame({"id": part["id"].tolist(), "embedding": embedder(part["text"].tolist())})

    return normalised_vectors(texts.mapInPandas(run, "id string, embedding array<float>"))
