"""Exact vector search and the backfill of missing embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.providers import EmbeddingProvider

BATCH = 16


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector is all zero, null if the lengths differ."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(d(c), F.lit(0.0), lambda s, x: s + x * x))
    na, nb = norm(a), norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when((na == 0) | (nb == 0), 0.0).otherwise(dot / (na * nb))


def usable(v: Column) -> Column:
    """Whether a vector is there and all of its values are finite."""
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def nearest_to(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int = 30) -> DataFrame:
    """(id, score): the vectors most similar to one query vector, ties by id. Unusable ones and those of another length are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    x = vectors.where(usable(F.col(vector)) & (F.size(vector) == len(query))).select(F.col(key).alias("id"), cosine(F.col(vector), q).alias("score"))
    # copies of a delivery share their score, so each key has one best row: grouping keys combines map-side and only (id, score) is shuffled
    return x.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def missing(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without an embedding, of the documents that are known and not archived."""
    live = documents.where("status <> 'archived'").select("document_id")
    return chunks.join(live, "document_id", "left_semi").dropDuplicates([key]).join(embeddings.where("embedding is not null").select(key).distinct(), key, "left_anti")


def backfill(chunks: DataFrame, provider: EmbeddingProvider, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, model, embedding) from the provider, in batches of BATCH texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), BATCH):
                part = b.iloc[a : a + BATCH]
                yield pd.DataFrame({key: part[key].to_numpy(), "model": provider.model, "embedding": provider.embed([t or "" for t in part[text]])})

    return chunks.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, model string, embedding array<float>")
