"""One ranking from several: reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

RRF_K, LEG = 60, 50


def ranked(hits: DataFrame, name: str, ascending: bool, limit: int = LEG) -> DataFrame:
    """(id, leg, rank) of the best `limit` hits, from 1, ties by id."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    top = hits.orderBy(order, "id").limit(limit)
    return top.select("id", F.lit(name).alias("leg"), F.row_number().over(Window.orderBy(order, "id")).alias("rank"))


def fuse(legs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, rrf, matched_by): the sum of 1 / (k + rank) over the legs that found an id, and their names. A leg may be empty."""
    return reduce(DataFrame.unionByName, legs).groupBy("id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"), F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("matched_by"))


def hybrid(keyword: DataFrame, semantic: DataFrame | None, visible: DataFrame, limit: int = 30) -> DataFrame:
    """Fused hits that are visible, best first. Without a semantic leg (no provider) the keyword leg stands alone."""
    legs = [ranked(keyword, "keyword", True)] + ([ranked(semantic, "semantic", False)] if semantic is not None else [])
    return fuse(legs).join(visible, "id").orderBy(F.desc("rrf"), F.col("matched_by"), "id").limit(limit)
