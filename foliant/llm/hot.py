"""Pairs within groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT = 10_000  # members from which a group is split


def group_pairs(members: DataFrame, group: str, key: str, condition: str) -> DataFrame:
    """Rows (a, b: structs of the members' columns) of two members of one group for which a condition on a and b holds.

    A group of more than HOT members is dealt into as many parts as it has times HOT; each part meets the whole group, in a task of its own.
    Nothing is dropped; the pairs of different members are what is asked for.
    """
    large = members.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(group, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    m = members.join(large, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    row = F.struct(*(F.col(c) for c in members.columns))
    a = m.select(F.col(group).alias("g"), F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), row.alias("a"))
    b = m.select(F.col(group).alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), row.alias("b"))
    return a.join(b, ["g", "part"]).where(condition).select("a", "b")
