"""Group identifiers from pairwise matches: connected components by random graph contraction.

Each round, every vertex hooks to the neighbour (itself included) that comes first in a hash order
drawn afresh for the round; edges are relabelled by that mapping and deduplicated. A constant share of
the vertices vanishes per round whatever the shape of the graph, so the rounds grow with the logarithm
of its size. The mappings are kept and, once no edge is left, expanded from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.runtime import discard, materialise

MAX_ROUNDS = 200


def _edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of the distinct edges, without nulls and loops."""
    e = df.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")).where("u is not null and v is not null and u <> v")
    return e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _order(v: str, seed: int) -> Column:
    """Rank of a vertex in this round's order: a fresh hash, ties broken by the name."""
    return F.struct(F.xxhash64(F.lit(seed), F.col(v)).alias("h"), F.col(v).alias("id"))


def _first_neighbour(e: DataFrame, seed: int) -> DataFrame:
    """(x, r, n): for every vertex the first of its closed neighbourhood, and its number of neighbours. `min` combines map-side, so a hub costs one row per task."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y"))))).select("col.x", "col.y")
    best = ends.groupBy("x").agg(F.min(_order("y", seed)).alias("m"), F.count("*").alias("n"))
    return best.select("x", F.least(_order("x", seed), F.col("m"))["id"].alias("r"), "n")


def _relabel(e: DataFrame, m: DataFrame, hubs: list[str], salts: int) -> DataFrame:
    """Edges between the representatives. The edges of a hub spread over `salts` join keys, and only its mapping is copied once per salt."""
    is_hub = lambda c: F.col(c).isin(hubs) if hubs else F.lit(False)
    ms = m.select("x", "r", F.explode(F.when(is_hub("x"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("s"))
    part = lambda hub, other: F.when(is_hub(hub), F.pmod(F.xxhash64(other), F.lit(salts)).cast("int")).otherwise(0)
    a = e.withColumn("s", part("u", "v")).join(ms.withColumnRenamed("x", "u"), ["u", "s"]).select(F.col("r").alias("u"), "v")
    a = a.distinct()
    b = a.withColumn("s", part("v", "u")).join(ms.withColumnRenamed("x", "v"), ["v", "s"]).select("u", F.col("r").alias("v"))
    return b.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_groups(pairs: DataFrame, a: str, b: str, salts: int = 64, hub: int = 100_000) -> DataFrame:
    """(member string, group_id string): every vertex of an edge with the smallest vertex of its component.

    Rows with a null end and loops link nothing and are left out; repeated rows and either direction count
    once; extra columns are ignored. An empty input gives an empty result. The loop asks how many edges are left and which vertices
    are hubs: those with more than `hub` neighbours and more than a thousandth of all ends, so a thousand at most. Their edges are spread over
    `salts` join keys. Every round is written to the shared folder, so a lost executor costs a read of files.
    """
    e = materialise(_edges(pairs, a, b), "edges")
    maps: list[DataFrame] = []
    for seed in range(MAX_ROUNDS):
        left = e.count()
        if not left:
            break
        m = materialise(_first_neighbour(e, seed), "map")
        hubs = [r["x"] for r in m.where(F.col("n") > max(hub, 2 * left // 1_000)).select("x").collect()] if left > hub else []
        nxt = materialise(_relabel(e, m, hubs, salts), "edges")
        discard(e)
        maps.append(m.select("x", "r"))
        maps[-1]._foliant_path = m._foliant_path
        e = nxt
    else:
        raise RuntimeError("contraction did not end; is the input changing between reads?")
    if not maps:
        return e.select(F.col("u").alias("member"), F.col("v").alias("group_id"))
    root = maps[-1]
    for m in reversed(maps[:-1]):
        up = root.select(F.col("x").alias("r"), F.col("r").alias("top"))
        root = m.join(up, "r", "left").select("x", F.coalesce("top", "r").alias("r"))
    root = materialise(root, "root")
    for m in maps:
        discard(m)
    least = root.groupBy("r").agg(F.min("x").alias("group_id"))
    return root.join(least, "r").select(F.col("x").alias("member"), "group_id")


COUNTING_KINDS = ("exact_dup", "near_dup", "contained_in", "revision_of")


def counting_links(relations: DataFrame) -> DataFrame:
    """Relation rows that link two versions: both ends present and different, not dismissed, of a counting kind.

    Kinds compare after trimming, lower-casing and reading a hyphen as an underscore; a null status isn't `dismissed`.
    """
    kind = F.regexp_replace(F.lower(F.regexp_replace("kind", r"^[\s 　]+|[\s 　]+$", "")), r"[-‐‑ ]", "_")
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    return relations.where(F.col("a_version_id").isNotNull() & F.col("b_version_id").isNotNull() & (F.col("a_version_id") != F.col("b_version_id")) & kind.isin(*COUNTING_KINDS) & (status != "dismissed"))
