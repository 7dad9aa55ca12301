"""Duplicates among current versions: equal content, then similar hashes, then shared shingles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.segment import DEFAULT, enable_icu, words
from foliant.functions.shingle import containment, hamming, jaccard, shingles, simhash48

# Largest distance of two hashes, least containment for "contained in".
DISTANCE, CONTAINED = 8, 0.85


def current_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """(version_id, document_id, markdown, created_at) of the current, converted versions of documents that aren't archived; deliveries once."""
    v = versions.where("markdown is not null and markdown <> ''").select("version_id", "document_id", "markdown", "created_at").dropDuplicates(["version_id"])
    d = documents.where("status <> 'archived'").select("document_id", F.col("current_version_id").alias("version_id"))
    return v.join(d, ["document_id", "version_id"])


def exact_classes(current: DataFrame) -> DataFrame:
    """(content_hash, version_id, document_id, first_version_id, copies): every version with the class of equal content."""
    h = current.select("version_id", "document_id", F.sha2("markdown", 256).alias("content_hash"))
    c = h.groupBy("content_hash").agg(F.min("version_id").alias("first_version_id"), F.count("*").alias("copies"))
    return h.join(c, "content_hash")


def representatives(current: DataFrame, profile: str = DEFAULT) -> DataFrame:
    """One row for each content: (version_id, document_id, shingles, simhash); document_id is null where several documents have the content. Shingles are a set for likeness, a list for the hash."""
    if profile == "icu":
        enable_icu(current.sparkSession)
    h = current.withColumn("content_hash", F.sha2("markdown", 256))
    one = h.groupBy("content_hash").agg(F.min("version_id").alias("version_id"), F.when(F.min("document_id") == F.max("document_id"), F.min("document_id")).alias("document_id"), F.first("markdown").alias("markdown"))
    s = one.select("version_id", "document_id", shingles(words(F.col("markdown"), profile)).alias("list"))
    return s.select("version_id", "document_id", F.array_distinct("list").alias("shingles"), simhash48("list").alias("simhash"))


def contents(current: DataFrame) -> DataFrame:
    """(version_id, document_id, content_id): every version with the representative of its content, the smallest version that has it."""
    h = current.select("version_id", "document_id", F.sha2("markdown", 256).alias("content_hash"))
    return h.join(h.groupBy("content_hash").agg(F.min("version_id").alias("content_id")), "content_hash").drop("content_hash")


def band_keys(h: Column, bands: int = 9, free: int = 1, bits: int = 48) -> Column:
    """Keys of which two hashes share one if they differ in at most bands - free bits: the values of every `free` of the bands.

    More bands with more of them in a key cost more keys and leave smaller buckets; (10, 2) suits hundreds of thousands of rows, (11, 3) tens of millions.
    """
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    part = [F.shiftright(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*(F.xxhash64(F.lit(i), *(part[j] for j in pick)) for i, pick in enumerate(combinations(range(bands), free))))


def free_bands(points: int, distance: int = DISTANCE, bits: int = 48, bucket: int = 64) -> int:
    """How many bands a key should hold so that buckets of this many hashes stay small: the fewest that leave `bucket` to one, if hashes were even."""
    return next((f for f in range(1, 5) if points * 2.0 ** (-bits * f / (distance + f)) <= bucket), 5)


def near_pairs(reps: DataFrame, distance: int = DISTANCE, bands: int | None = None, free: int | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(a, b, hamming) of representatives that don't lie in one and the same document, a < b: exact for the given distance by the pigeonhole principle.

    Rows of one hash are one point: the distance join runs between distinct hashes, membership is joined afterwards. Bands and their number in
    a key follow from the number of hashes where they aren't given. With `fresh` (version_id), only pairs with a version of those are compared.
    """
    # few bytes but many comparisons: a stated number of partitions isn't merged by size
    spark = reps.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = reps.select("simhash").distinct().repartition(parts, "simhash")
    if free is None:
        free = bands - distance if bands else free_bands(points.count(), distance)
    n = bands or distance + free
    keyed = points.select("simhash", F.explode(band_keys(F.col("simhash"), n, free)).alias("k")).repartition(parts, "k")
    a, b = keyed.alias("a"), keyed.alias("b")
    order = "a.simhash < b.simhash"
    if fresh is not None:
        a = keyed.join(reps.join(fresh.select("version_id").distinct(), "version_id", "left_semi").select("simhash").distinct(), "simhash", "left_semi").alias("a")
        order = "a.simhash <> b.simhash"
    near = a.join(b, F.expr(f"a.k = b.k and {order} and bit_count(a.simhash ^ b.simhash) <= {distance}")).select(F.least("a.simhash", "b.simhash").alias("x"), F.greatest("a.simhash", "b.simhash").alias("y")).distinct()
    several = reps.groupBy("simhash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("simhash").alias("x"), F.col("simhash").alias("y"))
    m = reps.select("simhash", "version_id", "document_id")
    p = near.unionByName(several).join(m.select(F.col("simhash").alias("x"), F.col("version_id").alias("va"), F.col("document_id").alias("da")), "x").join(m.select(F.col("simhash").alias("y"), F.col("version_id").alias("vb"), F.col("document_id").alias("db")), "y")
    return p.where("va <> vb and (da is null or db is null or da <> db) and (x <> y or va < vb)").select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"), hamming(F.col("x"), F.col("y")).cast("int").alias("hamming"))


def classify(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, kind, score, hamming, jaccard, containment): contained_in at CONTAINED or more, else near_dup."""
    s = reps.select("version_id", "shingles")
    x = pairs.join(s.select(F.col("version_id").alias("a"), F.col("shingles").alias("sa")), "a").join(s.select(F.col("version_id").alias("b"), F.col("shingles").alias("sb")), "b")
    x = x.withColumns({"jaccard": jaccard(F.col("sa"), F.col("sb")), "containment": containment(F.col("sa"), F.col("sb"))})
    inside = F.col("containment") >= CONTAINED
    return x.select("a", "b", F.when(inside, "contained_in").otherwise("near_dup").alias("kind"), F.when(inside, F.col("containment")).otherwise(F.col("jaccard")).alias("score"), "hamming", "jaccard", "containment")


def upsert_relations(old: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Relations after a scan: found ones update score, evidence and time of the same (a, b, kind) and keep its id and status; new ones are open.

    `old`: (relation_id, a, b, kind, score, evidence, status, detected_at); `found`: (a, b, kind, score, evidence), in either order of a and b.
    """
    f = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", F.col("score").alias("fs"), F.col("evidence").alias("fe"), F.lit(True).alias("hit")).dropDuplicates(["a", "b", "kind"])
    x = old.join(f, ["a", "b", "kind"], "full_outer")
    new_id = F.substring(F.sha2(F.concat_ws("|", "a", "b", "kind"), 256), 1, 26)
    return x.select(F.coalesce("relation_id", new_id).alias("relation_id"), "a", "b", "kind", F.coalesce("fs", "score").alias("score"), F.coalesce("fe", "evidence").alias("evidence"), F.coalesce("status", F.lit("open")).alias("status"), F.when(F.col("hit"), F.lit(now)).otherwise(F.col("detected_at")).alias("detected_at"))
