"""Full-text index and ranked search.

The index is a table of postings, one row for each term and entry with the positions in its three fields, and a table of entry lengths. Stored by
hash of the term, a query reads only its own terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from foliant.functions.segment import DEFAULT, WORD, enable_icu, words
from foliant.runtime import materialise

# Weights of title, heading and body; BM25 parameters.
WEIGHTS = {"title": 5.0, "heading": 3.0, "body": 1.0}
K1, B = 1.2, 0.75
BUCKETS = 256


@dataclass
class Index:
    """postings: (bucket, term, id, title, heading, body: positions); lengths: (id, tokens)."""

    postings: DataFrame
    lengths: DataFrame
    buckets: int = BUCKETS

    def write(self, path: str, parts: int = 1) -> None:
        """Postings by bucket of their term, sorted inside, so that a query prunes to its buckets and row groups; a bucket is written in `parts` tasks by entry, so that a frequent term is no single task's."""
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        self.postings.repartition("bucket", part).sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
        self.lengths.withColumn("buckets", F.lit(self.buckets)).write.mode("overwrite").parquet(f"{path}/lengths")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        lengths = spark.read.parquet(f"{path}/lengths")
        first = lengths.select("buckets").first()
        return Index(spark.read.parquet(f"{path}/postings"), lengths.drop("buckets"), first[0] if first else BUCKETS)

    def without(self, entries: DataFrame) -> Index:
        """The index less the entries whose `id` is given; unknown ones change nothing."""
        gone = entries.select("id").distinct()
        return Index(self.postings.join(gone, "id", "left_anti").select(*self.postings.columns), self.lengths.join(gone, "id", "left_anti").select(*self.lengths.columns), self.buckets)

    def updated(self, more: Index) -> Index:
        """The index with the entries of another one of as many buckets, which replace those of the same id."""
        if more.buckets != self.buckets:
            raise ValueError(f"{more.buckets} buckets don't fit an index of {self.buckets}")
        kept = self.without(more.lengths)
        return Index(kept.postings.unionByName(more.postings), kept.lengths.unionByName(more.lengths), self.buckets)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _tokens(c: Column, profile: str) -> Column:
    """Words as the index holds them: what a word has besides letters and digits parts it again."""
    w = words(F.coalesce(c, F.lit("")), profile)
    return w if profile == "simple" else F.flatten(F.transform(w, lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))


def build_index(entries: DataFrame, key: str, title: str, heading: str, body: str, profile: str = DEFAULT, keep: bool = False, buckets: int = BUCKETS) -> Index:
    """Index of entries with three text fields; null fields are empty. Repeated keys are taken once.

    The postings are a plan: a query pushes its terms below their grouping. `keep` writes the words of all entries to the
    shared folder first, so that several passes over the index part the texts once.
    """
    if profile == "icu":
        enable_icu(entries.sparkSession)
    once = entries.select(F.col(key).alias("id"), *(F.col(c).alias(f) for f, c in zip(WEIGHTS, (title, heading, body)))).dropDuplicates(["id"])
    t = once.select("id", *(_tokens(F.col(f), profile).alias(f) for f in WEIGHTS))
    if keep:
        t = materialise(t, "words")
    flat = t.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in WEIGHTS))).alias("x")).select("id", "x.field", F.posexplode("x.words").alias("pos", "term"))
    at = lambda f: F.sort_array(F.collect_list(F.when(F.col("field") == f, F.col("pos")))).alias(f)  # noqa: E731 - positions of one term in one entry
    postings = flat.groupBy("term", "id").agg(*(at(f) for f in WEIGHTS)).withColumn("bucket", _bucket(F.col("term"), buckets))
    lengths = t.select("id", sum((F.size(f) for f in WEIGHTS), F.lit(0)).alias("tokens"))
    return Index(postings, lengths, buckets)


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """(id, score) of the entries that hold all terms, in any field; lower is better.

    A term that parts into several words is a phrase and must stand in a row. A term given twice counts twice. Statistics are over all
    entries of the index. No terms give an empty result.
    """
    spark = index.postings.sparkSession
    if not terms:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    phrases = [split_term(t) for t in terms]
    phrases = [p for p in phrases if p]
    if not phrases:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    all_words = sorted({w for p in phrases for w in p})
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in all_words], "w string").select(_bucket(F.col("w"), index.buckets)).distinct().collect()]
    hits = index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(all_words))
    pick = lambda w, f: F.max(F.when(F.col("term") == w, F.col(f)))  # noqa: E731 - one row for each word of the query
    per = hits.groupBy("id").agg(F.countDistinct("term").alias("n"), *(pick(w, f).alias(f"{f}{i}") for i, w in enumerate(all_words) for f in WEIGHTS)).where(F.col("n") == len(all_words))
    number = {w: i for i, w in enumerate(all_words)}

    def count(p: list[str], f: str) -> Column:
        c = F.col(f"{f}{number[p[0]]}")
        for k, w in enumerate(p[1:], 1):
            c = F.array_intersect(c, F.transform(F.col(f"{f}{number[w]}"), _back(k)))
        return F.size(c)

    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    for i, p in enumerate(distinct):
        per = per.withColumn(f"f{i}", sum((count(p, f) * w for f, w in WEIGHTS.items()), F.lit(0.0))).where(F.col(f"f{i}") > 0)
    per = per.select("id", *(f"f{i}" for i in range(len(distinct))))
    stats = index.lengths.agg(F.count("*").alias("N"), F.avg("tokens").alias("avgdl"))
    # entries that hold each phrase: postings are counted for single words, positions compared for longer ones
    single = {i: p[0] for i, p in enumerate(distinct) if len(p) == 1}
    wide = hits.groupBy().agg(F.count("*").alias("postings"), *(F.count(F.when(F.col("term") == w, 1)).alias(f"n{i}") for i, w in single.items()))
    for i, p in enumerate(distinct):
        if i not in single:
            q = hits.where(F.col("term").isin(p)).groupBy("id").agg(F.countDistinct("term").alias("n"), *(pick(w, f).alias(f"{f}{number[w]}") for w in dict.fromkeys(p) for f in WEIGHTS)).where(F.col("n") == len(set(p)))
            wide = wide.join(F.broadcast(q.where(sum((count(p, f) for f in WEIGHTS), F.lit(0)) > 0).agg(F.count("*").alias(f"n{i}"))), F.lit(True))
    x = per.join(index.lengths, "id").join(F.broadcast(stats), F.lit(True)).join(F.broadcast(wide), F.lit(True))  # two frames of one row
    score = F.lit(0.0)
    for p in phrases:
        i = distinct.index(list(p))
        raw = F.ln((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("tokens") / F.col("avgdl")))
    return x.select("id", (-score).alias("score"))


def _back(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def split_term(term: str) -> list[str]:
    """The words of a term as the index parts them."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", term.lower())


def filters(doc_types: list[str] | None = None, owner: str | None = None, department: str | None = None, engine: str | None = None, updated_after: int | None = None, status: bool = True, freshness_max: float | None = None, category: str | None = None, columns: tuple[str, ...] = ()) -> Column:
    """The conjunction of the filters that are given; archived documents are always out. A null freshness passes its bound."""
    c = F.col("status") != "archived" if status else F.lit(True)
    if doc_types:
        c = c & F.col("doc_type").isin(*doc_types)
    if owner is not None:
        c = c & (F.col("owner_person_id") == owner)
    if department is not None:
        c = c & (F.col("department") == department)
    if engine is not None:
        c = c & (F.col("conversion_engine") == engine)
    if category is not None:
        c = c & (F.col("category_id") == category)
    if updated_after is not None:
        c = c & (F.col("updated_at") >= updated_after)
    if freshness_max is not None and "freshness_score" in columns:
        c = c & (F.col("freshness_score").isNull() | (F.col("freshness_score") <= freshness_max))
    return c


def search(index: Index, terms: list[str], visible: DataFrame, limit: int = 30) -> DataFrame:
    """The best entries among those whose id stands in `visible`, with its columns; ties by id."""
    return bm25(index, terms).join(visible, "id").orderBy("score", "id").limit(limit)


def group_by_document(hits: DataFrame, document: str, per_document: int = 2, ascending: bool = True) -> DataFrame:
    """Hits with hit_no, best_score and extra_hits of their document; the best `per_document` of each stay."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy(document)
    best = F.min("score") if ascending else F.max("score")
    x = hits.withColumns({"hit_no": F.row_number().over(w.orderBy(order, "id")), "best_score": best.over(w), "total": F.count("*").over(w)})
    return x.where(F.col("hit_no") <= per_document).withColumn("extra_hits", F.greatest(F.lit(0), F.col("total") - per_document)).drop("total")
