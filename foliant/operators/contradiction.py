"""Candidate pairs of passages that may contradict each other, and their judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.segment import DEFAULT, enable_icu, words
from foliant.functions.shingle import shingles
from foliant.providers import ProviderError, TextProvider
from foliant.runtime import materialise

# Least likeness, number of candidates, least confidence of a finding; what makes a passage worth comparing.
LEAST, MOST, CONFIDENT = 0.12, 60, 0.5
SIGNALS = (
    r"[0-9０-９,，]+\s*(円|万円|%|％|件|名|人|回)",
    r"[0-9０-９]+\s*(日|週間|か月|ヶ月|年|営業日)\s*(以内|前|以降|まで)?",
    r"(令和|平成|R|H)?[0-9０-９]+年[0-9０-９]+月[0-9０-９]+日",
    r"(以上|以下|未満|超|を除く|に限る|必須|禁止|できない|しなければならない|することができる|原則)",
)


def has_signal(text: Column) -> Column:
    c = F.lit(False)
    for s in SIGNALS:
        c = c | text.rlike(s)
    return c


def _sets(chunks: DataFrame, profile: str) -> DataFrame:
    """(id, own, s) of one chunk for each distinct set of shingles: the one with the smallest id. `own` is the document that has all chunks of the set, null where several have."""
    if profile == "icu":
        enable_icu(chunks.sparkSession)
    x = chunks.select("id", "document_id", F.array_sort(F.array_distinct(shingles(words(F.col("text"), profile)))).alias("s")).where(F.size("s") > 0)
    one = x.groupBy(F.xxhash64("s").alias("h"), F.size("s").alias("n")).agg(
        F.min(F.struct("id", "s")).alias("m"),
        F.when((F.min("document_id") == F.max("document_id")) & (F.count("document_id") == F.count("*")), F.min("document_id")).alias("own"),
    )
    return one.select("m.id", "own", "m.s")


def _pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) at `least` or more across documents, by prefix filtering: of two sets so much alike the rarest shingles must meet.

    A set of n enters under its n - ceil(least * n) + 1 rarest shingles; a pair that agrees on none of them can't reach the likeness.
    """
    flat = sets.select("id", F.explode("s").alias("t"))
    df = flat.groupBy("t").agg(F.count("*").alias("df"))
    order = flat.join(df, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"))
    n = F.size("o")
    keep = (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int")
    keys = order.select("id", F.explode(F.slice("o", F.lit(1), F.greatest(F.lit(1), keep))).alias("x")).where("x.df > 1").select("id", F.col("x.t").alias("t"))
    sizes = sets.select("id", "own", F.size("s").alias("n"))
    k = keys.join(sizes, "id")
    a, b = k.alias("a"), k.alias("b")
    met = a.join(b, F.expr(f"a.t = b.t and a.id < b.id and (a.own is null or b.own is null or a.own <> b.own) and least(a.n, b.n) >= {least} * greatest(a.n, b.n) - 1e-9")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    s = sets.select("id", "s")
    both = met.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("jaccard")).where(F.col("jaccard") >= least)


def candidates(chunks: DataFrame, least: float = LEAST, most: int = MOST, profile: str = DEFAULT) -> DataFrame:
    """The `most` pairs (a, b, jaccard) of chunks of different documents that are most alike, ties by ids. `chunks`: (id, document_id, text).

    Chunks with the same shingles are one, under the smallest id; two such classes are a pair unless all their chunks are of one document. The search begins at a high likeness, where few
    pairs meet, and goes down until enough are found or `least` is reached, so the result is that of comparing all pairs.
    """
    sets = materialise(_sets(chunks.where(F.col("text").isNotNull()).dropDuplicates(["id"]), profile), "sets")
    for t in (0.9, 0.75, 0.6, 0.45, 0.3):
        if t <= least:
            break
        found = materialise(_pairs(sets, t), "likely")
        if found.count() >= most:
            return found.orderBy(F.desc("jaccard"), "a", "b").limit(most)
    return _pairs(sets, least).orderBy(F.desc("jaccard"), "a", "b").limit(most)


def unchecked(pairs: DataFrame, memo: DataFrame) -> DataFrame:
    """Pairs that the memo (a_chunk_id, b_chunk_id), in either order, doesn't hold."""
    m = memo.select(F.least("a_chunk_id", "b_chunk_id").alias("a"), F.greatest("a_chunk_id", "b_chunk_id").alias("b")).distinct()
    return pairs.join(m, ["a", "b"], "left_anti")


def merge_memo(memo: DataFrame, more: DataFrame) -> DataFrame:
    """The latest verdict for each pair."""
    x = memo.unionByName(more).select(F.least("a_chunk_id", "b_chunk_id").alias("a_chunk_id"), F.greatest("a_chunk_id", "b_chunk_id").alias("b_chunk_id"), "verdict", "checked_at")
    return x.groupBy("a_chunk_id", "b_chunk_id").agg(F.max_by("verdict", "checked_at").alias("verdict"), F.max("checked_at").alias("checked_at"))


VERDICT = {"hasContradiction": "has_contradiction boolean", "kind": "kind string", "severity": "severity string", "claimA": "claim_a string", "claimB": "claim_b string", "explanation": "explanation string", "confidence": "confidence double"}


def judge(pairs: DataFrame, chunks: DataFrame, provider: TextProvider, now: int) -> DataFrame:
    """(a, b, the columns of VERDICT, failed, checked_at): the provider's verdict on each pair; a failed call is marked and may be tried again."""
    import pandas as pd

    t = chunks.select("id", "text").dropDuplicates(["id"])
    x = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    columns = ["a", "b", *(c.split()[0] for c in VERDICT.values()), "failed", "checked_at"]

    def run(batches):  # noqa: ANN001, ANN202
        for p in batches:
            rows = []
            for a, b, ta, tb in zip(p["a"], p["b"], p["ta"], p["tb"]):
                try:
                    v = provider.complete_json(f"{ta}\n---\n{tb}", tuple(VERDICT))
                    said = [bool(v["hasContradiction"]), *(str(v[k]) for k in list(VERDICT)[1:-1]), float(v["confidence"])]
                    rows.append((a, b, *said, False, now))
                except (ProviderError, TypeError, ValueError):
                    rows.append((a, b, *[None] * len(VERDICT), True, now))
            yield pd.DataFrame(rows, columns=columns).astype({"has_contradiction": "boolean"})

    return x.select("a", "b", "ta", "tb").mapInPandas(run, f"a long, b long, {', '.join(VERDICT.values())}, failed boolean, checked_at long")


def findings(verdicts: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """The verdicts that state a contradiction with enough confidence."""
    return verdicts.where(~F.col("failed") & F.col("has_contradiction") & (F.col("confidence") >= least))


def saved_findings(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings as rows of the archive's table, open, with a citation for each side. `chunks`: (id, document_id, version_id, title, heading_path, page_from). The id follows from the pair, so a repeated scan adds none."""
    c = chunks.dropDuplicates(["id"]).select("id", F.struct("document_id", "version_id", "title", "heading_path", "page_from").alias("c"))
    x = found.join(c.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    cite = lambda k, side, claim: F.struct(F.col(k).alias("chunk_id"), F.col(f"{side}.document_id"), F.col(f"{side}.version_id"), F.col(f"{side}.page_from").alias("page"), F.col(f"{side}.heading_path"), F.col(claim).alias("quote"))
    return x.select(
        F.substring(F.sha2(F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b")), 256), 1, 26).alias("id"), F.lit("contradiction").alias("kind"), "severity",
        F.concat_ws(" / ", "ca.title", "cb.title").alias("title"), F.col("explanation").alias("summary"), F.array("ca.document_id", "cb.document_id").alias("document_ids"), F.array("ca.version_id", "cb.version_id").alias("version_ids"),
        F.to_json(F.struct("kind", F.col("claim_a").alias("claimA"), F.col("claim_b").alias("claimB"))).alias("detail"), F.array(cite("a", "ca", "claim_a"), cite("b", "cb", "claim_b")).alias("citations"),
        "confidence", F.lit("open").alias("status"), F.col("checked_at").alias("detected_at"), F.lit(None).cast("long").alias("resolved_at"),
    )


def scan(chunks: DataFrame, documents: DataFrame, memo: DataFrame, provider: TextProvider, now: int, most: int = MOST, profile: str = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new findings, the memo with the pairs judged now, one row of counts: candidates, judged, found).

    Chunks with a signal, of documents that aren't archived, give the candidates; pairs of the memo are left out; a failed call leaves its pair for the next scan.
    """
    live = documents.where("status <> 'archived'").select("document_id", F.col("title").alias("document_title"))
    c = chunks.where(has_signal(F.col("text"))).join(live, "document_id").withColumn("title", F.col("document_title"))
    todo = materialise(unchecked(candidates(c, most=most, profile=profile), memo), "pairs")
    verdicts = materialise(judge(todo, c, provider, now), "verdicts")
    found = materialise(saved_findings(findings(verdicts), c), "findings")
    told = F.when(F.col("has_contradiction") & (F.col("confidence") >= CONFIDENT), "contradiction").otherwise("no_contradiction")
    more = verdicts.where("not failed").select(F.col("a").alias("a_chunk_id"), F.col("b").alias("b_chunk_id"), told.alias("verdict"), "checked_at")
    counts = verdicts.agg(F.count("*").alias("candidates"), F.count(F.when(~F.col("failed"), 1)).alias("judged"), F.count(F.when(told == "contradiction", 1)).alias("found"))
    return found, merge_memo(memo, more), counts
