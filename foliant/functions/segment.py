"""Words of a text for indexing and querying.

Profile `icu`, the default, uses the dictionary-based word breaks of the ICU library in Spark's own jars, which part Japanese and Chinese.
Profile `simple` takes runs of letters and digits, as SQL can state them. Both stay in the JVM. Index and query must use the same profile.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, SparkSession, functions as F

# Words that carry no meaning of their own.
STOPWORDS = ("の", "は", "が", "を", "に", "で", "と", "も", "や", "な", "ば", "し", "て", "から", "まで", "より", "へ", "さ", "れ", "ま", "た", "です", "ます", "した", "でし")
# The sentence the segmenter is checked with, and its least number of words.
DIAGNOSTIC, DIAGNOSTIC_WORDS = "当社の情報セキュリティ管理規程は令和6年4月1日に改訂されました", 12
WORD = r"[\p{L}\p{N}]+"
DEFAULT = "icu"

#: The compiled form of icu/IcuWords.java beside it, against the icu4j and Spark jars of the installation.
JAR = Path(__file__).parent / "icu" / "icu-words.jar"
_ENABLED: set[str] = set()


def enable_icu(spark: SparkSession) -> None:
    """Register the function `icu_words` in the session, once; the jar goes to all executors."""
    app = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    if app not in _ENABLED:
        spark.sql(f"ADD JAR '{JAR}'")
        spark.udf.registerJavaFunction("icu_words", "IcuWords", "array<string>")
        _ENABLED.add(app)


def words(text: Column, profile: str = DEFAULT) -> Column:
    """The words of a text in order, lower case, without stop words. Null for null."""
    if profile == "icu":
        enable_icu(SparkSession.active())
    raw = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)) if profile == "simple" else F.transform(F.call_function("icu_words", text), F.lower)
    return F.filter(raw, lambda w: ~w.isin(*STOPWORDS))


def tokenised(text: Column, profile: str = DEFAULT) -> Column:
    return F.array_join(words(text, profile), " ")


def query_terms(spark: SparkSession, query: str, profile: str = DEFAULT) -> list[str]:
    """The words of a query, repeated ones kept; empty for a query without words."""
    return spark.range(1).select(words(F.lit(query), profile).alias("w")).first()["w"] or []


def match_expression(terms: list[str]) -> str | None:
    """All terms quoted and joined by AND; null without terms."""
    return " AND ".join('"' + t.replace('"', '""') + '"' for t in terms) or None


def check_segmenter(spark: SparkSession, profile: str = "icu") -> int:
    """Words of the diagnostic sentence; raises where the segmenter has no dictionary."""
    n = len(query_terms(spark, DIAGNOSTIC, profile))
    if n < DIAGNOSTIC_WORDS:
        raise RuntimeError(f"segmenter gives {n} words for the diagnostic sentence, {DIAGNOSTIC_WORDS} expected")
    return n
