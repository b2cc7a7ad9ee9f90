"""Context of documents: lexicon stems, hits by class, ambiguity, score, trust."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from garimpo.functions import text as texts
from garimpo.functions import url as urls

CLASSES = ("person", "operation", "institution", "keyword")
#: Weight and ceiling of each class in the score (fixed values).
WEIGHTS = {"keyword": (0.05, 1.5), "person": (0.4, 1.5), "operation": (0.3, 1.0), "institution": (0.2, 0.8)}
AMBIGUOUS, DEFAULT_TRUST, LEAST_STEM = 0.1, 1.0, 2


def lexicon_stems(lexicon: DataFrame) -> DataFrame:
    """(category, stem, weight) of the lexicon's classes: an entry of several words
    gives each of its stems; of repeated stems the largest weight holds. Stems have
    at least two characters. Rows with a null term or category give nothing."""
    each = lexicon.where(F.col("category").isin(*CLASSES)).select("category", F.explode(texts.stems("term")).alias("stem"), "weight")
    return each.where(F.length("stem") >= LEAST_STEM).groupBy("category", "stem").agg(F.max("weight").alias("weight"))


def context_stems(stems: DataFrame) -> DataFrame:
    """The distinct stems of all classes."""
    return stems.select("stem").distinct()


def context_documents(postings: DataFrame, stems: DataFrame) -> DataFrame:
    """(url_hash) of the documents with any of the stems."""
    terms = context_stems(stems).withColumnRenamed("stem", "term")
    return postings.join(terms, "term", "left_semi").select("url_hash").distinct()


def hits(docs: DataFrame, postings: DataFrame, stems: DataFrame) -> DataFrame:
    """(url_hash, person_hits, operation_hits, institution_hits, keyword_tf_sum) of
    every document: distinct stems met in each class, and the occurrences of keyword
    stems times their weight. Documents without a hit have zeros. Postings hold a
    (term, url_hash) once. The lexicon is of a bounded size, so Spark broadcasts it
    below its own limit and shuffles it beyond."""
    matched = postings.join(stems.withColumnRenamed("stem", "term"), "term")
    counts = [F.count_if(F.col("category") == c).alias(f"{c}_hits") for c in CLASSES[:3]]
    total = F.sum(F.when(F.col("category") == "keyword", F.col("tf") * F.col("weight")).otherwise(0)).alias("keyword_tf_sum")
    found = matched.groupBy("url_hash").agg(*counts, total)
    joined = docs.select("url_hash").join(found, "url_hash", "left")
    return joined.select("url_hash", *(F.coalesce(c, F.lit(0)).alias(c) for c in (*(f"{c}_hits" for c in CLASSES[:3]), "keyword_tf_sum")))


def holds_any(column: Column, phrases: list[str]) -> Column:
    """Whether a text contains one of the phrases, case-insensitively; false for null."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.lower(column).contains(phrase.lower())
    return F.coalesce(found, F.lit(False))


#: Characters of the phrases that are sent to every task; a longer list is refused.
MOST_PHRASES = 20_000_000


def phrases_of(rows: DataFrame, term: str, weight: str | None = None) -> dict[str, int]:
    """Distinct lower-case phrases of a table, with their largest weight or 0. Null
    and empty phrases match nothing."""
    table = rows.where(f"{term} IS NOT NULL AND {term} != ''").groupBy(F.lower(term).alias("p")).agg((F.max(weight) if weight else F.lit(0)).alias("w"))
    if (size := table.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]) > MOST_PHRASES:
        raise ValueError(f"{size} characters of phrases; at most {MOST_PHRASES} can be sent to the tasks")
    return {r["p"]: r["w"] or 0 for r in table.collect()}


def phrase_weight(spark: SparkSession, text: Column, phrases: dict[str, int]) -> Column:
    """Summed weights of the phrases that a text contains, case-insensitively; null for
    a null text. A text is read once, however many phrases there are: one automaton
    finds the occurrences of all of them."""
    shared = spark.sparkContext.broadcast(phrases)

    @F.arrow_udf(LongType())
    def run(values: pa.Array) -> pa.Array:
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase, weight in shared.value.items():
            found.add_word(phrase, (phrase, weight))
        found.make_automaton()
        hits = (lambda text: {hit for _, hit in found.iter(text)}) if shared.value else lambda text: ()
        return pa.array([None if v is None else sum(w for _, w in hits(v)) for v in values.to_pylist()], pa.int64())

    return run(F.lower(text))


def ambiguous(title: Column, triggers: list[str], cue: Column) -> Column:
    """A trigger phrase and a non-topical cue in the title, without topical hits."""
    topical = (F.col("person_hits") > 0) | (F.col("operation_hits") > 1) | (F.col("institution_hits") > 0)
    return holds_any(title, triggers) & cue & ~topical


def score(is_ambiguous: Column, trust: Column) -> Column:
    parts = {"keyword": F.col("keyword_tf_sum"), **{c: F.col(f"{c}_hits") for c in CLASSES[:3]}}
    total = F.lit(0.0)
    for name in ("keyword", "person", "operation", "institution"):
        weight, most = WEIGHTS[name]
        total = total + F.least(parts[name] * weight, F.lit(most))
    return F.when(is_ambiguous, F.lit(AMBIGUOUS)).otherwise(total) * trust


def with_trust(docs: DataFrame, trust: DataFrame, url: str = "url") -> DataFrame:
    """``docs`` with domain_trust: the trust of the exact domain, 1 where there is
    none or it is null. Of a repeated domain the largest trust holds."""
    known = trust.where("domain IS NOT NULL").groupBy(F.lower("domain").alias("__domain")).agg(F.max("trust").alias("__trust"))
    joined = docs.withColumn("__domain", urls.trust_domain(F.col(url))).join(known, "__domain", "left")
    return joined.withColumn("domain_trust", F.coalesce("__trust", F.lit(DEFAULT_TRUST))).drop("__domain", "__trust")


def analysis(docs: DataFrame, postings: DataFrame, lexicon: DataFrame, trust: DataFrame, triggers: list[str]) -> DataFrame:
    """(url_hash, score, is_ambiguous, hits ..., domain_trust) of docs (url_hash, url,
    title). The cues are the lexicon's ``nontopical`` terms."""
    cues = dict.fromkeys(phrases_of(lexicon.where("category = 'nontopical'"), "term"), 1)
    cue = F.coalesce(phrase_weight(docs.sparkSession, F.col("title"), cues) > 0, F.lit(False))
    found = with_trust(docs.select("url_hash", "url", "title"), trust).join(hits(docs, postings, lexicon_stems(lexicon)), "url_hash")
    found = found.withColumn("is_ambiguous", ambiguous(F.col("title"), triggers, cue))
    found = found.withColumn("score", score(F.col("is_ambiguous"), F.col("domain_trust")))
    return found.select("url_hash", "score", "is_ambiguous", "person_hits", "operation_hits", "institution_hits", "keyword_tf_sum", "domain_trust")
