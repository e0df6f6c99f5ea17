"""The named queries of this subpackage, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (
    decontamination,
    html_extraction,
    language_id,
    ngram_join,
    periodic_runs,
    pii,
    quality_rules,
    sentencepiece_codec,
    sql,
    suffix_dedup,
    token_rollup,
    toxicity,
    url_filter,
    whitening,
)
from mercato.llm.common import read_table, remainder
from mercato.operators.durable import new_path

LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 3, 1
#: Stands for the key a deployment keeps to itself.
SURROGATE_KEY = b"surrogates of the test tables"
TOXICITY_FOLDS, TOXICITY_HELD_OUT = 4, 2
URL_RULES = [
    url_filter.UrlRule("allow", "com/"),
    url_filter.UrlRule("block", "example.com/en/"),
    url_filter.UrlRule("allow", "www.example.com/en/"),
    url_filter.UrlRule("block", "net/es/"),
    url_filter.UrlRule("block", "net/fr/"),
]
TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_documents(read_table(spark, sf_dir, "documents"), str(model))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.with_surrogates(read_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return docs.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load every document, deliver the load twice, delete later exact copies, revise repeated lines.

    A copy is a document whose text another one with a lower id has. A document
    with repeated lines is counted anew without the repeats.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "token-rollup"))
    ranks, pattern = str(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN
    keep = ("doc_id", "source", "lang")

    def counted(rows: DataFrame) -> DataFrame:
        return token_rollup.count_tokens(rows, ranks, pattern, keep)

    load = token_rollup.change(token_rollup.INSERT, counted(docs), TOKENIZER, F.col("tokens"))
    rollup.apply("load", load)
    rollup.apply("load", load)
    digest = docs.select(*keep, F.sha2("text", 256).alias("digest")).where("digest IS NOT NULL")
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = digest.join(first, "digest").where("doc_id <> first")
    rollup.apply("copies", token_rollup.change(token_rollup.DELETE, copies, TOKENIZER))
    lines = F.split("text", "\n")
    shorter = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn(
        "text", F.array_join(F.array_distinct(lines), "\n")
    )
    gone = copies.select(F.col("doc_id").alias("gone"))
    revised = counted(shorter).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    rollup.apply("lines", token_rollup.change(token_rollup.REVISE, revised, TOKENIZER, F.col("tokens")))
    return rollup.totals()


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", LANGUAGE_FOLDS, LANGUAGE_HELD_OUT)
    model = language_id.fit(docs.where(~out))
    return language_id.identify(docs, model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fold = remainder("doc_id", TOXICITY_FOLDS)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), keep=fold != TOXICITY_HELD_OUT)
    held = language_id.held_out("doc_id", TOXICITY_FOLDS, TOXICITY_HELD_OUT).alias("held_out")
    return toxicity.score_documents(docs, model).select("doc_id", held, "score", "predicted")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
    texts = suffix_dedup.distinct_texts(docs).select(
        "text_id",
        F.struct(
            "n_bytes",
            removed.alias("n_removed"),
            F.size("spans").cast("long").alias("n_spans"),
            F.sha2("kept", 256).alias("kept_sha256"),
        ).alias("digest"),
    )
    nothing = F.struct(
        *(F.lit(0).cast("long").alias(name) for name in ("n_bytes", "n_removed", "n_spans")),
        F.sha2(F.lit(""), 256).alias("kept_sha256"),
    )
    ids = docs.select("doc_id", suffix_dedup.text_id("text").alias("text_id"))
    return ids.join(texts, "text_id", "left").select("doc_id", F.coalesce("digest", nothing).alias("digest")).select(
        "doc_id", "digest.*"
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return whitening.whiten(vectors, model).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def planted_repeat(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of which one document in ten repeats a stretch up to its end."""
    number = zlib.crc32(str(doc_id).encode())
    if doc_id is None or number % 10 or not words:
        return words
    share = number // 10
    first = share % len(words)
    period = 1 + (len(words) - first) // (3 + share % 8)
    stretch = words[first : first + period]
    return (words[:first] + stretch * -(-(len(words) - first) // period))[: len(words)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(read_table(spark, sf_dir, "documents"), rewrite=planted_repeat)

    def fuller_first(a, b):
        left, right = b["length"] * a["period"], a["length"] * b["period"]
        return (
            F.when(left != right, F.sign(left - right))
            .when(a["start"] != b["start"], F.sign(a["start"] - b["start"]))
            .otherwise(F.sign(a["period"] - b["period"]))
            .cast("int")
        )

    listed = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    best = F.get(F.array_sort("runs", fuller_first), F.lit(0))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_url_filter": op2_url_filter,
    "op3_ngram_join": op3_ngram_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_rollup": op7_token_rollup,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

LLM_SQL: dict[str, str] = {
    "op3_ngram_join": sql.NGRAM_JOIN,
    "op6_quality_rules": sql.QUALITY_RULES,
    "op9_decontamination": sql.DECONTAMINATION,
}
