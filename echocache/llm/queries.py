"""Registered queries of the operators, over whole tables, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echocache.llm import bpe, checks, classifier, counts, edits, lines, mixing, quality, sharding, simhash, substrings, urls, variants, whitening
from echocache.llm.tables import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(
        docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
        decoded="decoded", drop=("text",),
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return counts.count_tokens(
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), "text"),
        public_tokenizers.path("byte_bpe_50k.json"), drop=("text",),
    ).withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = lines.dedup_lines(docs, lines="n_lines", removed="n_removed")
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = quality.measure(docs)
    mean = (F.col("quality.char_distance") + F.col("quality.word_distance")) / 2
    return judged.select(
        "doc_id",
        *(f"quality.{c}" for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        )),
        F.round(mean, 6).alias("divergence"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


#: Rules over ``pages``.
URL_RULES = [
    urls.Rule("net/", "block"),
    urls.Rule("example.net/en/", "allow"),
    urls.Rule("example.com/de/", "block"),
    urls.Rule("org/fr/", "allow"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
    )
    return sharding.assign(docs, 8, key="doc_id", size="size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Shares of the mixture by domain and language; sources of one language weigh alike.
MIX_WEIGHTS = {"crawl": 50, "curated": 50} | {
    f"{domain}/{lang}": weight
    for domain in ("crawl", "curated")
    for lang, weight in (("en", 40), ("de", 20), ("fr", 20), ("es", 20))
}

MIX_SEED = 7


def mix_levels() -> dict[str, Column]:
    """The tree of ``documents``: sources numbered below ten are crawls, the others are curated."""
    number = F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999"))
    domain = F.when(number < 10, "crawl").when(number >= 10, "curated").otherwise("unknown")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixed(docs: DataFrame) -> DataFrame:
    """A row of ``docs`` for each epoch that takes it, with the struct ``mix``."""
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, key="doc_id", tokens=n_words, seed=MIX_SEED)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixed(docs).select(
        "doc_id", "mix.domain", "mix.lang", "mix.source", "mix.n_tokens", F.col("mix.epoch").cast("long").alias("epoch")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    model = whitening.fit(rows, scale=1024, shift=100_000)
    explained = F.array(*(F.lit(x) for x in (model.explained if model else [])))
    return (
        whitening.transform(rows, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
            F.col("deviation").cast("long").alias("deviation"), "whitened",
            F.get(explained.cast("array<double>"), F.col("at")).alias("explained"),
            F.lit(model.identity_error if model else 0.0).alias("identity_error"),
        )
    )


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return classifier.score(docs, model, drop=("text",)).select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_source_mixing": op2_source_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filters": op6_url_filters,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_spelling_variants": op13_spelling_variants,
}

CHECKS = {
    "op2_source_mixing": checks.mixing_sql(MIX_WEIGHTS, MIX_SEED),
    "op6_url_filters": checks.urls_sql([(r.text, r.verdict) for r in URL_RULES]),
    "op9_quality_rules": checks.quality_sql(),
}
