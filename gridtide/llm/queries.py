"""The registered queries of this subpackage: each operator over its whole table, shaped as agreed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtide.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    html_extract,
    lexical_search,
    pii,
    quality,
    simhash,
    substring_dedup,
    token_counts,
    topk_search,
    toxicity,
    whitening,
)
from gridtide.llm.sql import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def substring(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == F.lit(n))).cast("bigint")
    term = lambda t: F.struct(t["start"].alias("start"), F.lit(len(pii.KINDS)).alias("kind"), t["end"].alias("end"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        "doc_id",
        *(count(n).alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)),
        sha256_text(pii.span_text(base)).alias("base_sha256"),
        pii.span_text(F.array_sort(F.concat(base, F.transform("terms", term)))).alias("spans"),
    )


def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.link(table(spark, folder, "embeddings"))


def word_piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), WORD_PIECES)


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    texts = html_extract.extract(pages, html_extract.fit(pages))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def byte_bpe_codes(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe_digest(table(spark, folder, "documents"))


def byte_bpe_digest(docs: DataFrame) -> DataFrame:
    tokens = byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(tokens, BYTE_BPE)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256_text(F.concat_ws(",", "items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def whitened(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    at = F.col("component") - 1
    each = found.select("*", F.posexplode("whitened").alias("at", "value")).withColumn("component", F.col("at") + 1)
    return each.select(
        "vec_id",
        "component",
        "n",
        F.col("deviation").try_cast("bigint").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get("explained", at).alias("explained"),
        "identity_error",
    )


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.search(table(spark, folder, "embeddings"))


def ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_simhash_dedup": simhash_dedup,
    "op2_substring_dedup": substring,
    "op3_pii": personal_data,
    "op4_html_extract": page_texts,
    "op5_toxicity": toxic_scores,
    "op6_token_counts": word_piece_counts,
    "op7_byte_bpe": byte_bpe_codes,
    "op8_embedding_dedup": embedding_links,
    "op9_decontaminate": decontamination,
    "op10_quality": quality_scores,
    "op11_whitening": whitened,
    "op12_topk_search": nearest_vectors,
    "op13_lexical_search": ranked_documents,
}
