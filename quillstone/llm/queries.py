"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bestfit, jpeg, maskedwords, mtree, packing, phrases, pieces, quality, sharding, simhash, sql, substrings, toxicity, variants
from quillstone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_maskedlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maskedwords.score(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), limit=1 << 20)


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digest(jpeg.tensors(jpeg.stored(table(spark, sf_dir, "documents"))))


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(mtree.integers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.result(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup(table(spark, sf_dir, "documents")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(phrases.phrases(table(spark, sf_dir, "documents"), least=100, longest=5, most=2000))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.digest(bestfit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_packing": op2_packing,
    "op3_maskedlm": op3_maskedlm,
    "op4_sharding": op4_sharding,
    "op5_jpeg": op5_jpeg,
    "op6_mtree": op6_mtree,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_substrings": op10_substrings,
    "op11_phrases": op11_phrases,
    "op12_variants": op12_variants,
    "op13_bestfit": op13_bestfit,
}

ORACLES: dict[str, str] = {
    "op4_sharding": sql.OP4_SHARDING,
    "op6_mtree": sql.OP6_MTREE,
    "op11_phrases": sql.OP11_PHRASES,
    "op12_variants": sql.OP12_VARIANTS,
}
