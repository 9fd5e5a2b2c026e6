"""The named queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.ship import ship

from . import collocations, counts, decontaminate, infill, jaccard, language, mixing, nbsvm, oracles, secrets, tokens, toxicity, vectors, warc
from .staging import bounded, spread


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dedup(_read(spark, sf_dir, "embeddings")).drop("audited_recall")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), size=3, percent=90)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encoded(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts.count(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.restore(infill.transform(_read(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    bounded(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_vectors": op4_vectors,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_tokens": op8_tokens,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_counts": op11_counts,
    "op12_collocations": op12_collocations,
    "op13_infill": op13_infill,
}
ORACLES = {
    "op4_vectors": oracles.VECTORS,
    "op7_jaccard": oracles.JACCARD,
    "op2_mixing": oracles.MIXING,
    "op3_decontamination": oracles.DECONTAMINATION,
    "op5_secrets": oracles.SECRETS,
    "op9_warc": oracles.WARC,
    "op12_collocations": oracles.COLLOCATIONS,
    "op13_infill": oracles.INFILL,
}
