"""From raw documents to token files: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents, whatever other columns there are and whatever their names; the last returns a
row a document copy. Every stage runs on empty tables and returns none or all of their rows accordingly; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, jaccard, mixing, tokens, toxicity
from quern.llm.staging import Stages, bounded, scope, spread
from quern.plans.ship import ship

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity grammar rejects.

    Null and empty texts match nothing and stay; rows that share an id or a text are judged one by one; a score of the limit itself goes; a
    missing label is none.
    """
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of near copies (five words, 0.8).

    Texts without words, and rows without id, belong to no group and stay; rows that share an id are told apart by their texts, and of those
    with the same text one stays; a similarity of the limit itself links.
    """
    return jaccard.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark window.

    Null and empty texts hold none and stay; items without id or words match nothing; rows that share an id or a text are judged one by one.
    """
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; null and empty texts have no words and are taken as often as their source is taken whole; rows that repeat in id, source
    and words draw alike; rows without id draw by their texts.
    """
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; null ids come first; copies of a document are rows of their own, one after another.
    """
    import public_tokenizers

    return tokens.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", clean), ("near_copies", distinct), ("decontamination", unseen), ("mixing", mixed), ("tokens", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs, before = spread(_table(spark, sf_dir, "documents")), None
    for name, stage in STAGES[:-1]:
        with scope():  # what a stage staged goes once its rows are written
            docs = stages.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            stages.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The rANS round trip, the learned lexicon and near copies are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
