"""From raw documents to packed training shards: five stages, each written before the next reads it.

toxicity -> SimHash near-duplicates -> benchmark decontamination -> source mixing -> token shards.
Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewatch.llm import bk_dedup, decontaminate, deobfuscate, mixing, token_pack
from pagewatch.llm.tables import table
from pagewatch.session import scratch_root


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; null and empty texts stay.

    The score is learnt from those labelled rows that are among ``docs``. A null doc_id has
    no label. Repeated rows fare alike; other columns pass through; no rows give no rows.
    """
    return deobfuscate.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near-duplicates, one with the smallest doc_id, null last.

    Texts without words, null ones included, are one group. Rows that repeat a doc_id stay
    apart if their texts are in different groups. Other columns pass through; no rows give
    no rows.
    """
    return bk_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts stay.

    Rows with the same doc_id, null included, share one verdict. Other columns pass through;
    no rows give no rows.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order, a row per copy that training takes, 3 at most.

    Texts without words are not in the mix. A null source is a source. Other columns pass
    through; no rows give no rows.
    """
    return mixing.mix_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed shards' documents, read back: doc_id, start, n_tokens and ids_crc32 of each copy.

    Shards hold documents by ascending doc_id; the training order of the mix is given up here.
    Null texts are empty; a null doc_id comes first; no rows give no rows.
    """
    return token_pack.packed(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", pack_tokens),
]
# Viterbi decoding, BK-trees and a tokenizer are beyond SQL; the tests hold the rows against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch_root(spark)}/pagewatch-corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
