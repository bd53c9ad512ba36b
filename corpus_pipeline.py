"""From raw documents to token ids: five stages, each over all rows that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from collatio.llm import decontam, exact_dedup, sentencepiece_codec, simhash, toxicity
from collatio.llm.common import fresh_path, remove, retain, table
from collatio.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold.

    The model is fitted on the labelled rows of `documents`.  Null and empty
    texts score as the bias, so they stay where labels of 1 are few; repeated
    rows are judged alike; an empty table gives an empty table.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    Null and empty texts are equal, a null id stays only where there is no
    other, of rows repeated in id and text one stays.
    """
    return retain(docs, exact_dedup.kept_keys(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest doc_id.

    Texts link if their sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; null, empty and blank texts are one group; a null id
    stays only where there is no other; of repeated rows one stays.
    """
    return retain(docs, simhash.kept_keys(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay, repeated rows are judged alike,
    and a benchmark without items rejects nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded texts, decoded again.

    A row for each document; null and empty texts have begin and end alone.
    """
    return sentencepiece_codec.round_trip_digest(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`.

    What a stage returns is written to the shared folder and read again, so a
    lost executor repeats one stage at most; what a stage has read is removed
    once the next is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs


#: Trained scores and components of near copies have no SQL form.
ORACLE_SQL = None
