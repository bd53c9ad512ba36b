"""The three chains of the engine.  What several results of one chain read is written to the shared folder once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from collatio.operators import align, letters, parse, reports, segment, transfer
from collatio.profiles import HAN_CORPUS, HAN_LETTERS, TextProfile
from collatio.sources import readers
from collatio.storage import materialised


@dataclass
class Collation:
    aligned: DataFrame
    summary: DataFrame
    mismatches: DataFrame
    only_in_one: DataFrame


def collate(a: DataFrame, b: DataFrame, profile: TextProfile = HAN_CORPUS) -> Collation:
    """Two parsed witnesses -> agreement report; the matcher runs once, before this returns."""
    aligned = materialised(align.align(a, b, profile))
    return Collation(aligned, align.summary(aligned), align.mismatches(aligned, profile), align.unmatched(a, b))


@dataclass
class Corpus:
    punctuated: DataFrame
    spans: DataFrame
    sentences: DataFrame


def corpus(a: DataFrame, b: DataFrame, profile: TextProfile = HAN_CORPUS) -> Corpus:
    """Two parsed witnesses -> punctuated sections -> annotated sentences; the matcher runs once, before this returns."""
    done = materialised(transfer.marked(a, b, profile))
    sections = transfer.punctuated(done, profile)
    return Corpus(sections, transfer.spans(done, profile), reports.annotate(segment.corpus_sentences(sections, profile), profile=profile))


def read_witnesses(spark: SparkSession, marked_path: str, tei_path: str, profile: TextProfile = HAN_CORPUS) -> tuple[DataFrame, DataFrame]:
    a = parse.parse_marked_text(readers.marked_text(spark, marked_path), profile)
    return a, parse.parse_tei_items(readers.tei(spark, tei_path), profile)


def letter_corpus(spark: SparkSession, zip_path: str, target_file: str | None = None, profile: TextProfile = HAN_LETTERS) -> tuple[DataFrame, DataFrame]:
    """(letters, sentences) of the targets' volumes."""
    wanted, known = readers.targets(spark, target_file), readers.collections(spark)
    letters.check_targets(wanted, known)
    table = letters.select_letters(readers.letters(spark, zip_path, wanted, known), wanted, known, profile)
    return table, segment.letter_sentences(table, profile)
