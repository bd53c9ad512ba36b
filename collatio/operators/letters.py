"""Letters: selection by target and projection to the letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.profiles import HAN_LETTERS, TextProfile


def select_letters(found: DataFrame, targets: DataFrame, collections: DataFrame, profile: TextProfile = HAN_LETTERS) -> DataFrame:
    """Letters of the archives that a target names -> letter table.

    found: rows of sources.letters (munjip, source_zip, source_xml_path, kwon,
    asked_kwon, seq, data_id, title, annotation, paragraphs); targets: schema
    TARGET; the title pattern may match anywhere.  A letter that several
    targets name is given once for each.  Targets and collections are
    configuration, a few rows.
    """
    wanted = targets.join(F.broadcast(collections.select("munjip", "zip_name")), "munjip").select("target_name", "munjip", F.explode("kwon").alias("asked_kwon"), "title_pattern", F.coalesce("label", F.lit("")).alias("sender_label"))
    rows = found.join(F.broadcast(wanted), ["munjip", "asked_kwon"]).where(F.expr("title rlike title_pattern"))
    rows = rows.withColumn("raw_text", F.array_join("paragraphs", profile.paragraph_separator))
    rows = rows.withColumn("plain_text", T.plain(F.col("raw_text"), profile))
    return rows.select(
        "data_id", "munjip", "kwon", "seq", "title", "annotation",
        T.sexagenary_year(F.col("annotation")).alias("inferred_year"),
        "raw_text", "plain_text",
        F.length(F.replace("raw_text", F.lit("\n"), F.lit(""))).alias("char_count_raw"),
        F.length("plain_text").alias("char_count_plain"),
        F.substring("plain_text", 1, 50).alias("body_first_50"),
        "sender_label", "target_name", "source_zip", "source_xml_path",
        F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("fetched_at"),
    )


def check_targets(targets: DataFrame, collections: DataFrame) -> None:
    """Raises ValueError if a target names an unknown collection."""
    unknown = [r.munjip for r in targets.join(collections, "munjip", "left_anti").select("munjip").distinct().collect()]
    if unknown:
        raise ValueError(f"unknown collections: {sorted(unknown)}")


def with_letter(sentences: DataFrame, letters: DataFrame) -> DataFrame:
    """Sentences with their letter's columns as a struct; a sentence without letter (null ids too) gives no row."""
    side = letters.select(F.col("data_id").alias("_id"), F.col("target_name").alias("_target"), F.struct("*").alias("letter"))
    return sentences.join(side, (sentences.letter_data_id == F.col("_id")) & (sentences.target_name == F.col("_target"))).drop("_id", "_target")


def index_by_target(letters: DataFrame) -> DataFrame:
    """Per target, volume and number: the listing of the provenance report."""
    return letters.select("target_name", "kwon", "seq", "data_id", "title", "annotation", "inferred_year", "char_count_plain").orderBy("target_name", "kwon", "seq")
