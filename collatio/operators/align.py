"""Alignment of two witnesses and what is derived from it.

Only the opcodes come from Python (the standard library's matcher has no
counterpart in Spark); ratios, mismatches and reports are expressions on them.
Sections are dealt out evenly before the matcher, over a few tasks for each
core, since its cost grows with the square of a section's length.  The aligned
table is worth writing to the shared folder before several reports read it
(plans.chains does so).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.functions.numbers import round_even
from collatio.profiles import HAN_CORPUS, TextProfile
from collatio.schemas import OPCODES

_FIELDS = ("tag", "i1", "i2", "j1", "j2")


def opcodes(autojunk: bool):
    """Function of two text columns: ranges equal, replaced, deleted, inserted."""

    @F.pandas_udf(OPCODES)
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            return [dict(zip(_FIELDS, op)) for op in SequenceMatcher(None, x, y, autojunk=autojunk).get_opcodes()]

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    # never twice: filters that the optimizer infers would call it again
    return align.asNondeterministic()


def word_opcodes(autojunk: bool):
    """As opcodes, over words between white space instead of characters."""

    @F.pandas_udf(OPCODES)
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            return [dict(zip(_FIELDS, op)) for op in SequenceMatcher(None, x.split(), y.split(), autojunk=autojunk).get_opcodes()]

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    # never twice: filters that the optimizer infers would call it again
    return align.asNondeterministic()


def _total(ops: Column, weight) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, o: s + weight(o))


def is_variant(op: Column) -> Column:
    """Whether as many characters are replaced by as many others (null for a null range)."""
    return (op["tag"] == "replace") & (op["i2"] - op["i1"] == op["j2"] - op["j1"])


def ratios(ops: Column, n_a: Column, n_b: Column) -> tuple[Column, Column]:
    """(strict, relaxed): equal characters, and those replaced one for one with them."""
    equal = _total(ops, lambda o: F.when(o["tag"] == "equal", o["i2"] - o["i1"]).otherwise(0))
    variant = _total(ops, lambda o: F.when(is_variant(o), o["i2"] - o["i1"]).otherwise(0))
    total = n_a + n_b
    return (
        F.when(total > 0, 2.0 * equal / total).otherwise(F.lit(1.0)),
        F.when(total > 0, 2.0 * (equal + variant) / total).otherwise(F.lit(0.0)),
    )


def place(sections: DataFrame) -> list[str]:
    """Columns that tell the order of sections: their place in the files, else what comes nearest to it."""
    return [c for c in ("source_file", "section") if c in sections.columns] or [c for c in ("juan_num", "file_name", "source") if c in sections.columns]


def last_per_label(sections: DataFrame, label: str = "juan_label", order: list[str] | None = None) -> DataFrame:
    """Of rows with one label the last, in the order of the columns given, else of their place.

    A null label is a label like others; nulls in the order come first; of
    rows with one place any is kept.  Rows keep all their columns.
    """
    names = [F.col(f"`{c}`") for c in sections.columns]
    newest = F.max_by(F.struct(*names), F.struct(*[F.col(f"`{c}`") for c in order or place(sections)]))
    return sections.groupBy(F.col(f"`{label}`").alias("_label")).agg(newest.alias("_row")).select("_row.*")


def witness_join(a: DataFrame, b: DataFrame, label: str = "juan_label") -> DataFrame:
    """Pairs of sections with one label, as structs a and b; repeats pair with each other, null labels with none."""
    left = a.select(F.col(label).alias("_l"), F.struct("*").alias("a"))
    right = b.select(F.col(label).alias("_r"), F.struct("*").alias("b"))
    return left.join(right, F.col("_l") == F.col("_r")).select("a", "b")


def unmatched(a: DataFrame, b: DataFrame, label: str = "juan_label") -> DataFrame:
    """(label, only_in): labels of one side alone, each once; a null label on either side is reported, as it pairs with none."""
    left = a.select(label).join(b.select(label), label, "left_anti").withColumn("only_in", F.lit("a"))
    right = b.select(label).join(a.select(label), label, "left_anti").withColumn("only_in", F.lit("b"))
    return left.unionByName(right).distinct()


def align(a: DataFrame, b: DataFrame, profile: TextProfile = HAN_CORPUS, autojunk: bool = True) -> DataFrame:
    """Aligned sections: texts proper of both sides, opcodes and ratios.

    a, b: sections.  Of repeated labels the last counts on both sides; null
    labels have no partner; a section without paragraphs has an empty text.
    """
    pairs = witness_join(last_per_label(a), last_per_label(b))
    texts = pairs.select(
        F.col("a.juan_label").alias("juan_label"),
        F.col("a.juan_num").alias("juan_num"),
        T.plain(F.array_join("a.paragraphs", ""), profile).alias("a_text"),
        T.plain(F.array_join("b.paragraphs", ""), profile).alias("b_text"),
        F.length(F.array_join("b.paragraphs", "")).alias("b_all_chars"),
    )
    dealt = texts.repartition(4 * a.sparkSession.sparkContext.defaultParallelism)
    done = dealt.withColumn("ops", opcodes(autojunk)("a_text", "b_text"))
    strict, relaxed = ratios(F.col("ops"), F.length("a_text"), F.length("b_text"))
    return done.withColumn("strict_ratio", strict).withColumn("relaxed_ratio", relaxed)


def mismatches(aligned: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """One row per range that is not equal, with context of side a.

    Pieces are cut inside each section, from its characters, before rows are
    made, so no row carries a section's text.
    """
    ready = aligned.select("juan_label", "juan_num", "ops", T.chars(F.col("a_text")).alias("a"), T.chars(F.col("b_text")).alias("b"))
    changed = F.filter(F.transform("ops", lambda o, i: F.struct(i.alias("op_no"), o.alias("op"))), lambda x: x["op"]["tag"] != "equal")
    piece = lambda chars, start, stop: F.array_join(F.slice(chars, start + 1, F.greatest(stop - start, F.lit(0))), "")

    def row(x):
        op = x["op"]
        return F.struct(
            x["op_no"].alias("op_no"), op["tag"].alias("type"),
            F.concat_ws("-", op["i1"], op["i2"]).alias("a_pos"),
            piece("a", op["i1"], op["i2"]).alias("a_text"),
            piece("b", op["j1"], op["j2"]).alias("b_text"),
            piece("a", F.greatest(F.lit(0), op["i1"] - profile.context), op["i1"]).alias("context_before"),
            piece("a", op["i2"], op["i2"] + profile.context).alias("context_after"),
            is_variant(op).alias("is_variant"),
        )

    return ready.select("juan_label", "juan_num", F.explode(F.transform(changed, row)).alias("m")).select("juan_label", "juan_num", "m.*")


def summary(aligned: DataFrame) -> DataFrame:
    """One row per section: sizes, ratios to four decimals (ties to even), counts."""
    changed = F.filter("ops", lambda o: o["tag"] != "equal")
    variants = F.size(F.filter("ops", is_variant))
    return aligned.select(
        "juan_label", "juan_num",
        F.length("a_text").alias("a_chars"),
        F.length("b_text").alias("b_plain_chars"),
        F.col("b_all_chars").alias("b_with_punct_chars"),
        round_even(F.col("strict_ratio"), 4).alias("strict_ratio"),
        round_even(F.col("relaxed_ratio"), 4).alias("relaxed_ratio"),
        F.size(changed).alias("mismatch_count"),
        variants.alias("variant_count"),
        (F.size(changed) - variants).alias("substantive_count"),
    )


def split_mismatches(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, variant, substantive)."""
    return rows, rows.where("is_variant"), rows.where("NOT is_variant")


def weighted_means(summaries: DataFrame) -> DataFrame:
    """Ratios weighted by length, on the rounded values; 0 for no rows. Totals and shares."""
    weight = F.col("a_chars") + F.col("b_plain_chars")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * weight), F.sum(weight)), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.sum(c), F.sum("mismatch_count")), F.lit(0.0))
    return summaries.agg(
        F.count("*").alias("sections"), mean("strict_ratio").alias("strict"), mean("relaxed_ratio").alias("relaxed"),
        total("a_chars").alias("a_chars"), total("b_plain_chars").alias("b_chars"),
        total("mismatch_count").alias("mismatches"), total("variant_count").alias("variants"), total("substantive_count").alias("substantive"),
        share("variant_count").alias("variant_pct"), share("substantive_count").alias("substantive_pct"),
    )


def type_distribution(rows: DataFrame) -> DataFrame:
    """Counts of the substantive mismatches' types, descending."""
    return rows.where("NOT is_variant").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def lowest(summaries: DataFrame, n: int = 5) -> DataFrame:
    """The n sections of lowest relaxed ratio; of equal ones those of the lower number, then label."""
    return summaries.orderBy("relaxed_ratio", "juan_num", "juan_label").limit(n)
