"""Transfer of marks from witness b to witness a, character by character.

Opcodes tile a, so each of its characters is given out once, in order, and the
units (character, marks behind it) of a paragraph are a slice of the section's
units: no map of offsets is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.operators.align import is_variant, last_per_label, opcodes, place
from collatio.profiles import HAN_CORPUS, TextProfile


def _units(a_chars: Column, marks: Column, ops: Column) -> Column:
    """array<struct<c, m>> of a's characters and the marks that go behind them."""

    def of(op):
        paired = (op["tag"] == "equal") | is_variant(op)
        places = F.filter(F.sequence(op["i1"], F.greatest(op["i1"], op["i2"] - 1)), lambda q: q < op["i2"])
        return F.transform(
            places,
            lambda q: F.struct(
                F.get(a_chars, q).alias("c"),
                F.when(paired, F.coalesce(F.get(marks, op["j1"] + q - op["i1"]), F.lit(""))).otherwise(F.lit("")).alias("m"),
            ),
        )

    return F.flatten(F.transform(ops, of))


def _text(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: F.concat(u["c"], u["m"])), "")


def _provenance(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: F.concat(F.lit(" "), F.repeat(F.lit("Z"), F.length(u["m"])))), "")


def transfer(texts: DataFrame, profile: TextProfile = HAN_CORPUS, extra: list[str] | None = None, autojunk: bool = False) -> DataFrame:
    """(paragraphs array<string>, b_text) -> units, out_text, provenance, ops.

    a enters as it is, b loses everything outside the profile's class, which
    becomes the marks behind the character before it; what leads b is dropped.
    """
    b_chars, marks = T.marks_after(F.col("b_text"), profile)
    ready = texts.select(
        *(extra or []), "paragraphs", F.array_join("paragraphs", "").alias("a_text"),
        F.array_join(b_chars, "").alias("b_plain"), marks.alias("marks"),
    )
    done = ready.withColumn("ops", opcodes(autojunk)("a_text", "b_plain"))
    # the characters are split once, not for each opcode
    done = done.withColumn("a_chars", T.chars(F.col("a_text")))
    done = done.withColumn("units", _units(F.col("a_chars"), F.col("marks"), F.col("ops")))
    return done.withColumn("out_text", _text(F.col("units"))).withColumn("provenance", _provenance(F.col("units")))


def _paragraph_slices(make) -> Column:
    """make() of the units of every paragraph."""
    ends = F.aggregate(
        "paragraphs",
        F.array(F.lit(0)).cast("array<int>"),
        lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + F.length(p))),
    )
    bounds = F.zip_with(F.slice(ends, 1, F.size("paragraphs")), "paragraphs", lambda s, p: F.struct(s.alias("s"), F.length(p).alias("n")))
    return F.transform(bounds, lambda b: make(F.slice("units", b["s"] + 1, b["n"])))


def fallback_spans(done: DataFrame, profile: TextProfile = HAN_CORPUS, label: str = "juan_label", extra: list[str] | None = None) -> DataFrame:
    """Ranges of a that got no marks: unequal replacements and long deletions.

    Offsets in the output run along the opcodes once, and pieces are cut
    inside each section, from its characters, before rows are made.
    """
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("no"), F.array().cast("array<struct<op_no:int,kind:string,op:struct<tag:string,i1:int,i2:int,j1:int,j2:int>,start:int>>").alias("found"))

    def step(s, op):
        unequal = (op["tag"] == "replace") & ~is_variant(op)
        long = (op["tag"] == "delete") & (op["i2"] - op["i1"] > profile.small_delete)
        kind = F.when(unequal, "replace_lendiff").otherwise("delete_large")
        own = F.struct(s["no"].alias("op_no"), kind.alias("kind"), op.alias("op"), s["at"].alias("start"))
        written = F.length(_text(F.slice("units", op["i1"] + 1, op["i2"] - op["i1"])))
        return F.struct((s["at"] + written).alias("at"), (s["no"] + 1).alias("no"), F.when(unequal | long, F.concat(s["found"], F.array(own))).otherwise(s["found"]).alias("found"))

    ready = done.select(label, *(extra or []), "a_chars", T.chars(F.col("b_plain")).alias("b_chars"), T.chars(F.col("out_text")).alias("out_chars"), F.aggregate("ops", state, step, lambda s: s["found"]).alias("found"))
    piece = lambda chars, start, stop: F.array_join(F.slice(chars, start + 1, F.greatest(stop - start, F.lit(0))), "")

    def row(x):
        op, start = x["op"], x["start"]
        stop = start + op["i2"] - op["i1"]
        return F.struct(
            x["op_no"].alias("op_no"), x["kind"].alias("type"), op["i1"].alias("k_start"), op["i2"].alias("k_end"),
            piece("a_chars", op["i1"], op["i2"]).alias("k_text"), piece("b_chars", op["j1"], op["j2"]).alias("z_text"),
            piece("out_chars", F.greatest(F.lit(0), start - profile.fallback_context), start).alias("context_before"),
            piece("out_chars", stop, stop + profile.fallback_context).alias("context_after"),
            start.alias("out_start"), stop.alias("out_end"),
        )

    return ready.select(label, *(extra or []), F.explode(F.transform("found", row)).alias("s")).select(label, *(extra or []), "s.*")


def marked(a: DataFrame, b: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """Sections of a with the opcodes, units and output of their partner in b; without partner these are null.

    a keeps repeated labels, of b the last counts; a null label has no
    partner.  This is the table that punctuated() and spans() read; it is
    worth writing to the shared folder once.
    """
    partner = last_per_label(b).select(F.col("juan_label").alias("_label"), F.array_join("paragraphs", "").alias("b_text"))
    joined = a.join(partner, F.col("juan_label") == F.col("_label"), "left").withColumn("matched", F.col("_label").isNotNull())
    dealt = joined.repartition(4 * a.sparkSession.sparkContext.defaultParallelism)
    keys = ["juan_num", "juan_label", "file_name", "headings", "paragraphs_byline", "matched", *[c for c in place(a) if c in ("source_file", "section")]]
    return transfer(dealt, profile, keys)


def punctuated(done: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """Punctuated sections of marked(); those without partner pass through without marks."""
    lendiff = F.filter("ops", lambda o: (o["tag"] == "replace") & ~is_variant(o))
    long = F.filter("ops", lambda o: (o["tag"] == "delete") & (o["i2"] - o["i1"] > profile.small_delete))
    blank = F.transform("paragraphs", lambda p: F.repeat(F.lit(" "), F.length(p)))
    return done.select(
        "juan_num", "juan_label", "file_name", "headings", F.col("paragraphs").alias("paragraphs_plain"),
        F.when(F.col("matched"), _paragraph_slices(_text)).otherwise(F.col("paragraphs")).alias("paragraphs_punctuated"),
        F.when(F.col("matched"), _paragraph_slices(_provenance)).otherwise(blank).alias("paragraphs_provenance"),
        "paragraphs_byline",
        F.when(F.col("matched"), F.size(lendiff) + F.size(long)).otherwise(0).alias("fallback_span_count"),
        "matched", *[c for c in ("source_file", "section") if c in done.columns],
    )


def spans(done: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """Fallback spans of the sections of marked() that have a partner."""
    return fallback_spans(done.where("matched"), profile)


def punctuate(a: DataFrame, b: DataFrame, profile: TextProfile = HAN_CORPUS) -> tuple[DataFrame, DataFrame]:
    """(punctuated sections, fallback spans) of sections a with the marks of b; each runs the matcher."""
    done = marked(a, b, profile)
    return punctuated(done, profile), spans(done, profile)


def fallback_statistics(spans: DataFrame) -> DataFrame:
    """(type, n, chars) of the spans by type; a type without spans gives no row."""
    return spans.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("k_end") - F.col("k_start")).alias("chars")).orderBy("type")


def transfer_totals(punctuated: DataFrame) -> DataFrame:
    """Paragraphs, output characters and transferred marks of matched sections."""
    marks = lambda p: F.length(F.regexp_replace(p, "[^Z]", ""))
    return punctuated.where("matched").agg(
        F.coalesce(F.sum(F.size("paragraphs_punctuated")), F.lit(0)).alias("paragraphs"),
        F.coalesce(F.sum(F.length(F.array_join("paragraphs_punctuated", ""))), F.lit(0)).alias("out_chars"),
        F.coalesce(F.sum(marks(F.array_join("paragraphs_provenance", ""))), F.lit(0)).alias("marks"),
    )
