"""Sentences of sections and of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.profiles import HAN_CORPUS, HAN_LETTERS, TextProfile
from collatio.storage import materialised


def sentence_pieces(text: Column, profile: TextProfile) -> Column:
    """array<struct<text, plain>>: pieces that hold text proper, in order."""
    pieces = T.split_after(text, profile.terminators)
    both = F.transform(pieces, lambda p: F.struct(p.alias("text"), T.plain(p, profile).alias("plain")))
    return F.filter(both, lambda p: p["plain"] != "")


def sentences(rows: DataFrame, keys: list[str], text: str, profile: TextProfile = HAN_CORPUS, clean_bylines: bool = True) -> DataFrame:
    """rows -> one row per sentence: keys, sentence_idx from 1, text, plain.

    Numbers count kept pieces only, and come from the array's own positions:
    nothing is shuffled.
    """
    source = T.without_bylines(F.col(text), profile) if clean_bylines else F.col(text)
    found = rows.select(*keys, F.posexplode(sentence_pieces(source, profile)).alias("_at", "_piece"))
    return found.select(*keys, (F.col("_at") + 1).alias("sentence_idx"), F.col("_piece.text").alias("text"), F.col("_piece.plain").alias("plain"))


def skipped_pieces(rows: DataFrame, text: str, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """How many pieces are not blank but hold no text proper."""
    pieces = T.split_after(T.without_bylines(F.col(text), profile), profile.terminators)
    return rows.agg(F.coalesce(F.sum(F.size(F.filter(pieces, lambda p: T.plain(p, profile) == ""))), F.lit(0)).alias("skipped"))


def bases(counts: DataFrame, order: list[str], n: str = "n", name: str = "base") -> DataFrame:
    """counts with the sum of n over all rows before it in the order given.

    Rows (one for each section, text by none) are put in order by a range
    partitioning, which is written once so that all sums are over the same
    partitions; only a total for each partition is brought together.  Rows
    that tie in the order must not be told apart; nulls come first.
    """
    held = counts.select(F.struct(*[F.col(f"`{c}`") for c in counts.columns]).alias("r"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], F.col(f"`{n}`").alias("n"))
    keys = [f"o{i}" for i in range(len(order))]
    placed = materialised(held.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("n").alias("whole")).select("part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("lead"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("r", "part", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("upto"))
    # a row for each partition
    return local.join(F.broadcast(totals), "part").select("r.*", (F.col("lead") + F.col("upto")).alias(name))


def number_globally(rows: DataFrame, group: list[str], within: list[str], name: str = "seq") -> DataFrame:
    """Adds a gapless number from 1 in the order (group, within) to rows of any kind.

    Rows are numbered in their group, nulls being a group like others; a
    count for each group gets its base by bases().  rows is read twice.
    Where rows are parts of a section, number_sentences() moves less.
    """
    counts = bases(rows.groupBy(*group).agg(F.count("*").alias("n")), group).select(*[F.col(g).alias(f"_group_{i}") for i, g in enumerate(group)], F.col("base").alias("_group_base"))
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *[F.col(f"`{g}`").alias(f"_key_{i}") for i, g in enumerate(group)])
    local = Window.partitionBy(*[f"_key_{i}" for i in range(len(group))]).orderBy(*[F.col(f"_row.`{w}`") for w in within])
    numbered = held.withColumn("_at", F.row_number().over(local))
    on = None
    for i in range(len(group)):
        each = F.col(f"_key_{i}").eqNullSafe(F.col(f"_group_{i}"))
        on = each if on is None else on & each
    return numbered.join(counts, on).select("_row.*", (F.col("_group_base") + F.col("_at")).alias(name))


def number_sentences(sections: DataFrame, order: list[str], paragraphs: Column, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """(order, paragraph_idx, sentence_idx, seq) of all sentences, numbered from 1 through the sections.

    Sections are told apart by `order`.  Sentences are counted inside each
    paragraph and only the counts move: no text is shuffled, and each section
    is cut once.
    """
    cut = lambda p: F.size(sentence_pieces(T.without_bylines(p, profile), profile))
    counts = sections.select(*order, F.transform(paragraphs, lambda p: F.coalesce(cut(p), F.lit(0))).alias("counts"))
    placed = bases(counts.withColumn("n", F.aggregate("counts", F.lit(0), lambda s, n: s + n).cast("long")), order)
    each = F.flatten(F.transform("counts", lambda n, i: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct((i + 1).alias("p"), k.alias("s")))).otherwise(F.array().cast("array<struct<p:int,s:int>>"))))
    rows = placed.select(*order, "base", F.posexplode(each).alias("at", "x"))
    return rows.select(*order, F.col("x.p").alias("paragraph_idx"), F.col("x.s").alias("sentence_idx"), (F.col("base") + F.col("at") + 1).alias("seq"))


def corpus_sentences(punctuated: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """Punctuated sections -> corpus sentences, numbered through in the order of the files.

    Sections are ordered by their place (source_file, section), else by
    (file_name, juan_num, juan_label), and kept apart even where that ties.
    Ids beyond S999999 grow longer; seq is the order, not the id's text.
    """
    order = [c for c in ("source_file", "section") if c in punctuated.columns] or ["file_name", "juan_num", "juan_label"]
    pieces = F.transform(
        F.arrays_zip("paragraphs_punctuated", "paragraphs_byline"),
        lambda p, i: F.transform(
            F.coalesce(sentence_pieces(T.without_bylines(p["paragraphs_punctuated"], profile), profile), F.array().cast("array<struct<text:string,plain:string>>")),
            lambda x, j: F.struct((i + 1).alias("p"), (j + 1).alias("s"), p["paragraphs_byline"].alias("byline"), x["text"].alias("text"), x["plain"].alias("plain")),
        ),
    )
    # one row for each section, cut once; what is counted and what is put out are the same rows
    cut = materialised(punctuated.select(*dict.fromkeys([*order, "juan_num", "juan_label", "headings"]), F.monotonically_increasing_id().alias("_section"), F.flatten(pieces).alias("_pieces")))
    base = bases(cut.select(*order, "_section", F.size("_pieces").cast("long").alias("n")), [*order, "_section"], name="_base").select("_section", "_base")
    found = cut.join(base, "_section").select("juan_num", "juan_label", "headings", "_base", F.posexplode("_pieces").alias("_at", "x"))
    seq = F.col("_base") + F.col("_at") + 1
    return found.select(
        F.format_string("S%06d", seq).alias("sentence_id"),
        "juan_num", "juan_label", "headings", F.col("x.p").alias("paragraph_idx"), F.col("x.s").alias("sentence_idx"),
        F.format_string("%s#p%03d", "juan_label", "x.p").alias("utterance_id"),
        F.col("x.text").alias("text_punctuated"), F.col("x.plain").alias("text_plain"),
        F.length("x.plain").alias("char_count"), F.col("x.byline").alias("byline"), seq.alias("seq"),
    )


def letter_sentences(letters: DataFrame, profile: TextProfile = HAN_LETTERS) -> DataFrame:
    """Letters -> sentences, numbered in the paragraph and in the letter.

    Empty paragraphs count; a letter without text gives no row.
    """
    paras = F.filter(F.transform(F.split("raw_text", T.quote(profile.paragraph_separator)), lambda p, i: F.struct(i.alias("k"), sentence_pieces(p, profile).alias("s"))), lambda p: F.size(p["s"]) > 0)
    flat = F.flatten(F.transform(paras, lambda p: F.transform(p["s"], lambda s, i: F.struct((p["k"] + 1).alias("para"), (i + 1).alias("in_para"), s["text"].alias("text"), s["plain"].alias("plain")))))
    rows = letters.where("raw_text <> ''").select("*", F.posexplode(flat).alias("in_letter", "s"))
    return rows.select(
        F.format_string("%s_p%d_s%d", "data_id", "s.para", "s.in_para").alias("sentence_id"),
        F.col("data_id").alias("letter_data_id"), "munjip", "kwon",
        F.col("seq").alias("letter_seq"), F.col("title").alias("letter_title"), F.col("inferred_year").alias("letter_year"),
        "sender_label", "target_name",
        F.col("s.para").alias("para_idx"), F.col("s.in_para").alias("sent_idx_in_para"), (F.col("in_letter") + 1).alias("sent_idx_in_letter"),
        F.col("s.text").alias("sent_text"), F.col("s.plain").alias("sent_text_plain"),
        F.length("s.text").alias("char_count_raw"), F.length("s.plain").alias("char_count_plain"),
    )
