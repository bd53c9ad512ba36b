"""Parsing of the two witnesses into sections.

Marked-up text is parsed as lines with window functions: the section of a line
is the running number of section headers, its paragraph the running number of
lines that close one.  XML arrives as one row for each heading or paragraph in
walking order (sources.tei), and is finished here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.profiles import COVER_PATTERNS, FRONT_SECTIONS, HAN_CORPUS, TRAILING_COVER, TextProfile

_PAGE = "<pb:[^>]+>"
_HEADER = r"(?U)^#\+PROPERTY:\s*JUAN\s+(.+?)\s*$"


def is_cover(content: Column) -> Column:
    return content.rlike("(?U)" + "|".join(f"(?:{p})" for p in COVER_PATTERNS))


def classify_lines(files: DataFrame) -> DataFrame:
    """(file_name, text) -> one row per line with its section, paragraph and role.

    role: header, heading, body, or null for lines that only end or skip.
    """
    raw = files.select("file_name", F.posexplode(T.lines(F.col("text"))).alias("line_no", "raw"))
    label = F.regexp_extract("raw", _HEADER, 1)
    marked = raw.select(
        "file_name", "line_no",
        F.col("raw").startswith("#").alias("hashed"),
        F.when(F.col("raw").startswith("#") & (label != ""), label).alias("label"),
        T.rstrip(F.replace(F.regexp_replace("raw", _PAGE, ""), F.lit("¶"), F.lit(""))).alias("cleaned"),
    )
    order = Window.partitionBy("file_name").orderBy("line_no")
    indent = F.length(F.regexp_extract("cleaned", r"^\x{3000}*", 0))
    placed = marked.select(
        "*",
        F.count("label").over(order).alias("section"),
        F.last("label", ignorenulls=True).over(order).alias("juan_label"),
        indent.alias("indent"),
    ).withColumn("content", F.expr("substr(cleaned, indent + 1)"))
    blank = F.col("cleaned") == ""
    front_body = F.col("juan_label").isin(*FRONT_SECTIONS) & (F.col("indent") == 4)
    titled = F.col("indent").between(2, 4) & ~F.coalesce(front_body, F.lit(False))
    role = (
        F.when(F.col("label").isNotNull(), "header")
        .when(F.col("hashed") | blank | is_cover(F.col("content")), None)
        .when(titled, "heading")
        .otherwise("body")
    )
    ends = (
        F.when(F.col("label").isNotNull(), True)
        .when(F.col("hashed"), False)
        .otherwise(blank | is_cover(F.col("content")) | titled | (F.col("indent") == 0) | (F.col("indent") >= 5))
    )
    return placed.select("file_name", "line_no", "section", "juan_label", "indent", "content", role.alias("role"), ends.alias("ends")).withColumn(
        "island", F.sum(F.col("ends").cast("int")).over(Window.partitionBy("file_name", "section").orderBy("line_no"))
    )


def _joined(name: str) -> Column:
    """Contents of a group in line order, as one text."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", name)))
    return F.array_join(F.transform(ordered, lambda x: x[name]), "")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(file_name, section, line_no, text): the lines of every island as one text."""
    body = lines.where("section > 0 AND role = 'body'")
    return body.groupBy("file_name", "section", "island").agg(F.min("line_no").alias("first"), _joined("content").alias("text")).select("file_name", "section", F.col("first").alias("line_no"), "text")


def parse_marked_text(files: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """(file_name, text) -> sections; text before the first header is discarded.

    Rows come in no order; (source_file, section) is their place.  A null or
    empty text has no section; a file that is given twice is not foreseen (its
    sections would share a place).
    """
    lines = classify_lines(files)
    headers = lines.where("role = 'header'").select("file_name", "section", "juan_label")
    heads = (
        lines.where("section > 0 AND role = 'heading'")
        .groupBy("file_name", "section")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", F.col("indent").alias("level"), F.col("content").alias("text")))).alias("heads"))
    )
    clean, byline = T.trailing_byline(F.col("text"), profile, 80)
    parts = paragraphs(lines).select("file_name", "section", "line_no", "text", clean.alias("clean"), byline.alias("byline"))
    rows = parts.groupBy("file_name", "section").agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "clean", "byline"))).alias("paras"))
    joined = headers.join(heads, ["file_name", "section"], "left").join(rows, ["file_name", "section"], "left")
    return joined.select(
        T.volume_number(F.col("juan_label"), anywhere=True).alias("juan_num"),
        "juan_label", "file_name", F.lit(None).cast("string").alias("source"),
        *_arrays("heads", "paras"),
        F.col("file_name").alias("source_file"), F.col("section").cast("long").alias("section"),
    )


def _arrays(heads: str, paras: str) -> list[Column]:
    h = F.coalesce(F.col(heads), F.array().cast("array<struct<line_no:int,level:int,text:string>>"))
    p = F.coalesce(F.col(paras), F.array().cast("array<struct<line_no:int,text:string,clean:string,byline:string>>"))
    return [
        F.transform(h, lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"))).alias("headings"),
        F.transform(p, lambda x: x["clean"]).alias("paragraphs"),
        F.transform(p, lambda x: x["text"]).alias("paragraphs_raw"),
        F.transform(p, lambda x: F.when(x["byline"].isNotNull(), F.struct(x["byline"].alias("raw")))).alias("paragraphs_byline"),
        F.array_join(F.transform(p, lambda x: x["clean"]), "").alias("raw_concat"),
    ]


def drop_repeats(rows: DataFrame, by: list[str], text: str = "text", order: str = "line_no", limit: int = HAN_CORPUS.repeat_limit) -> DataFrame:
    """Texts that occur limit times or more in a group keep their first row only.

    Nulls are a group and a text like others; of rows with one place any is
    the first.  Rows keep all their columns, whatever their names.
    """
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"))
    same = Window.partitionBy(*[F.col(f"r.`{c}`") for c in (*by, text)])
    counted = packed.withColumn("n", F.count("*").over(same)).withColumn("k", F.row_number().over(same.orderBy(F.col(f"r.`{order}`"))))
    return counted.where((F.col("n") < limit) | (F.col("k") == 1)).select("r.*")


def parse_tei_items(items: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """Items of sources.tei -> sections of the XML witness.

    items: (file_name, section, juan_label, line_no, kind, level, raw, clean,
    byline, cover); kind is section, heading or text.
    """
    text = items.where("kind = 'text'")
    ended = lambda name: F.when(F.col("cover"), T.rstrip(F.regexp_replace(name, f"(?U){TRAILING_COVER}{T.SPACE}*$", ""))).otherwise(F.col(name))
    text = text.select("file_name", "section", "line_no", ended("raw").alias("text"), ended("clean").alias("stripped"), "byline")
    cut, found = T.trailing_byline(F.col("stripped"), profile)
    text = text.select(
        "file_name", "section", "line_no", "text",
        T.without_bylines(F.when(F.col("byline").isNull(), cut).otherwise(F.col("stripped")), profile).alias("clean"),
        F.coalesce("byline", found).alias("byline"),
    ).where("clean <> ''")
    text = drop_repeats(text, ["file_name", "section"], "clean", limit=profile.repeat_limit)
    rows = text.groupBy("file_name", "section").agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "clean", "byline"))).alias("paras"))
    heads = (
        items.where("kind = 'heading'")
        .groupBy("file_name", "section")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "level", F.col("raw").alias("text")))).alias("heads"))
    )
    headers = items.where("kind = 'section'").select("file_name", "section", "juan_label")
    joined = headers.join(heads, ["file_name", "section"], "left").join(rows, ["file_name", "section"], "left")
    return joined.select(
        T.volume_number(F.col("juan_label"), anywhere=False).alias("juan_num"),
        "juan_label", F.lit(None).cast("string").alias("file_name"), F.lit("tei").alias("source"),
        *_arrays("heads", "paras"),
        F.col("file_name").alias("source_file"), F.col("section").cast("long").alias("section"),
    )


def missing_numbers(rows: DataFrame, column: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Numbers from first to last (else from the least to the largest held) that the column does not hold.

    Nulls and repeats count for nothing; a column without numbers misses none.
    """
    held = rows.select(F.col(column).cast("long").alias("_number"))
    if first is None or last is None:
        low, high = held.agg(F.min("_number"), F.max("_number")).first()
        if low is None:
            return held.where("false").withColumnRenamed("_number", column)
        first, last = low if first is None else first, high if last is None else last
    wanted = rows.sparkSession.range(first, last + 1).withColumnRenamed("id", "_number")
    return wanted.join(held, "_number", "left_anti").withColumnRenamed("_number", column)


def failed_labels(sections: DataFrame) -> DataFrame:
    """Labels without a number, one row for each such section; a null label has the number null and is none."""
    return sections.where("juan_num = -1").select("juan_label")


def stage_counters(sections: DataFrame) -> DataFrame:
    """Records, paragraphs, characters, bylines and their share."""
    return sections.agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(F.size("paragraphs")), F.lit(0)).alias("paragraphs"),
        F.coalesce(F.sum(F.length("raw_concat")), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.size(F.filter("paragraphs_byline", lambda b: b.isNotNull()))), F.lit(0)).alias("bylines"),
    ).withColumn("byline_share", F.col("bylines") / F.greatest(F.col("paragraphs"), F.lit(1)))
