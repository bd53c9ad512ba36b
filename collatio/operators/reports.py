"""Annotation by keyword, profiles, rollups and distributions.

Shares and means are left unrounded, but in the summaries that are sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.functions.numbers import round_even
from collatio.profiles import HAN_CORPUS, TextProfile

LENGTH_BUCKETS = (("1-3", 3), ("4-10", 10), ("11-30", 30), ("31-60", 60), ("61-100", 100), ("101+", None))


def annotate(rows: DataFrame, text: str = "text_plain", profile: TextProfile = HAN_CORPUS) -> DataFrame:
    """Adds a flag for each keyword and the four-way category."""
    a, b = profile.keyword_names
    c = F.col(text)
    return rows.select("*", c.contains(profile.keywords[0]).alias(f"has_{a}"), c.contains(profile.keywords[1]).alias(f"has_{b}"), T.category(c, profile).alias(f"{a}_{b}_category"))


def _listed(spark, names: list[str], column: str) -> DataFrame:
    """A fixed list as rows (position, name); as long as the list."""
    values = F.array(*[F.lit(n) for n in names])
    return F.broadcast(spark.range(1).select(F.posexplode(values).alias("position", column)))


def distribution(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(position, column, n, share) for every name, those that do not occur too."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    full = _listed(rows.sparkSession, names, column).join(counts, column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0))).orderBy("position")


def bar(share: Column, width: int = 50) -> Column:
    """A bar of blocks for a share of 1."""
    return F.repeat(F.lit("█"), (share * width).cast("int"))


def category_distribution(rows: DataFrame, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    a, b = profile.keyword_names
    return distribution(rows, f"{a}_{b}_category", T.categories(profile))


def bucket(length: Column) -> Column:
    out = None
    for name, top in LENGTH_BUCKETS:
        if top is None:
            return out.otherwise(name)
        out = F.when(length <= top, name) if out is None else out.when(length <= top, name)
    raise AssertionError("the last bucket is open")


def length_histogram(rows: DataFrame, length: str = "char_count") -> DataFrame:
    """Six buckets in order with counts and shares."""
    return distribution(rows.select(bucket(F.col(length)).alias("bucket")), "bucket", [n for n, _ in LENGTH_BUCKETS])


def length_profile(rows: DataFrame, length: str = "char_count") -> DataFrame:
    """Count, mean, extremes, upper median and truncated interpolated median.

    The upper median is the element at n // 2 of the sorted lengths; it is
    taken from the counts of distinct lengths, not from all rows.  An empty
    table gives a count of 0 and nulls.
    """
    counts = rows.groupBy(F.col(length).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    ranked = counts.select("v", "c", F.sum("c").over(upto).alias("upto"), F.sum("c").over(every).alias("n"))
    half = F.floor(F.col("n") / 2)
    first_past = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    low = F.floor((F.col("n") - 1) / 2)
    return ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        first_past(half).alias("upper_median"),
        F.floor((first_past(low) + first_past(half)) / 2).cast("int").alias("median_int"),
    )


def top_groups(rows: DataFrame, group: str, order: list[str], n: int = 10) -> DataFrame:
    """The n groups with most rows; of equal counts that which comes first."""
    counts = rows.groupBy(F.col(f"`{group}`").alias("_group")).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return counts.orderBy(F.desc("_n"), "_first").limit(n).select(F.col("_group").alias(group), F.col("_n").alias("n"))


def conditional_summary(rows: DataFrame, first: str, second: str, length: str | None = None) -> DataFrame:
    """Counts of the combinations of two flags, and a length's profile."""
    a, b = F.coalesce(F.col(first), F.lit(False)), F.coalesce(F.col(second), F.lit(False))
    counts = [
        F.count("*").alias("total"), F.count_if(a).alias("first"), F.count_if(b).alias("second"), F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"),
    ]
    if length:
        counts += [F.avg(length).alias("mean"), F.max(length).alias("max"), F.min(length).alias("min")]
    return rows.agg(*counts)


def by_target(sentences: DataFrame) -> DataFrame:
    """Sentences, distinct letters, characters and mean length of each target."""
    return sentences.groupBy("target_name").agg(
        F.count("*").alias("sentences"), F.countDistinct("letter_data_id").alias("letters"),
        F.sum("char_count_raw").alias("chars_raw"), F.sum("char_count_plain").alias("chars_plain"), F.avg("char_count_plain").alias("mean_length"),
    )


def overall(letters: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row: letters, sentences, characters, characters per sentence."""
    a = letters.agg(F.count("*").alias("letters"), F.coalesce(F.sum("char_count_raw"), F.lit(0)).alias("chars_raw"), F.coalesce(F.sum("char_count_plain"), F.lit(0)).alias("chars_plain"))
    b = sentences.agg(F.count("*").alias("sentences"))
    both = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")  # a row on either side
    return both.withColumn("mean_length", F.coalesce(F.try_divide(F.col("chars_plain"), F.col("sentences")), F.lit(0.0)))


def rollup(rows: DataFrame, outer: str, inner: str, sums: list[str]) -> DataFrame:
    """Groups (outer, inner) and subtotals of outer: level 0 and 1, without the grand total."""
    grouped = rows.rollup(outer, inner).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return grouped.where("level < 3")


def letters_rollup(letters: DataFrame, sentences: DataFrame) -> DataFrame:
    """Targets by volume with subtotals; sentence counts on subtotals only."""
    groups = rollup(letters, "target_name", "kwon", ["char_count_raw", "char_count_plain"])
    counts = sentences.groupBy("target_name").agg(F.count("*").alias("_n"))
    joined = groups.join(counts, "target_name", "left")
    return joined.select(
        "target_name", "kwon", "level", F.col("n").alias("letters"), "char_count_raw", "char_count_plain",
        F.when(F.col("level") == 1, F.coalesce("_n", F.lit(0))).alias("sentences"),
    ).orderBy("target_name", "level", "kwon")


# The items of the corpus summary sheet in order; an empty one is an empty line.
CORPUS_SUMMARY = (
    "[전체] 총 sentence 수", "[전체] 理 포함", "[전체] 氣 포함", "[전체] 理+氣 둘 다", "[전체] 理만 (氣 없음)", "[전체] 氣만 (理 없음)", "[전체] 둘 다 없음",
    "", "[메타] 평균 char_count", "[메타] 중위 char_count", "[메타] 최댓값 char_count", "[메타] 최솟값 char_count",
)
# The totals of the letter summary sheet in order, and its words.
LETTERS_SUMMARY = ("Letter 편수", "문장 수 (sentence)", "총 글자 수 (표점 포함, raw)", "총 글자 수 (백문, plain)", "평균 문장 길이 (백문)")
VOLUME, SUBTOTAL = "권", "합계"


def _items(row: DataFrame, names: tuple[str, ...], values: list[Column]) -> DataFrame:
    """(position, item, value double) of one row."""
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("item"), v.cast("double").alias("value")) for i, (n, v) in enumerate(zip(names, values, strict=True))])
    return row.select(F.explode(each).alias("x")).select("x.*").orderBy("position")


def corpus_summary(sentences: DataFrame, first: str = "has_li", second: str = "has_qi", length: str = "char_count") -> DataFrame:
    """(position, item, value) of the corpus summary sheet: counts of two flags, and the lengths' profile.

    The mean has one decimal, the median is the interpolated one without its
    fraction; of an empty table counts are 0 and lengths null.
    """
    one = F.lit(1).alias("_one")
    row = conditional_summary(sentences, first, second).select("*", one).join(length_profile(sentences, length).select("mean", "median_int", "max", "min", one), "_one")
    counts = [F.col(c) for c in ("total", "first", "second", "both", "first_only", "second_only", "neither")]
    return _items(row, CORPUS_SUMMARY, [*counts, F.lit(None), round_even(F.col("mean"), 1), F.col("median_int"), F.col("max"), F.col("min")])


def letters_totals(letters: DataFrame, sentences: DataFrame) -> DataFrame:
    """(position, item, value) of the letter summary sheet's head; the mean has two decimals, 0 without sentences."""
    values = [F.col(c) for c in ("letters", "sentences", "chars_raw", "chars_plain")]
    return _items(overall(letters, sentences), LETTERS_SUMMARY, [*values, round_even(F.col("mean_length"), 2)])


def letters_blocks(letters: DataFrame, sentences: DataFrame) -> DataFrame:
    """Rows of the letter summary sheet by target: its volumes, then its subtotal, which alone counts sentences."""
    rows = letters_rollup(letters, sentences)
    volume = F.when(F.col("level") == 1, SUBTOTAL).otherwise(F.concat(F.lit(VOLUME), F.col("kwon").cast("string")))
    return rows.select("target_name", volume.alias("volume"), "letters", "char_count_raw", "char_count_plain", "sentences").orderBy("target_name", "level", "kwon")
