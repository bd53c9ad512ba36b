from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.profiles import HAN_CORPUS, HAN_LETTERS


def one(spark, make, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_numerals(spark):
    got = [one(spark, lambda c: T.volume_number(c, True), v) for v in ("卷一", "卷十", "卷十二", "卷二十", "卷一百四十", "提要", "x", "卷一二")]
    assert got == [1, 10, 12, 20, 140, 0, -1, 2]
    assert one(spark, lambda c: T.volume_number(c, False), "x提要") == -1
    assert one(spark, lambda c: T.volume_number(c, True), "x提要") == 0


def test_keep_and_drop(spark):
    assert one(spark, lambda c: T.plain(c, HAN_CORPUS), "理𠮟a。○") == "理𠮟"
    assert one(spark, lambda c: T.plain(c, HAN_LETTERS), "理，○a。 　x") == "理○ax"
    assert one(spark, T.drop_marks_and_separators, "a，b c。") == "abc"
    assert one(spark, T.strip, "　 a b \x1c ") == "a b"


def test_lines_like_splitlines(spark):
    for text in ("a\nb", "a\r\nb\n", "a\x85b c", "\x0ca", "", "\n\n"):
        assert one(spark, T.lines, text) == text.splitlines()


def test_split(spark):
    assert one(spark, lambda c: T.split_after(c, "。？！；"), "甲。乙；丙，丁") == ["甲。", "乙；", "丙，丁"]
    assert one(spark, lambda c: T.split_after(c, "。？！"), "甲。乙；丙，丁") == ["甲。", "乙；丙，丁"]
    assert one(spark, lambda c: T.split_after(c, "。"), "甲。」乙。") == ["甲。", "」乙。"]


def test_bylines(spark):
    def both(c):
        text, note = T.trailing_byline(c, HAN_CORPUS, 80)
        return F.struct(text.alias("t"), note.alias("n"))

    assert tuple(one(spark, both, "甲乙(丙/)")) == ("甲乙", "(丙/)")
    assert tuple(one(spark, both, "甲乙(丙)")) == ("甲乙(丙)", None)
    assert tuple(one(spark, both, "甲(乙乙乙乙乙乙乙乙/)")) == ("甲(乙乙乙乙乙乙乙乙/)", None)
    assert one(spark, lambda c: T.without_bylines(c, HAN_CORPUS), "甲(丙/)乙(丁)") == "甲乙(丁)"


def test_category_year_and_predictions(spark):
    assert [one(spark, lambda c: T.category(c, HAN_CORPUS), v) for v in ("理氣", "理", "氣", "天")] == ["both", "li_only", "qi_only", "neither"]
    assert one(spark, T.sexagenary_year, "壬申己未") == 1559
    assert one(spark, T.sexagenary_year, "天") is None
    preds = F.array(F.struct(F.lit(1).alias("end"), F.lit("B-1").alias("entity")), F.struct(F.lit(2).alias("end"), F.lit("O").alias("entity")), F.struct(F.lit(1).alias("end"), F.lit("B-2").alias("entity")))
    marks = F.create_map(F.lit("B-1"), F.lit("，"), F.lit("B-2"), F.lit("。"), F.lit("O"), F.lit(""))
    assert one(spark, lambda c: T.apply_predictions(c, preds, marks), "甲乙") == "甲。乙"
