import json
import zipfile
from statistics import median
from xml.etree import ElementTree

import pytest

from collatio.operators import reports, segment
from collatio.plans import chains
from collatio.sources import writers
from collatio.streaming import sentences as streams


def punctuated(spark, rows):
    schema = "juan_num int, juan_label string, file_name string, headings array<struct<level:int,text:string>>, paragraphs_punctuated array<string>, paragraphs_byline array<struct<raw:string>>"
    return spark.createDataFrame(rows, schema)


def corpus(spark):
    return segment.corpus_sentences(punctuated(spark, [(1, "卷一", "a", [(2, "h")], ["甲理。。乙", "氣；(丙/)理氣"], [None, ("(x/)",)]), (2, "卷二", "b", [], ["丁！"], [None])]))


def test_corpus_sentences(spark):
    got = [(r.sentence_id, r.utterance_id, r.sentence_idx, r.text_punctuated, r.text_plain) for r in corpus(spark).orderBy("sentence_id").collect()]
    assert got == [
        ("S000001", "卷一#p001", 1, "甲理。", "甲理"), ("S000002", "卷一#p001", 2, "乙", "乙"),
        ("S000003", "卷一#p002", 1, "氣；", "氣"), ("S000004", "卷一#p002", 2, "理氣", "理氣"), ("S000005", "卷二#p001", 1, "丁！", "丁"),
    ]


@pytest.mark.parametrize("values", [[1, 2, 3, 4], [5], [1, 1, 9], list(range(7)), [2, 2, 2, 40]])
def test_profile(spark, values):
    r = reports.length_profile(spark.createDataFrame([(v,) for v in values], "char_count int")).first()
    assert (r.n, r.min, r.max, r.mean) == (len(values), min(values), max(values), sum(values) / len(values))
    assert (r.upper_median, r.median_int) == (sorted(values)[len(values) // 2], int(median(values)))


def test_empty_reports(spark):
    none = spark.createDataFrame([], "char_count int, li_qi_category string")
    assert reports.length_profile(none).first().n == 0
    assert [r.n for r in reports.length_histogram(none).collect()] == [0] * 6
    assert [r.share for r in reports.category_distribution(none).collect()] == [0.0] * 4


def test_annotation_and_top(spark):
    rows = reports.annotate(corpus(spark))
    assert [(r.li_qi_category, r.n) for r in reports.category_distribution(rows).collect()] == [("both", 1), ("li_only", 1), ("qi_only", 1), ("neither", 2)]
    assert [tuple(r) for r in reports.top_groups(rows, "juan_label", ["sentence_id"], 1).collect()] == [("卷一", 4)]


def test_letters_rollup(spark):
    letters = spark.createDataFrame([("t", 1, 10, 5), ("t", 2, 20, 6), ("u", 1, 1, 1)], "target_name string, kwon int, char_count_raw int, char_count_plain int")
    sents = spark.createDataFrame([("t",), ("t",)], "target_name string")
    got = [(r.target_name, r.kwon, r.letters, r.char_count_raw, r.sentences) for r in reports.letters_rollup(letters, sents).collect()]
    assert got == [("t", 1, 1, 10, None), ("t", 2, 1, 20, None), ("t", None, 2, 30, 2), ("u", 1, 1, 1, None), ("u", None, 1, 1, 0)]
    r = reports.overall(letters, sents).first()
    assert (r.letters, r.sentences, r.mean_length) == (3, 2, 6.0)


def test_json_csv(spark, tmp_path):
    df = spark.createDataFrame([("理\n\"a\",b", None)], "x string, y int")
    writers.json_lines(df, str(tmp_path / "j"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {"x": "理\n\"a\",b", "y": None}
    writers.json_lines(df.limit(0), str(tmp_path / "j"), "ignore")
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    writers.csv(df, str(tmp_path / "c"), ["y", "x", "z"])
    writers.single(str(tmp_path / "c"), str(tmp_path / "c.csv"), bom=True)
    raw = (tmp_path / "c.csv").read_text("utf-8")
    assert raw.startswith("﻿y,x,z\n")
    assert '"理\n""a"",b"' in raw


def test_workbook(spark, tmp_path):
    rows = reports.annotate(corpus(spark))
    path = str(tmp_path / "w.xlsx")
    writers.corpus_workbook(path, rows)
    with zipfile.ZipFile(path) as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row ") == 13
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        assert z.read("xl/worksheets/sheet2.xml").count(b"<row ") == 6
        assert z.read("xl/worksheets/sheet3.xml").count(b"<row ") == 3


def test_letters_workbook(spark, tmp_path):
    letters = spark.createDataFrame([("d1", "m", 16, 1, "t", None, None, "A", "x", 10, 8, "f"), ("d2", "m", 17, 1, "t", "己未", 1559, "A", "x", 20, 15, "f"), ("d3", "n", 1, 1, "t", None, None, "", "y", 5, 5, "f")], "data_id string, munjip string, kwon int, seq int, title string, annotation string, inferred_year int, sender_label string, target_name string, char_count_raw int, char_count_plain int, body_first_50 string")
    sentences = spark.createDataFrame([("s1", "d1", 16, None, "A", "x", 1, 1, 1, 8, "甲", "甲"), ("s2", "d2", 17, 1559, "A", "x", 1, 1, 1, 15, "乙", "乙"), ("s3", "d2", 17, 1559, "A", "x", 1, 2, 2, 5, "丙", "丙")], "sentence_id string, letter_data_id string, kwon int, letter_year int, sender_label string, target_name string, para_idx int, sent_idx_in_para int, sent_idx_in_letter int, char_count_plain int, sent_text string, sent_text_plain string")
    lines = writers.letters_summary_rows(letters, sentences, ("a note",))
    assert lines[1:7] == [["총계"], ["Letter 편수", 3], ["문장 수 (sentence)", 3], ["총 글자 수 (표점 포함, raw)", 35], ["총 글자 수 (백문, plain)", 28], ["평균 문장 길이 (백문)", 9.33]]
    assert lines[9:16] == [["Target별 분포"], writers.BLOCKS_SHEET, ["x", "권16", 1, 10, 8, None], ["x", "권17", 1, 20, 15, None], ["x", "합계", 2, 30, 23, 3], [], ["y", "권1", 1, 5, 5, None]] 
    assert lines[-2:] == [["참고"], ["a note"]]
    path = str(tmp_path / "l.xlsx")
    writers.letters_workbook(path, letters, sentences, "Title", ("a note",))
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        assert [z.read(f"xl/worksheets/sheet{k}.xml").count(b"<row ") for k in (2, 3)] == [4, 4]


def test_report_files_previews_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1559), ("b,\n", None, 0)], "x string, y int, year int")
    writers.csv_file(df, str(tmp_path / "r.csv"), ["year", "x", "z", "y"], empty_zeros=("year",))
    assert (tmp_path / "r.csv").read_bytes().decode("utf-8") == '\ufeffyear,x,z,y\r\n1559,a,,0\r\n,"b,\n",,\r\n'
    with pytest.raises(FileNotFoundError):
        writers.single(str(tmp_path / "nowhere"), str(tmp_path / "x.csv"))
    first, more = writers.preview(df, ["x"], 1)
    assert ([r.x for r in first], more) == ((["a"], 1) if first[0].x == "a" else (["b,\n"], 1))
    assert writers.preview(df, ["x"]) [1] == 0
    writers.metadata(str(tmp_path / "m.json"), n=1, name="理")
    assert json.loads((tmp_path / "m.json").read_text("utf-8")) == {"n": 1, "name": "理"}
    writers.csv(df, str(tmp_path / "c"), ["x", "year"], empty_zeros=("year",))
    assert {r.year for r in spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True).collect()} == {"1559", None}


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    from pyspark.sql import functions as F

    from collatio.functions.numbers import round_even

    rng = random.Random(1)
    values = [0.15, 2.675, 2.25, 0.03125, -0.15, 0.0, None, 1e-9, 123456.78905, 1e9 + 0.05] + [rng.randint(0, 40000) / 20000 for _ in range(500)] + [rng.random() * 10 ** rng.randint(-5, 5) for _ in range(300)] + [k / 640 for k in range(500)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (1, 2, 4):
        for r in df.select("x", round_even(F.col("x"), digits).alias("y")).collect():
            assert r.y == (None if r.x is None else round(r.x, digits)), r


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "has_li boolean, has_qi boolean, char_count int")
    assert [r.value for r in reports.corpus_summary(none).collect()] == [0.0] * 7 + [None] * 5
    assert reports.bar is not None and spark.range(1).select(reports.bar(reports.F.lit(0.5), 4).alias("b")).first().b == "██"


def test_provenance(spark, tmp_path):
    rows = [("t", 1, 2, "id2", "b", None, None, 1000), ("t", 1, 1, "id1", "a", "己未", 1559, 5)]
    writers.provenance(spark.createDataFrame(rows, "target_name string, kwon int, seq int, data_id string, title string, annotation string, inferred_year int, char_count_plain int"), str(tmp_path / "p.md"))
    text = (tmp_path / "p.md").read_text("utf-8")
    assert text.index("id1") < text.index("id2")
    assert "**2 letters, 1,005 characters**" in text


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "甲理。乙"), (2, "。"), (3, "氣！")], "k int, t string")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = streams.sentence_stream(streams.read_json_stream(spark, str(tmp_path / "in"), "k int, t string"), ["k"], "t")
    query = streams.write_parquet_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    batch = streams.sentence_stream(rows, ["k"], "t")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_chain(spark):
    from tests.test_align_transfer import sections

    a, b = sections(spark, [("卷一", ["甲理乙氣"])]), sections(spark, [("卷一", ["甲理。乙氣。"])])
    found = chains.corpus(a, b).sentences.orderBy("sentence_id").collect()
    assert [(r.text_punctuated, r.li_qi_category) for r in found] == [("甲理。", "li_only"), ("乙氣。", "qi_only")]
    assert chains.collate(a, b).summary.first().strict_ratio == 1.0


def test_model_plug(spark, tmp_path):
    from collatio.functions import models

    def loader():
        return lambda texts: [[(i + 1, "B-0") for i, c in enumerate(t) if c == "也"] for t in texts]

    rows = spark.createDataFrame([(1, "甲也乙"), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.p for r in models.punctuate(rows, "t", loader, {"。": 0}, "p").collect()}
    assert got == {1: "甲也。乙", 2: None, 3: ""}
    (tmp_path / "m" / "w").mkdir(parents=True)
    (tmp_path / "m" / "w" / "x.safetensors").write_text("")
    (tmp_path / "m" / "label2id.json").write_text('{"。": 0}')
    assert models.read_label_ids(str(tmp_path / "m")) == {"。": 0}


def test_slices(spark, tmp_path):
    from collatio.sources import readers

    (tmp_path / "s.txt").write_text("### a — first\n甲乙\n\n### b — second\n丙\n\n", encoding="utf-8")
    assert [tuple(r) for r in readers.named_slices(spark, str(tmp_path / "s.txt")).collect()] == [("a", "first", "甲乙"), ("b", "second", "丙")]
    (tmp_path / "m.json").write_text('[{"name": "a", "n": 1}, {"name": "b", "n": 2}]')
    assert readers.json_array(spark, str(tmp_path / "m.json"), "name string, n int").count() == 2
