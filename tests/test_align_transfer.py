import random
from difflib import SequenceMatcher

import pytest

from collatio.operators import align, transfer
from collatio.profiles import HAN_CORPUS

Z = "甲乙丙丁戊己庚"
CASES = [
    ("甲乙丙丁戊己庚", Z, 1.0, None),
    ("甲乙内丁戊己庚", Z, 0.8571, None),
    ("甲乙丙丁子丑寅卯戊己庚", Z, 0.7778, "delete_large"),
    ("甲乙丙丁子戊己庚", Z, 0.9333, None),
    ("甲乙丁戊己庚", Z, 0.9231, None),
    ("甲子丑丁戊己庚", "甲乙丁戊己庚", 0.7692, "replace_lendiff"),
]


def sections(spark, rows):
    schema = "juan_num int, juan_label string, file_name string, source string, headings array<struct<level:int,text:string>>, paragraphs array<string>, paragraphs_byline array<struct<raw:string>>"
    return spark.createDataFrame([(i, label, "f", "s", [], paras, [None] * len(paras)) for i, (label, paras) in enumerate(rows)], schema)


def test_cases(spark):
    a = sections(spark, [(str(k), [c[0]]) for k, c in enumerate(CASES)])
    b = sections(spark, [(str(k), [c[1]]) for k, c in enumerate(CASES)])
    got = {r.juan_label: r for r in align.summary(align.align(a, b)).collect()}
    for k, (x, y, strict, _) in enumerate(CASES):
        assert got[str(k)].strict_ratio == strict
        assert got[str(k)].relaxed_ratio >= strict
        assert got[str(k)].mismatch_count == got[str(k)].variant_count + got[str(k)].substantive_count
    assert got["1"].relaxed_ratio == 1.0
    _, spans = transfer.punctuate(a, b)
    kinds = {r.juan_label: r.type for r in spans.collect()}
    assert kinds == {str(k): c[3] for k, c in enumerate(CASES) if c[3]}


def test_mismatch_context(spark):
    a, b = sections(spark, [("x", ["甲" * 30 + "乙" + "丙" * 30])]), sections(spark, [("x", ["甲" * 30 + "丁" + "丙" * 30])])
    r = align.mismatches(align.align(a, b)).first()
    assert (r.type, r.a_pos, r.a_text, r.b_text, r.context_before, r.context_after, r.is_variant) == ("replace", "30-31", "乙", "丁", "甲" * 20, "丙" * 20, True)


def test_transfer_example(spark):
    a, b = sections(spark, [("x", ["甲乙内丁", "戊己庚"])]), sections(spark, [("x", ["「甲乙，丙丁。」戊己？庚"])])
    marked, _ = transfer.punctuate(a, b)
    r = marked.first()
    assert r.paragraphs_punctuated == ["甲乙，内丁。」", "戊己？庚"]
    assert r.paragraphs_provenance == ["  Z  ZZ", "  Z "]


@pytest.mark.parametrize("seed", range(3))
def test_transfer_against_plain_loops(spark, seed):
    """Random witnesses against a direct definition, offsets and spans included."""
    rng = random.Random(seed)
    han = "甲乙丙丁戊己"
    rows_a, rows_b, expected = [], [], {}
    for k in range(12):
        base = [rng.choice(han) for _ in range(rng.randint(0, 60))]
        a = [c for c in base if rng.random() > 0.1]
        if rng.random() < 0.5:
            at = rng.randint(0, len(a))
            a[at:at] = [rng.choice("子丑寅卯")] * rng.randint(1, 7)
        b = "".join(c + rng.choice(["", "", "，", "。」"]) for c in base)
        cuts = sorted(rng.randint(0, len(a)) for _ in range(2))
        paras = ["".join(a[s:e]) for s, e in zip([0, *cuts], [*cuts, len(a)])]
        rows_a.append((str(k), paras))
        rows_b.append((str(k), [b]))
        text, plain, after = "".join(a), "", []
        for c in b:
            if c in han:
                plain += c
                after.append("")
            elif after:
                after[-1] += c
        units, spans = [""] * len(text), []
        for tag, i1, i2, j1, j2 in SequenceMatcher(None, text, plain, autojunk=False).get_opcodes():
            if tag == "equal" or (tag == "replace" and i2 - i1 == j2 - j1):
                for q in range(i1, i2):
                    units[q] = after[j1 + q - i1]
            elif tag == "replace" or (tag == "delete" and i2 - i1 > 3):
                spans.append((i1, i2, text[i1:i2], plain[j1:j2] if tag == "replace" else ""))
        out, at = [], 0
        for p in paras:
            out.append("".join(c + m for c, m in zip(p, units[at : at + len(p)])))
            at += len(p)
        start = lambda i, text=text, units=units: sum(1 + len(m) for m in units[:i])
        expected[str(k)] = (out, [(i1, i2, x, y, start(i1), start(i1) + i2 - i1) for i1, i2, x, y in spans])
    marked, spans = transfer.punctuate(sections(spark, rows_a), sections(spark, rows_b))
    found = {}
    for r in spans.orderBy("juan_label", "op_no").collect():
        found.setdefault(r.juan_label, []).append((r.k_start, r.k_end, r.k_text, r.z_text, r.out_start, r.out_end))
    for r in marked.collect():
        out, want = expected[r.juan_label]
        assert r.paragraphs_punctuated == out
        assert [len(p) for p in r.paragraphs_provenance] == [len(p) for p in out]
        assert r.fallback_span_count == len(want)
        assert found.get(r.juan_label, []) == want


def test_pass_through_and_last_label(spark):
    a, b = sections(spark, [("x", ["甲乙"]), ("y", ["丙"])]), sections(spark, [("x", ["甲乙。"]), ("x", ["甲，乙"])])
    marked, _ = transfer.punctuate(a, b)
    got = {r.juan_label: r for r in marked.collect()}
    assert got["x"].paragraphs_punctuated == ["甲，乙"]
    assert (got["y"].matched, got["y"].paragraphs_punctuated, got["y"].paragraphs_provenance) == (False, ["丙"], [" "])
    assert {tuple(r) for r in align.unmatched(a, b).collect()} == {("y", "a")}
    totals = transfer.transfer_totals(marked).first()
    assert (totals.paragraphs, totals.out_chars, totals.marks) == (1, 3, 1)


def test_empty(spark):
    none = sections(spark, [("x", ["甲"])]).where("false")
    assert align.weighted_means(align.summary(align.align(none, none))).first().strict == 0.0
    assert transfer.punctuate(none, none)[0].count() == 0
    assert HAN_CORPUS.small_delete == 3


def test_last_row_of_a_label_is_that_of_the_files(spark):
    """Repeated labels in one file, and in the XML witness, whose file names are empty."""
    from collatio.schemas import SECTION

    def section(text, place, no, name=None, source=None, number=1):
        return (number, "卷一", name, source, [], [text], [text], [None], text, place, no)

    rows = [section(f"t{i}", "x.xml", i, source="tei") for i in range(6)]
    for parts in (1, 2, 5):
        table = spark.createDataFrame(rows, SECTION).repartition(parts)
        assert align.last_per_label(table).first().raw_concat == "t5"
    two = spark.createDataFrame([section("late", "b.txt", 1, "b.txt", number=0), section("early", "a.txt", 9, "a.txt", number=7)], SECTION)
    assert align.last_per_label(two).first().raw_concat == "late"


def test_ids_follow_the_files(spark):
    """Front sections share number and file: ids keep the order in which they stand; equal labels stay apart."""
    from collatio.operators import segment
    from collatio.schemas import PUNCTUATED

    labels = ["提要", "原序", "門目", "姓氏", "姓氏"]
    rows = [(0, label, "f.txt", [], [f"甲。乙{i}。丙。"], [f"甲。乙{i}。丙。"], [""], [None], 0, True, "f.txt", i) for i, label in enumerate(labels)]
    for parts in (1, 3):
        found = segment.corpus_sentences(spark.createDataFrame(rows, PUNCTUATED).repartition(parts)).orderBy("seq").collect()
        assert [r.juan_label for r in found] == [x for x in labels for _ in range(3)]
        assert [r.text_punctuated for r in found][1::3] == [f"乙{i}。" for i in range(5)]
        assert [r.sentence_id for r in found] == [f"S{k:06d}" for k in range(1, 16)]


def test_names_that_clash_and_nulls(spark):
    from collatio.operators import parse, segment

    rows = spark.createDataFrame([("a", 1, "x", 9), ("a", 2, "x", 8), (None, 1, None, 7)], "_n string, _k int, _part string, _base int")
    assert parse.drop_repeats(rows, ["_n"], "_part", "_k", limit=2).count() == 2
    assert sorted(tuple(r) for r in align.last_per_label(rows, "_part", ["_k"]).select("_k", "_base").collect()) == [(1, 7), (2, 8)]
    numbered = segment.number_globally(rows, ["_n"], ["_k"]).select("_k", "_base", "seq").collect()
    assert sorted(tuple(r) for r in numbered) == [(1, 7, 1), (1, 9, 2), (2, 8, 3)]
    a, b = spark.createDataFrame([("p",), (None,)], "juan_label string"), spark.createDataFrame([("q",), (None,), (None,)], "juan_label string")
    assert sorted(map(tuple, align.unmatched(a, b).collect()), key=str) == [("p", "a"), ("q", "b"), (None, "a"), (None, "b")]
    assert parse.missing_numbers(spark.createDataFrame([(2,), (None,), (5,), (5,)], "n int"), "n").orderBy("n").toPandas()["n"].tolist() == [3, 4]
    assert parse.missing_numbers(spark.createDataFrame([(None,)], "n int"), "n").count() == 0
