import io
import zipfile

import pytest

from collatio.operators import letters as L
from collatio.operators import parse, segment
from collatio.plans import chains
from collatio.sources import readers

MARKED = (
    "lead\n#+TITLE: t\n#+PROPERTY: JUAN 卷一\n<pb:x_1a>¶\n欽定四庫全書¶\n　　理氣上¶\n問甲¶\n　乙(僴/)¶\n#note\n　丙¶\n<pb:x_1b>¶\n丁¶\n　　　　　戊¶\n"
    "#+PROPERTY: JUAN 提要\n　　　　己¶\n　　　　庚¶\n　　　題¶\n　辛(賀孫/)　¶\n"
)
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<div><head>提要</head><p>甲<pb n="1">x</pb>乙朱子語類卷一</p><div><head>朱子語類原序</head><p>序<byline>(某)</byline>文</p></div></div>
<div><head>卷二</head><p rend="heading 3">小題</p><p>丙(賀孫/)丁(僴/)</p><list><item>戊</item></list>
<div><head>節</head><p>己朱子語類卷二</p><p>庚</p><p>庚</p><p>庚</p><p>庚</p><p>庚</p></div></div></body></text></TEI>"""
LETTERS = """<아이템><레벨1><레벨2 id="ITKC_MO_0144A_0160"><레벨3>
<레벨4 id="a" type="목차"><메타정보><제목>x</제목></메타정보></레벨4>
<레벨4 id="b" type="최종정보"><메타정보><제목>答奇 明彦<원주>大升○ 己未</원주></제목></메타정보><본문정보><내용><단락>甲，<line/>
 乙。丙！</단락><단락></단락><단락>。丁<페이지>9</페이지>戊</단락></내용></본문정보></레벨4>
<레벨4 id="c" type="최종정보"><메타정보><제목>他</제목></메타정보></레벨4></레벨3></레벨2></레벨1></아이템>"""


def test_marked_text(spark, tmp_path):
    (tmp_path / "a_001.txt").write_text(MARKED, encoding="utf-8")
    got = parse.parse_marked_text(readers.marked_text(spark, str(tmp_path))).collect()
    assert [r.juan_label for r in got] == ["卷一", "提要"]
    one, front = got
    assert [tuple(h) for h in one.headings] == [(2, "理氣上")]
    # the note line does not end the paragraph, the page line does
    assert one.paragraphs_raw == ["問甲乙(僴/)丙", "丁", "戊"]
    assert [b and b.raw for b in one.paragraphs_byline] == [None, None, None]
    assert front.paragraphs == ["己庚", "辛"]
    assert [b and b.raw for b in front.paragraphs_byline] == [None, "(賀孫/)"]
    assert (one.juan_num, front.juan_num, one.raw_concat) == (1, 0, "問甲乙(僴/)丙丁戊")


def test_tei(spark, tmp_path):
    (tmp_path / "b.xml").write_text(TEI, encoding="utf-8")
    got = parse.parse_tei_items(readers.tei(spark, str(tmp_path))).collect()
    assert [r.juan_label for r in got] == ["提要", "原序", "卷二"]
    front, preface, two = got
    assert front.paragraphs == ["甲乙朱子語類卷一"]
    assert (preface.paragraphs, preface.paragraphs_raw, preface.paragraphs_byline[0].raw) == (["序文"], ["序(某)文"], "(某)")
    assert [tuple(h) for h in two.headings] == [(3, "小題"), (2, "節")]
    assert two.paragraphs == ["丙丁", "戊", "己", "庚"]
    assert two.paragraphs_byline[0].raw == "(僴/)"
    assert two.juan_num == 2


def test_letters(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ITKC_MO_0144A_0160.xml", LETTERS)
    (tmp_path / readers.COLLECTIONS[0][1]).write_bytes(buffer.getvalue())
    table, sentences = chains.letter_corpus(spark, str(tmp_path))
    r = table.collect()
    assert len(r) == 1
    r = r[0]
    assert (r.data_id, r.kwon, r.seq, r.title, r.annotation, r.inferred_year) == ("b", 16, 2, "答奇明彦", "大升○己未", 1559)
    assert r.raw_text == "甲，乙。丙！\n\n\n\n。丁戊"
    assert (r.plain_text, r.char_count_raw, r.char_count_plain) == ("甲乙丙丁戊", 9, 5)
    got = [(s.sentence_id, s.sent_idx_in_letter, s.sent_text) for s in sentences.orderBy("sent_idx_in_letter").collect()]
    assert got == [("b_p1_s1", 1, "甲，乙。"), ("b_p1_s2", 2, "丙！"), ("b_p3_s1", 3, "丁戊")]
    assert L.with_letter(sentences, table).count() == 3
    files = readers.inventory(spark, str(tmp_path))
    assert [x.target_name for x in readers.missing_archives(files, readers.targets(spark), readers.collections(spark)).collect()] == ["yulgok_ugye_9pyeon"]


def test_empty_letter(spark):
    from collatio.schemas import LETTER

    row = ("a", "m", 1, 1, "t", None, None, "", "", 0, 0, "", "T", "x", "z", "p", "now")
    assert segment.letter_sentences(spark.createDataFrame([row], LETTER)).count() == 0


def test_repeats(spark):
    rows = [(1, i, "x") for i in range(5)] + [(1, 10 + i, "y") for i in range(4)]
    got = parse.drop_repeats(spark.createDataFrame(rows, "s int, line_no int, text string"), ["s"]).collect()
    assert sorted((r.text, r.line_no) for r in got) == [("x", 0), ("y", 10), ("y", 11), ("y", 12), ("y", 13)]


def test_inventory(spark, tmp_path):
    for k in (0, 2):
        (tmp_path / f"f_{k:03d}.txt").write_text("ab")
    files = readers.inventory(spark, str(tmp_path))
    assert tuple(readers.directory_size(files).first()) == (2, 4)
    assert [r.file_name for r in readers.missing_files(files, "f_%03d.txt", 4).collect()] == ["f_001.txt", "f_003.txt"]


def test_fetched_at_is_in_utc(spark):
    from datetime import datetime, timedelta, timezone

    found = spark.createDataFrame([("m", "z", "p", 1, 1, 1, "d", "title", None, ["甲"])], readers.LETTER_ROWS)
    wanted = spark.createDataFrame([("t", "m", [1], "title", None, None)], readers.TARGET)
    known = spark.createDataFrame([("m", "z")], "munjip string, zip_name string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        got = datetime.fromisoformat(L.select_letters(found, wanted, known).first().fetched_at)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got.utcoffset() == timedelta(0) and abs(datetime.now(timezone.utc) - got) < timedelta(minutes=5)


def test_target_files(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "t.yaml"
    path.write_text("one:\n  munjip: toegye\n  kwon: [3, 4]\n  title_pattern: '[答與]甲'\n  label: T\n", encoding="utf-8")
    assert [tuple(r) for r in readers.targets(spark, str(path)).collect()] == [("one", "toegye", [3, 4], "[答與]甲", "T", None)]
    path.write_text("", encoding="utf-8")
    assert readers.targets(spark, str(path)).count() == readers.targets(spark).count() == 2
    with pytest.raises(ValueError):
        L.check_targets(spark.createDataFrame([("t", "other", [1], "x", None, None)], readers.TARGET), readers.collections(spark))
