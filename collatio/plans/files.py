"""Queries on files: they are made of the small tables, written to the shared folder and read back.

XML files and archives hold a benchmark item each, workbooks and reports the
nations; the SQL is on the tables themselves.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions import models
from collatio.operators import parse
from collatio.profiles import LATIN
from collatio.sources import readers, writers
from collatio.storage import fresh_path, write_bytes

_TEI = "http://www.tei-c.org/ns/1.0"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text) of the benchmark, blanks as one, without characters that XML reserves."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select("item_id", F.trim(F.regexp_replace(F.regexp_replace("text", "[<>&]", ""), r"\s+", " ")).alias("text"))


def _written(rows: DataFrame, ending: str) -> str:
    """A file for each row (id, text) of a small table, in a folder of their own."""
    path = fresh_path(rows.sparkSession, ending)
    for name, text in rows.collect():
        write_bytes(rows.sparkSession, f"{path}/{name:06d}.{ending}", text.encode())
    return path


def tei_files(spark, sf_dir):
    """XML files of a section each, with a heading, page marks, bylines, a list and a part below."""
    text = F.col("text")
    body = F.concat(
        F.lit(f'<TEI xmlns="{_TEI}"><text><body><div><head>卷'), F.when(F.col("item_id") % 2 == 0, "二").otherwise("十"), F.lit('</head><p rend="heading3">H'), F.col("item_id").cast("string"),
        F.lit('</p><p>'), text, F.lit('<pb n="1"/> <byline>(who/)</byline></p><p>'), text, F.lit('(某/)</p><p/><list><item>'), F.substring(text, 1, 9), F.lit("</item></list><div><head>sub</head><p>"), F.substring(text, 5, 20), F.lit("朱子語類卷十</p></div></div></body></text></TEI>"),
    )
    path = _written(_items(spark, sf_dir).select("item_id", body), "xml")
    rows = parse.parse_tei_items(readers.tei(spark, path), LATIN)
    heads = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])), "|")
    return rows.select("juan_num", "juan_label", heads.alias("headings"), F.array_join("paragraphs", "|").alias("paragraphs"), F.array_join(F.transform("paragraphs_byline", lambda b: F.coalesce(b["raw"], F.lit("-"))), "|").alias("bylines"))


def marked_text_files(spark, sf_dir):
    """Marked-up files read whole and parsed."""
    text = F.concat(F.lit("# h\n#+PROPERTY: JUAN 卷三\n　"), F.col("text"), F.lit("\n　　　title\n"), F.col("text"), F.lit("(某/)¶"))
    path = _written(_items(spark, sf_dir).select("item_id", text), "txt")
    rows = parse.parse_marked_text(readers.marked_text(spark, path), LATIN)
    return rows.select("juan_num", F.col("headings")[0]["text"].alias("heading"), F.col("paragraphs")[0].alias("first"), F.col("paragraphs")[1].alias("second"), F.col("paragraphs_byline")[1]["raw"].alias("byline"))


def _letter_files(spark: SparkSession, sf_dir: str) -> str:
    """Two archives with the volumes of even and odd items; that of the second collection lacks one volume asked for."""
    parts: dict[tuple[str, int], list[str]] = {}
    for r in _items(spark, sf_dir).orderBy("item_id").collect():
        name, kwon = (("a", 16), ("b", 11))[r.item_id % 2]
        node = f'<레벨4 id="L{r.item_id}" type="최종정보"><메타정보><제목>答 明彦<원주>己未{r.item_id}</원주></제목></메타정보><본문정보><내용><단락>{r.text}<line/></단락><단락>x<페이지>9</페이지>y</단락></내용></본문정보></레벨4>'
        parts.setdefault((name, kwon), []).append(node + '<레벨4 id="none" type="other"/>')
    path = fresh_path(spark, "letters")
    for name in ("a", "b"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for (owner, kwon), nodes in parts.items():
                if owner == name:
                    z.writestr(f"X_{name}_{kwon:03d}0.xml", f'<x><레벨1><레벨2 id="X_{name}_{kwon:03d}0"><레벨3>{"".join(nodes)}</레벨3></레벨2></레벨1></x>')
        write_bytes(spark, f"{path}/{name}.zip", out.getvalue())
    return path


def _targets(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    known = spark.createDataFrame([(n, f"{n}.zip", f"X_{n}", "", "") for n in ("a", "b", "c")], readers.COLLECTION)
    wanted = spark.createDataFrame([("t1", "a", [16], "明彦", "T", None), ("t2", "b", [11, 12], "明彦", "", None), ("t3", "c", [1], "x", "", None)], readers.TARGET)
    return wanted, known


def letter_files(spark, sf_dir):
    """Letters of zipped XML volumes."""
    rows = readers.letters(spark, _letter_files(spark, sf_dir), *_targets(spark))
    return rows.select("munjip", "source_xml_path", "kwon", "seq", "data_id", "title", "annotation", F.array_join("paragraphs", "|").alias("paragraphs"))


def missing_files(spark, sf_dir):
    """Members and archives asked for that are not there, and names of a series."""
    path, (wanted, known) = _letter_files(spark, sf_dir), _targets(spark)
    files = readers.inventory(spark, path)
    members = readers.missing_members(spark, path, wanted, known).select(F.lit("member").alias("kind"), F.col("source_xml_path").alias("name"))
    archives = readers.missing_archives(files, wanted, known).select(F.lit("archive").alias("kind"), F.col("zip_name").alias("name"))
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey < 3").collect():  # 25 rows
        write_bytes(spark, f"{path}/n_{r.n_nationkey:03d}.txt", r.n_name.encode())
    series = readers.missing_files(readers.inventory(spark, path, "n_*.txt"), "n_%03d.txt", 25).select(F.lit("series").alias("kind"), F.col("file_name").alias("name"))
    return members.unionByName(archives).unionByName(series)


def directory_size(spark, sf_dir):
    path = fresh_path(spark, "sized")
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():  # 25 rows
        write_bytes(spark, f"{path}/n_{r.n_nationkey}", r.n_name.encode())
    return readers.directory_size(readers.inventory(spark, path))


def default_targets(spark, sf_dir):
    """Targets and collections where no file names any, beside the regions."""
    asked = readers.targets(spark, f"{sf_dir}/none.yaml").join(readers.collections(spark), "munjip")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    return asked.select("target_name", "xml_prefix", F.explode("kwon").alias("kwon")).join(F.broadcast(regions.select("r_regionkey")), F.col("kwon") % 5 == F.col("r_regionkey"))


def _local(path: str) -> str:
    return path.removeprefix("file:")


def workbook_cells(spark, sf_dir):
    """Cells of a workbook that is written and read again: header and a row for each nation."""
    path = _local(fresh_path(spark, "book")) + ".xlsx"
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    writers.xlsx(path, [("nations", nations.columns, nations)])
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    cells = [(c.get("r"), "".join(c.itertext())) for c in sheet.iter(f"{space}c")]
    return spark.createDataFrame(cells, "cell string, value string")


def report_lines(spark, sf_dir):
    """Lines of a one-file CSV with its mark, and of the letters' listing."""
    path = _local(fresh_path(spark, "report"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    writers.csv_file(nations, f"{path}/n.csv", ["n_name", "none", "n_regionkey"], empty_zeros=("n_regionkey",))
    rows = nations.select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("target_name"), F.col("n_nationkey").alias("kwon"), F.lit(1).alias("seq"), F.col("n_name").alias("data_id"), F.lit("x").alias("title"), F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("int").alias("inferred_year"), (F.col("n_nationkey") * 1000).alias("char_count_plain"))
    writers.provenance(rows, f"{path}/p.md", "Nations", ("the table",))
    out = []
    for name in ("n.csv", "p.md"):
        with open(f"{path}/{name}", encoding="utf-8", newline="") as f:
            out += [(name, i, line) for i, line in enumerate(f.read().replace("\r\n", "\n").split("\n"))]
    return spark.createDataFrame(out, "file string, line int, text string")


def predicted_marks(spark, sf_dir):
    """Marks that a model, here a rule, predicts behind letters of the items."""

    def loader():
        return lambda texts: [[(i + 1, "B-1" if c == "a" else "B-2") for i, c in enumerate(t) if c in "ae"] for t in texts]

    return models.punctuate(_items(spark, sf_dir), "text", loader, {"，": 1, "。": 2}).select("item_id", "punctuated")


QUERIES = {f.__name__: f for f in (tei_files, marked_text_files, letter_files, missing_files, directory_size, default_targets, workbook_cells, report_lines, predicted_marks)}

_SQL_ITEMS = r"items AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[<>&]', '', 'g'), '[\s\x{0b}]+', ' ', 'g')) AS t FROM benchmark)"
ORACLE_SQL = {
    "tei_files": f"""WITH {_SQL_ITEMS} SELECT CASE WHEN item_id % 2 = 0 THEN 2 ELSE 10 END AS juan_num, CASE WHEN item_id % 2 = 0 THEN '卷二' ELSE '卷十' END AS juan_label, '3:H' || item_id || '|2:sub' AS headings,
        t || '|' || t || '|' || trim(substr(t, 1, 9)) || '|' || trim(substr(t, 5, 20)) AS paragraphs, '(who/)|(某/)|-|-' AS bylines FROM items""",
    "marked_text_files": f"WITH {_SQL_ITEMS} SELECT 3 AS juan_num, 'title' AS heading, t AS first, t AS second, '(某/)' AS byline FROM items",
    "letter_files": f"""WITH {_SQL_ITEMS}, s AS (SELECT *, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) AS r FROM items)
        SELECT CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END AS munjip, CASE WHEN item_id % 2 = 0 THEN 'X_a_0160.xml' ELSE 'X_b_0110.xml' END AS source_xml_path, CASE WHEN item_id % 2 = 0 THEN 16 ELSE 11 END AS kwon,
          (2 * r - 1)::INT AS seq, 'L' || item_id AS data_id, '答明彦' AS title, '己未' || item_id AS annotation, replace(t, ' ', '') || '|xy' AS paragraphs FROM s""",
    "missing_files": "SELECT 'member' AS kind, 'X_b_0120.xml' AS name UNION ALL SELECT 'archive', 'c.zip' UNION ALL SELECT 'series', 'n_' || lpad(n_nationkey::VARCHAR, 3, '0') || '.txt' FROM nation WHERE n_regionkey >= 3",
    "directory_size": "SELECT count(*) AS files, sum(strlen(n_name))::BIGINT AS bytes FROM nation",
    "default_targets": """SELECT target_name, xml_prefix, kwon, r_regionkey FROM (VALUES ('toegye_gobong_22pyeon', 'ITKC_MO_0144A', 16), ('toegye_gobong_22pyeon', 'ITKC_MO_0144A', 17), ('yulgok_ugye_9pyeon', 'ITKC_MO_0201A', 11)) t(target_name, xml_prefix, kwon)
        JOIN region ON kwon % 5 = r_regionkey""",
    "workbook_cells": """WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) + 1 AS r FROM nation)
        SELECT 'A' || r AS cell, n_nationkey::VARCHAR AS value FROM n UNION ALL SELECT 'B' || r, n_name FROM n UNION ALL SELECT 'C' || r, n_regionkey::VARCHAR FROM n
        UNION ALL VALUES ('A1', 'n_nationkey'), ('B1', 'n_name'), ('C1', 'n_regionkey')""",
    "report_lines": """WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation), c AS (SELECT count(*) AS n FROM nation),
        t AS (SELECT n_regionkey, count(*) AS k, sum(n_nationkey * 1000) AS chars, sum(count(*) + 7) OVER (ORDER BY n_regionkey) - count(*) - 7 AS pre FROM nation GROUP BY 1),
        p AS (
          SELECT 0 AS line, '# Nations' AS text UNION ALL SELECT unnest([1, 3, 5]), '' UNION ALL SELECT 2, '## Sources' UNION ALL SELECT 4, '- the table'
          UNION ALL SELECT 6 + pre, '### t' || n_regionkey || ' (' || k || ' letters)' FROM t UNION ALL SELECT 7 + pre, '' FROM t UNION ALL SELECT 8 + pre, '| seq | data_id | volume | title | annotation | year | chars |' FROM t UNION ALL SELECT 9 + pre, '|---|---|---|---|---|---|---|' FROM t
          UNION ALL SELECT 9 + pre + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '| 1 | `' || n_name || '` | ' || n_nationkey || ' | x |  |  | ' || format('{:,}', n_nationkey * 1000) || ' |' FROM nation JOIN t USING (n_regionkey)
          UNION ALL SELECT 10 + pre + k, '' FROM t UNION ALL SELECT 11 + pre + k, '**' || k || ' letters, ' || format('{:,}', chars::BIGINT) || ' characters**' FROM t UNION ALL SELECT 12 + pre + k, '' FROM t
          UNION ALL SELECT 6 + max(pre + k + 7), '' FROM t)
        SELECT 'n.csv' AS file, 0 AS line, chr(65279) || 'n_name,none,n_regionkey' AS text UNION ALL SELECT 'n.csv', r::INT, n_name || ',,' || CASE WHEN n_regionkey = 0 THEN '' ELSE n_regionkey::VARCHAR END FROM n UNION ALL SELECT 'n.csv', (n + 1)::INT, '' FROM c
        UNION ALL SELECT 'p.md', line::INT, text FROM p""",
    "predicted_marks": f"WITH {_SQL_ITEMS} SELECT item_id, replace(replace(t, 'a', 'a，'), 'e', 'e。') AS punctuated FROM items",
}
