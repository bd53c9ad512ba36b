"""Readers: marked-up text, XML, zipped XML, JSON lines, target files, inventories."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.profiles import FRONT_SECTIONS, TITLE_PREFIX
from collatio.schemas import TARGET

# Fixed value: namespace of the XML witness.
TEI = "{http://www.tei-c.org/ns/1.0}"
# Archives of collected works, by collection.
COLLECTIONS = (
    ("toegye", "144__퇴계집_退溪集_.zip", "ITKC_MO_0144A", "퇴계선생문집", "退溪先生文集"),
    ("yulgok", "201__율곡전서_栗谷全書_.zip", "ITKC_MO_0201A", "율곡선생전서", "栗谷先生全書"),
)
COLLECTION = "munjip string, zip_name string, xml_prefix string, korean_name string, hanja_name string"
# Targets where no file names any.
DEFAULT_TARGETS = (
    ("toegye_gobong_22pyeon", "toegye", [16, 17], "明彦", "T", None),
    ("yulgok_ugye_9pyeon", "yulgok", [11], "[答與]成浩原", "Y", None),
)
# Elements of the letter files.
_LEVEL2, _LEVEL4, _FINAL = "레벨2", "레벨4", "최종정보"
_META, _TITLE, _NOTE, _BODY, _PARAGRAPH = "메타정보", "제목", "원주", ".//본문정보/내용", "단락"
_VOID = {"line", "페이지", "문자효과"}

TEI_ITEMS = "file_name string, section int, juan_label string, line_no int, kind string, level int, raw string, clean string, byline string, cover boolean"
LETTER_ROWS = (
    "munjip string, source_zip string, source_xml_path string, asked_kwon int, kwon int, seq int, data_id string, "
    "title string, annotation string, paragraphs array<string>"
)


def marked_text(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file_name, text): whole files of one folder, line breaks as they are; names tell them apart."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines dataset; blank lines give none; a missing path raises."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of files that hold one JSON array of objects each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def named_slices(spark: SparkSession, path: str) -> DataFrame:
    """(name, note, text) of a text file of blocks `### name — note`, text, blank line."""
    files = spark.read.text(path, wholetext=True)
    blocks = files.select(F.explode(F.split("value", r"(?m)^###[ \t]*")).alias("block")).where("trim(block) <> ''")
    head, body = F.regexp_extract("block", r"^([^\r\n]*)", 1), F.regexp_extract("block", r"(?s)^[^\r\n]*\r?\n(.*)$", 1)
    return blocks.select(F.trim(F.regexp_extract(head, "^([^—]*)", 1)).alias("name"), F.trim(F.regexp_extract(head, "—(.*)$", 1)).alias("note"), F.trim(F.regexp_replace(body, r"[\r\n]+", "")).alias("text"))


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_name, length) of the files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def directory_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def missing_files(files: DataFrame, pattern: str, n: int) -> DataFrame:
    """Names of pattern (with one number) for 0 to n - 1 that are not there."""
    wanted = files.sparkSession.range(n).select(F.format_string(pattern, F.col("id")).alias("file_name"))
    return wanted.join(files, "file_name", "left_anti").orderBy("file_name")


def _texts(node: ElementTree.Element, skipped: frozenset[str]) -> str:
    """Text in document order without what stands inside the skipped elements."""
    parts: list[str] = []

    def walk(e):
        parts.append(e.text or "")
        for child in e:
            if isinstance(child.tag, str) and child.tag not in skipped:
                walk(child)
            parts.append(child.tail or "")

    walk(node)
    return "".join(parts)


_PAGES, _PAGES_AND_BYLINES = frozenset({TEI + "pb"}), frozenset({TEI + "pb", TEI + "byline"})


def _tei_rows(root: ElementTree.Element) -> Iterator[tuple]:
    """(section, label, line, kind, level, raw, clean, byline, cover) in walking order."""
    body = root if root.tag == TEI + "body" else root.find(f".//{TEI}body")
    section = line = 0

    def text_row(element, cover):
        nonlocal line
        line += 1
        note = element.find(f".//{TEI}byline")
        byline = None if note is None else (_texts(note, _PAGES).strip() or None)
        return (section, None, line, "text", None, _texts(element, _PAGES).strip(), _texts(element, _PAGES_AND_BYLINES).strip(), byline, cover)

    def heading_row(element, level):
        nonlocal line
        line += 1
        text = _texts(element, _PAGES).strip()
        return [(section, None, line, "heading", level, text, None, None, False)] if text else []

    def walk(div, depth):
        head = div.find(TEI + "head")
        if depth and head is not None:
            yield from heading_row(head, depth + 1)
        for p in div.findall(TEI + "p"):
            rend = p.get("rend", "")
            if rend.startswith("heading"):
                digits = "".join(c if c.isdigit() else " " for c in rend).split()
                yield from heading_row(p, int(digits[0]) if digits else depth + 1)
            else:
                yield text_row(p, True)
        for item in div.findall(f"{TEI}list/{TEI}item"):
            yield text_row(item, False)
        for below in div.findall(TEI + "div"):
            yield from walk(below, depth + 1)

    def start(label):
        nonlocal section, line
        section, line = section + 1, 0
        return (section, label, 0, "section", None, None, None, None, False)

    for div in [] if body is None else body.findall(TEI + "div"):
        head = div.find(TEI + "head")
        label = head.text.strip() if head is not None and head.text else "(unknown)"
        yield start(label)
        if label != FRONT_SECTIONS[0]:
            yield from walk(div, 0)
            continue
        # the preface holds its own paragraphs, and each part is a section
        for p in div.findall(TEI + "p"):
            yield text_row(p, False)
        for part in div.findall(TEI + "div"):
            head = part.find(TEI + "head")
            name = "" if head is None else _texts(head, _PAGES).strip()
            yield start(name.replace(TITLE_PREFIX, ""))
            yield from walk(part, 0)


def tei(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Sections, headings and paragraphs of the XML files of one folder, one row for each; names tell files apart."""
    names = [c.split()[0] for c in TEI_ITEMS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file_name"], frame["content"]):
                rows = [(name, *r) for r in _tei_rows(ElementTree.fromstring(bytes(content)))]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"section": "Int32", "line_no": "Int32", "level": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").mapInPandas(run, TEI_ITEMS)


def _compact(text: str) -> str:
    return "".join(text.split())


def letters_of(xml: bytes) -> list[dict]:
    """Letters of one volume file: number, title, annotation and paragraphs.

    Numbers count all nodes of the letters' level, of which only final ones
    are letters; only the first volume of a file is read.
    """
    level2 = ElementTree.fromstring(xml).find(f".//{_LEVEL2}")
    if level2 is None:
        return []
    tail = level2.get("id", "")[-5:]
    kwon = int(tail[1:4]) if len(tail) == 5 and tail[0] == "_" and tail[4] == "0" and tail[1:4].isdigit() else 0
    void = frozenset(_VOID)
    out = []
    for seq, node in enumerate(level2.iter(_LEVEL4), start=1):
        if node.get("type") != _FINAL:
            continue
        meta = node.find(_META)
        title = None if meta is None else meta.find(f".//{_TITLE}")
        name = note = ""
        if title is not None:
            name = _texts(title, frozenset({_NOTE}) | void)
            note = "".join(_texts(c, void) for c in title if c.tag == _NOTE)
        body = node.find(_BODY)
        paragraphs = [] if body is None else [_compact(_texts(p, void)) for p in body.iter(_PARAGRAPH)]
        out.append({"kwon": kwon, "seq": seq, "data_id": node.get("id", ""), "title": _compact(name), "annotation": _compact(note) or None, "paragraphs": paragraphs})
    return out


def collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COLLECTIONS), COLLECTION)


def targets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Targets of a YAML file; the default ones if it is missing or empty."""
    rows = list(DEFAULT_TARGETS)
    if path and os.path.exists(path):
        import yaml  # an optional dependency

        with open(path, encoding="utf-8") as f:
            loaded = yaml.safe_load(f) or {}
        if loaded:
            rows = [(name, t["munjip"], list(t["kwon"]), t["title_pattern"], t.get("label", ""), t.get("description")) for name, t in loaded.items()]
    return spark.createDataFrame(rows, TARGET)


def letters(spark: SparkSession, path: str, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """All letters of the volumes that the targets ask for, from zip archives.

    wanted: targets; known: collections.  Only members asked for are read;
    those that an archive lacks (missing_members tells them), and archives
    that are not there (missing_archives), give no row.
    """
    asked = _asked(wanted, known)
    names = [c.split()[0] for c in LETTER_ROWS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file_name"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    there = set(archive.namelist())
                    for munjip, kwon, member in asked.get(name, []):
                        if member in there:
                            rows = [{"munjip": munjip, "source_zip": name, "source_xml_path": member, "asked_kwon": kwon, **r} for r in letters_of(archive.read(member))]
                            yield pd.DataFrame(rows, columns=names).astype({"asked_kwon": "Int32", "kwon": "Int32", "seq": "Int32"})

    return _archives(spark, path, asked).mapInPandas(run, LETTER_ROWS)


def _asked(wanted: DataFrame, known: DataFrame) -> dict[str, list[tuple[str, int, str]]]:
    """(collection, volume, member) by archive; configuration, a few rows."""
    asked: dict[str, list[tuple[str, int, str]]] = {}
    pairs = wanted.select("munjip", F.explode("kwon").alias("kwon")).distinct().join(known, "munjip")
    for r in pairs.select("munjip", "kwon", "zip_name", "xml_prefix").collect():
        asked.setdefault(r.zip_name, []).append((r.munjip, r.kwon, f"{r.xml_prefix}_{r.kwon:03d}0.xml"))
    return asked


def _archives(spark: SparkSession, path: str, asked: dict) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    return files.where(F.col("file_name").isin(list(asked)))


def missing_members(spark: SparkSession, path: str, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(munjip, kwon, source_zip, source_xml_path) of members asked for that an archive which is there lacks."""
    asked = _asked(wanted, known)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file_name"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    there = set(archive.namelist())
                rows = [(munjip, kwon, name, member) for munjip, kwon, member in asked.get(name, []) if member not in there]
                yield pd.DataFrame(rows, columns=["munjip", "kwon", "source_zip", "source_xml_path"]).astype({"kwon": "int32"})

    return _archives(spark, path, asked).mapInPandas(run, "munjip string, kwon int, source_zip string, source_xml_path string")


def missing_archives(files: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(target_name, zip_name) of targets whose archive is not among the files."""
    asked = wanted.join(known, "munjip").select("target_name", F.col("zip_name"))
    return asked.join(files.select(F.col("file_name").alias("zip_name")), "zip_name", "left_anti")


_HTML_SKIPPED = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->"


def page_text(html):
    """Column: text of loose HTML, without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, _HTML_SKIPPED, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " "))
