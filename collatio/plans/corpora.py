"""Queries on parsing, letters, sheets and storage, with the same results in DuckDB's SQL.

Marked-up files, XML items and letters are made of `documents` and
`conversations`: what a line is follows from its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.operators import letters as L
from collatio.operators import parse, reports, segment
from collatio.profiles import HAN_LETTERS, LATIN, LETTER_MARKS_CLASS, TextProfile
from collatio.sources import readers, writers
from collatio.storage import fresh_path, spread

_INDENT = "　"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir) -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, text): a marked-up file of each document, as readers.marked_text gives them."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def line(x: Column) -> Column:
        n = F.length(x)
        return (
            F.when(n % 40 == 17, "#+PROPERTY: JUAN 卷十二 ").when(n % 40 == 29, "#+PROPERTY: JUAN 提要")
            .when(n % 7 == 1, F.concat(F.lit(_INDENT), x)).when(n % 7 == 2, F.concat(F.lit(_INDENT * 2), x))
            .when(n % 7 == 3, F.concat(F.lit(_INDENT), x, F.lit("(某/)"))).when(n % 7 == 4, F.concat(F.lit(_INDENT * 4), x))
            .when(n % 7 == 5, F.concat(F.lit(_INDENT * 5), x, F.lit("¶"))).when(n % 7 == 6, F.concat(F.lit("<pb:A_001-1a>"), F.lit(_INDENT), x)).otherwise(x)
        )

    body = F.array_join(F.transform(_lines(spark, sf_dir), line), "\n")
    return docs.select(F.format_string("%012d.txt", "doc_id").alias("file_name"), F.concat(F.lit("# title\nlead\n#+PROPERTY: JUAN 卷三\n"), body).alias("text"))


def line_roles(spark, sf_dir):
    """Lines of the marked-up files with section, indent and role."""
    rows = parse.classify_lines(marked_files(spark, sf_dir))
    return rows.select("file_name", "line_no", "section", "juan_label", "indent", F.length("content").alias("chars"), "role")


def paragraph_islands(spark, sf_dir):
    """Paragraphs of the marked-up files: lines up to one that closes."""
    return parse.paragraphs(parse.classify_lines(marked_files(spark, sf_dir)))


def parsed_sections(spark, sf_dir):
    rows = parse.parse_marked_text(marked_files(spark, sf_dir), LATIN)
    joined = lambda c: F.array_join(c, "|").alias(c)
    notes = F.array_join(F.transform("paragraphs_byline", lambda b: F.coalesce(b["raw"], F.lit("-"))), "|")
    heads = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])), "|")
    return rows.select("file_name", "section", "juan_num", "juan_label", heads.alias("headings"), joined("paragraphs"), joined("paragraphs_raw"), notes.alias("bylines"), F.length("raw_concat").alias("chars"))


def tei_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of XML files, one of each document, as readers.tei gives them."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.format_string("%012d.xml", "doc_id").alias("file_name")
    none = lambda kind: F.lit(None).cast(kind)
    head = docs.select(name, F.lit(1).alias("section"), F.lit("卷五").alias("juan_label"), F.lit(0).alias("line_no"), F.lit("section").alias("kind"), none("int").alias("level"), none("string").alias("raw"), none("string").alias("clean"), none("string").alias("byline"), F.lit(False).alias("cover"))
    lines = docs.select(name, F.posexplode(_lines(spark, sf_dir)).alias("k", "x"))
    n = F.length("x")
    # a closing title, a closing note, and a note inside
    text = F.when(n % 7 == 4, F.concat("x", F.lit("朱子語類卷十"))).when(n % 7 == 3, F.concat("x", F.lit("(某/)"))).when(n % 7 == 1, F.concat(F.lit("a(b/)"), "x")).otherwise(F.col("x"))
    heading = n % 7 == 2
    body = lines.select(
        "file_name", F.lit(1).alias("section"), none("string").alias("juan_label"), (F.col("k") + 1).alias("line_no"), F.when(heading, "heading").otherwise("text").alias("kind"),
        F.when(heading, F.lit(2)).alias("level"), F.when(heading, F.col("x")).otherwise(text).alias("raw"), F.when(~heading, text).alias("clean"),
        F.when(~heading & (n % 7 == 6), F.lit("by")).alias("byline"), (n % 2 == 0).alias("cover"),
    )
    return head.unionByName(body)


def tei_sections(spark, sf_dir):
    rows = parse.parse_tei_items(tei_items(spark, sf_dir), LATIN)
    notes = F.array_join(F.transform("paragraphs_byline", lambda b: F.coalesce(b["raw"], F.lit("-"))), "|")
    heads = F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])), "|")
    return rows.select("source_file", "section", "juan_num", "juan_label", heads.alias("headings"), F.array_join("paragraphs", "|").alias("paragraphs"), F.array_join("paragraphs_raw", "|").alias("paragraphs_raw"), notes.alias("bylines"))


def failed_labels(spark, sf_dir):
    """Labels of parts that hold no numeral."""
    parts = _table(spark, sf_dir, "part")
    label = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("卷"), F.col("p_brand"))).otherwise("卷十")
    return parse.failed_labels(parts.select(T.volume_number(label, anywhere=True).alias("juan_num"), label.alias("juan_label")))


def inventory_missing(spark, sf_dir):
    """Ids between the least and the largest labelled one that have no label."""
    return parse.missing_numbers(_table(spark, sf_dir, "labels"), "doc_id")


def letter_plain(spark, sf_dir):
    """Texts by the blacklist of letters."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.plain(F.col("text"), HAN_LETTERS).alias("plain"))


#: Letters end sentences like Latin text here, but keep their own blacklist.
_LETTERS = TextProfile("latin_letters", drop_class=LETTER_MARKS_CLASS, terminators=".?!", paragraph_separator="\n\n")
_TARGETS = [("first", "user", [0, 2], "(?i)th", "A", None), ("second", "assistant", [1, 3], "en", "B", None), ("third", "user", [0], "^[A-M]", None, None)]


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as letters: the role is the collection, the turn the volume, the first four words the title."""
    turns = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    names = F.array(*[F.lit(n) for n in T.SEXAGENARY_YEARS])
    found = turns.select(
        F.col("role").alias("munjip"), F.concat("role", F.lit(".zip")).alias("source_zip"), F.lit("x.xml").alias("source_xml_path"), F.col("turn").cast("int").alias("asked_kwon"),
        F.col("turn").cast("int").alias("kwon"), F.col("conv_id").cast("int").alias("seq"), F.concat_ws("_", "conv_id", "turn").alias("data_id"), F.substring_index("text", " ", 4).alias("title"),
        F.get(names, (F.col("conv_id") % 41).cast("int")).alias("annotation"), F.split("text", "\n").alias("paragraphs"),
    )
    targets = spark.createDataFrame(_TARGETS, "target_name string, munjip string, kwon array<int>, title_pattern string, label string, description string")
    known = spark.createDataFrame([(r, f"{r}.zip") for r in ("user", "assistant", "system")], "munjip string, zip_name string")
    L.check_targets(targets, known)
    return L.select_letters(found, targets, known, _LETTERS)


def letter_table(spark, sf_dir):
    return letters(spark, sf_dir).drop("fetched_at", "source_xml_path", "source_zip")


def letter_sentences(spark, sf_dir):
    return segment.letter_sentences(letters(spark, sf_dir), _LETTERS)


def letters_by_target(spark, sf_dir):
    return reports.by_target(segment.letter_sentences(letters(spark, sf_dir), _LETTERS))


def letters_index(spark, sf_dir):
    """Listing of the provenance report."""
    return L.index_by_target(letters(spark, sf_dir))


def sentences_with_letter(spark, sf_dir):
    table = letters(spark, sf_dir)
    rows = L.with_letter(segment.letter_sentences(table, _LETTERS), table)
    return rows.select("sentence_id", "target_name", F.col("letter.title").alias("title"), F.col("letter.char_count_raw").alias("chars"), (F.col("letter.kwon") == F.col("kwon")).alias("same"))


def letters_sheet_totals(spark, sf_dir):
    table = letters(spark, sf_dir)
    return reports.letters_totals(table, segment.letter_sentences(table, _LETTERS))


def letters_sheet_blocks(spark, sf_dir):
    table = letters(spark, sf_dir)
    return reports.letters_blocks(table, segment.letter_sentences(table, _LETTERS))


def corpus_sheet(spark, sf_dir):
    """Summary sheet over the letters' sentences, by two words."""
    rows = segment.letter_sentences(letters(spark, sf_dir), _LETTERS)
    return reports.corpus_summary(rows.select(F.col("sent_text").contains("the").alias("has_li"), F.col("sent_text").contains("and").alias("has_qi"), F.col("char_count_plain").alias("char_count")))


def category_bars(spark, sf_dir):
    """Bars of the shares of document sizes."""
    rows = reports.length_histogram(_table(spark, sf_dir, "documents").select(F.col("n_chars").alias("char_count")))
    return rows.select("position", "bucket", "n", reports.bar(F.col("share")).alias("bar"))


def json_round_trip(spark, sf_dir):
    """Documents written as JSON lines to the shared folder and read back."""
    path = fresh_path(spark, "json")
    writers.json_lines(_table(spark, sf_dir, "documents"), path)
    writers.json_lines(_table(spark, sf_dir, "documents").limit(0), path, "ignore")
    return readers.json_lines(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


def csv_round_trip(spark, sf_dir):
    """Customers written as CSV and read back: columns in order, one that is not there, zeros as empty."""
    path = fresh_path(spark, "csv")
    writers.csv(_table(spark, sf_dir, "customer"), path, ["c_name", "c_nationkey", "none", "c_custkey"], empty_zeros=("c_nationkey",))
    return spark.read.csv(path, header=True, schema="c_name string, c_nationkey string, none string, c_custkey long", emptyValue="", nullValue=None)


def slices_round_trip(spark, sf_dir):
    """Benchmark items as named slices of a text file, read back."""
    path = fresh_path(spark, "slices")
    items = _table(spark, sf_dir, "benchmark")
    block = F.concat(F.lit("### "), F.col("item_id").cast("string"), F.lit(" — note "), F.col("item_id").cast("string"), F.lit("\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n"))
    items.select(block.alias("value")).write.text(path)
    return readers.named_slices(spark, path)


def array_round_trip(spark, sf_dir):
    """Each nation as a JSON array of one object in a file of its own, read back."""
    path = fresh_path(spark, "arrays")
    nations = _table(spark, sf_dir, "nation")
    lines = nations.select(F.concat(F.lit("["), F.to_json(F.struct("n_nationkey", "n_name")), F.lit("]")).alias("value"), "n_nationkey")
    lines.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return readers.json_array(spark, path + "/*", "n_nationkey int, n_name string")


QUERIES = {
    f.__name__: f
    for f in (
        line_roles, paragraph_islands, parsed_sections, tei_sections, failed_labels, inventory_missing, letter_plain, letter_table, letter_sentences,
        letters_by_target, letters_index, sentences_with_letter, letters_sheet_totals, letters_sheet_blocks, corpus_sheet, category_bars, json_round_trip, csv_round_trip, slices_round_trip, array_round_trip,
    )
}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_NOTE = r"\([^()/]{0,7}/[^()/]{0,7}\)"


def _byline(text: str, limit: int) -> tuple[str, str]:
    """(text without its closing note, the note) in SQL."""
    inside = rf"regexp_extract({text}, '\(([^()]{{1,{limit}}})\){_SPACE}*$', 1)"
    tail = rf"regexp_extract({text}, '\(([^()]{{1,{limit}}})\){_SPACE}*$')"
    found = f"contains({inside}, '/') AND length({inside}) <= 8"
    return f"CASE WHEN {found} THEN regexp_replace({text}[1:length({text}) - length({tail})], '{_SPACE}+$', '') ELSE {text} END", f"CASE WHEN {found} THEN {tail} END"


_CLEAN80, _NOTE80 = _byline("text", 80)
_SQL_LINES = rf"""
made AS (SELECT doc_id, k, CASE WHEN n % 40 = 17 THEN '#+PROPERTY: JUAN 卷十二 ' WHEN n % 40 = 29 THEN '#+PROPERTY: JUAN 提要'
    WHEN n % 7 = 1 THEN '{_INDENT}' || x WHEN n % 7 = 2 THEN '{_INDENT * 2}' || x WHEN n % 7 = 3 THEN '{_INDENT}' || x || '(某/)' WHEN n % 7 = 4 THEN '{_INDENT * 4}' || x
    WHEN n % 7 = 5 THEN '{_INDENT * 5}' || x || '¶' WHEN n % 7 = 6 THEN '<pb:A_001-1a>{_INDENT}' || x ELSE x END AS line
  FROM (SELECT doc_id, k, x, length(x) AS n FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)))),
files AS (SELECT lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS file_name, '# title' || chr(10) || 'lead' || chr(10) || '#+PROPERTY: JUAN 卷三' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS text FROM made GROUP BY doc_id),
raw AS (SELECT file_name, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS line_no, len(p) AS total FROM (SELECT file_name, string_split_regex(text, '{_BREAKS}') AS p FROM files)),
cleaned AS (
  SELECT file_name, line_no, starts_with(raw, '#') AS hashed, regexp_extract(raw, '^#\+PROPERTY:\s*JUAN\s+(.+?)\s*$', 1) AS label,
         regexp_replace(replace(regexp_replace(raw, '<pb:[^>]+>', '', 'g'), '¶', ''), '{_SPACE}+$', '') AS cleaned FROM raw WHERE NOT (line_no = total - 1 AND raw = '')),
placed AS (
  SELECT file_name, line_no, hashed, label <> '' AS header, cleaned = '' AS blank, length(regexp_extract(cleaned, '^{_INDENT}*')) AS indent, regexp_replace(cleaned, '^{_INDENT}*', '') AS content,
         count(*) FILTER (label <> '') OVER w AS section, max(CASE WHEN label <> '' THEN lpad(line_no::VARCHAR, 9, '0') || label END) OVER w AS last FROM cleaned WINDOW w AS (PARTITION BY file_name ORDER BY line_no)),
roles AS (
  SELECT *, last[10:] AS juan_label, CASE WHEN header THEN 'header' WHEN hashed OR blank THEN NULL WHEN indent BETWEEN 2 AND 4 AND NOT (coalesce(last[10:] = '提要', false) AND indent = 4) THEN 'heading' ELSE 'body' END AS role FROM placed),
islands AS (
  SELECT *, sum(CASE WHEN header THEN 1 WHEN hashed THEN 0 WHEN blank OR role = 'heading' OR indent = 0 OR indent >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY file_name, section ORDER BY line_no) AS island FROM roles),
paras AS (
  SELECT file_name, section, min(line_no)::INT AS line_no, string_agg(content, '' ORDER BY line_no) AS text FROM islands WHERE section > 0 AND role = 'body' GROUP BY file_name, section, island)"""

_SQL_TEI = rf"""
lines AS (SELECT lpad(doc_id::VARCHAR, 12, '0') || '.xml' AS f, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
items AS (
  SELECT f, k, length(x) % 7 = 2 AS heading, CASE WHEN length(x) % 7 = 6 THEN 'by' END AS byline, length(x) % 2 = 0 AS cover,
         CASE length(x) % 7 WHEN 4 THEN x || '朱子語類卷十' WHEN 3 THEN x || '(某/)' WHEN 1 THEN 'a(b/)' || x ELSE x END AS t FROM lines),
stripped AS (SELECT f, k, byline, CASE WHEN cover THEN regexp_replace(regexp_replace(t, '朱子語類[卷巻]第?[一二三四五六七八九十百]+{_SPACE}*$', ''), '{_SPACE}+$', '') ELSE t END AS text FROM items WHERE NOT heading),
cut AS (SELECT f, k, text, {_byline('text', 8)[0]} AS cut, {_byline('text', 8)[1]} AS found, byline FROM stripped),
clean AS (SELECT f, k, text, regexp_replace(CASE WHEN byline IS NULL THEN cut ELSE text END, '{_NOTE}', '', 'g') AS clean, coalesce(byline, found) AS byline FROM cut),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY f, clean) AS n, row_number() OVER (PARTITION BY f, clean ORDER BY k) AS r FROM clean WHERE clean <> '') WHERE n < 5 OR r = 1)"""

_SQL_LETTERS = rf"""
targets(target_name, munjip, kwon, pattern, label) AS (VALUES ('first', 'user', 0, '(?i)th', 'A'), ('first', 'user', 2, '(?i)th', 'A'), ('second', 'assistant', 1, 'en', 'B'), ('second', 'assistant', 3, 'en', 'B'), ('third', 'user', 0, '^[A-M]', '')),
years AS (SELECT {list(T.SEXAGENARY_YEARS)}::VARCHAR[] AS y),
letters AS (
  SELECT target_name, munjip, kwon, label, conv_id, conv_id || '_' || turn AS data_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS title, CASE WHEN conv_id % 41 < 30 THEN y[conv_id % 41 + 1] END AS annotation,
         CASE WHEN conv_id % 41 < 30 THEN (1554 + conv_id % 41)::INT END AS year, array_to_string(string_split(text, chr(10)), chr(10) || chr(10)) AS raw,
         regexp_replace(text, '[{LETTER_MARKS_CLASS.replace("'", "''")}]|{_SPACE}', '', 'g') AS plain
  FROM conversations, years, targets WHERE role = munjip AND turn = kwon AND text IS NOT NULL AND regexp_matches(array_to_string(string_split(text, ' ')[1:4], ' '), pattern)),
lparas AS (SELECT *, unnest(p) AS para, generate_subscripts(p, 1) AS para_idx FROM (SELECT *, string_split(raw, chr(10) || chr(10)) AS p FROM letters WHERE raw <> '')),
lpieces AS (SELECT * EXCLUDE (p, para), unnest(q) AS piece, generate_subscripts(q, 1) AS k FROM (SELECT *, regexp_extract_all(para, '[^.?!]*[.?!]|[^.?!]+') AS q FROM lparas)),
lsents AS (
  SELECT *, row_number() OVER (PARTITION BY target_name, data_id, para_idx ORDER BY k) AS in_para, row_number() OVER (PARTITION BY target_name, data_id ORDER BY para_idx, k) AS in_letter FROM (
    SELECT * EXCLUDE (plain), regexp_replace(regexp_replace(piece, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS t, regexp_replace(piece, '[{LETTER_MARKS_CLASS.replace("'", "''")}]|{_SPACE}', '', 'g') AS plain FROM lpieces) WHERE plain <> ''),
ltotals AS (SELECT count(*) AS letters, sum(length(replace(raw, chr(10), ''))) AS chars_raw, sum(length(plain)) AS chars_plain FROM letters),
lcount AS (SELECT target_name, count(*) AS n FROM lsents GROUP BY target_name)"""

ORACLE_SQL = {
    "line_roles": f"WITH {_SQL_LINES} SELECT file_name, line_no, section, juan_label, indent, length(content) AS chars, role FROM roles",
    "paragraph_islands": f"WITH {_SQL_LINES} SELECT file_name, section, line_no, text FROM paras",
    "parsed_sections": f"""WITH {_SQL_LINES},
        h AS (SELECT file_name, section, juan_label FROM roles WHERE role = 'header'),
        g AS (SELECT file_name, section, string_agg(indent || ':' || content, '|' ORDER BY line_no) AS headings FROM roles WHERE section > 0 AND role = 'heading' GROUP BY 1, 2),
        c AS (SELECT *, {_CLEAN80} AS clean, {_NOTE80} AS note FROM paras),
        p AS (SELECT file_name, section, string_agg(clean, '|' ORDER BY line_no) AS paragraphs, string_agg(text, '|' ORDER BY line_no) AS paragraphs_raw, string_agg(coalesce(note, '-'), '|' ORDER BY line_no) AS bylines, sum(length(clean))::INT AS chars FROM c GROUP BY 1, 2)
        SELECT file_name, section, CASE juan_label WHEN '卷三' THEN 3 WHEN '卷十二' THEN 12 ELSE 0 END AS juan_num, juan_label, coalesce(headings, '') AS headings, coalesce(paragraphs, '') AS paragraphs,
          coalesce(paragraphs_raw, '') AS paragraphs_raw, coalesce(bylines, '') AS bylines, coalesce(chars, 0) AS chars FROM h LEFT JOIN g USING (file_name, section) LEFT JOIN p USING (file_name, section)""",
    "tei_sections": f"""WITH {_SQL_TEI}, s AS (SELECT DISTINCT f FROM lines), h AS (SELECT f, string_agg('2:' || t, '|' ORDER BY k) AS headings FROM items WHERE heading GROUP BY f),
        p AS (SELECT f, string_agg(clean, '|' ORDER BY k) AS paragraphs, string_agg(text, '|' ORDER BY k) AS paragraphs_raw, string_agg(coalesce(byline, '-'), '|' ORDER BY k) AS bylines FROM kept GROUP BY f)
        SELECT f AS source_file, 1::BIGINT AS section, 5 AS juan_num, '卷五' AS juan_label, coalesce(headings, '') AS headings, coalesce(paragraphs, '') AS paragraphs, coalesce(paragraphs_raw, '') AS paragraphs_raw, coalesce(bylines, '') AS bylines
        FROM s LEFT JOIN h USING (f) LEFT JOIN p USING (f)""",
    "failed_labels": "SELECT '卷' || p_brand AS juan_label FROM part WHERE p_size % 3 = 0",
    "inventory_missing": "SELECT n AS doc_id FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS n FROM labels) WHERE n NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "letter_plain": f"SELECT doc_id, regexp_replace(text, '[{LETTER_MARKS_CLASS.replace(chr(39), chr(39) * 2)}]|{_SPACE}', '', 'g') AS plain FROM documents",
    "letter_table": f"""WITH {_SQL_LETTERS} SELECT data_id, munjip, kwon, conv_id::INT AS seq, title, annotation, year AS inferred_year, raw AS raw_text, plain AS plain_text,
        length(replace(raw, chr(10), ''))::INT AS char_count_raw, length(plain)::INT AS char_count_plain, substr(plain, 1, 50) AS body_first_50, label AS sender_label, target_name FROM letters""",
    "letter_sentences": f"""WITH {_SQL_LETTERS} SELECT data_id || '_p' || para_idx || '_s' || in_para AS sentence_id, data_id AS letter_data_id, munjip, kwon, conv_id::INT AS letter_seq, title AS letter_title, year AS letter_year,
        label AS sender_label, target_name, para_idx::INT AS para_idx, in_para::INT AS sent_idx_in_para, in_letter::INT AS sent_idx_in_letter, t AS sent_text, plain AS sent_text_plain, length(t)::INT AS char_count_raw, length(plain)::INT AS char_count_plain FROM lsents""",
    "letters_by_target": f"""WITH {_SQL_LETTERS} SELECT target_name, count(*) AS sentences, count(DISTINCT data_id) AS letters, sum(length(t))::BIGINT AS chars_raw, sum(length(plain))::BIGINT AS chars_plain, avg(length(plain)) AS mean_length
        FROM lsents GROUP BY target_name""",
    "letters_index": f"WITH {_SQL_LETTERS} SELECT target_name, kwon, conv_id::INT AS seq, data_id, title, annotation, year AS inferred_year, length(plain)::INT AS char_count_plain FROM letters",
    "sentences_with_letter": f"WITH {_SQL_LETTERS} SELECT data_id || '_p' || para_idx || '_s' || in_para AS sentence_id, target_name, title, length(replace(raw, chr(10), ''))::INT AS chars, true AS same FROM lsents",
    "letters_sheet_totals": f"""WITH {_SQL_LETTERS}, n AS (SELECT count(*) AS s FROM lsents)
        SELECT unnest([0, 1, 2, 3, 4]) AS position, unnest({list(reports.LETTERS_SUMMARY)}) AS item, unnest([letters::DOUBLE, s::DOUBLE, chars_raw::DOUBLE, chars_plain::DOUBLE, round(chars_plain::DOUBLE / s, 2)]) AS value FROM ltotals, n""",
    "letters_sheet_blocks": f"""WITH {_SQL_LETTERS} SELECT target_name, CASE WHEN kwon IS NULL THEN '{reports.SUBTOTAL}' ELSE '{reports.VOLUME}' || kwon END AS volume, count(*) AS letters,
        sum(length(replace(raw, chr(10), '')))::BIGINT AS char_count_raw, sum(length(plain))::BIGINT AS char_count_plain, CASE WHEN kwon IS NULL THEN coalesce(any_value(n), 0) END AS sentences
        FROM letters LEFT JOIN lcount USING (target_name) GROUP BY GROUPING SETS ((target_name, kwon), (target_name))""",
    "corpus_sheet": f"""WITH {_SQL_LETTERS}, f AS (SELECT contains(t, 'the') AS a, contains(t, 'and') AS b, length(plain) AS n FROM lsents)
        SELECT unnest(range(12))::INT AS position, unnest({list(reports.CORPUS_SUMMARY)}) AS item, unnest([count(*)::DOUBLE, count_if(a), count_if(b), count_if(a AND b), count_if(a AND NOT b), count_if(b AND NOT a), count_if(NOT a AND NOT b), NULL,
          round(avg(n), 1), floor(median(n)), max(n), min(n)]) AS value FROM f""",
    "category_bars": """WITH names(position, bucket) AS (VALUES (0, '1-3'), (1, '4-10'), (2, '11-30'), (3, '31-60'), (4, '61-100'), (5, '101+')),
        c AS (SELECT CASE WHEN n_chars <= 3 THEN '1-3' WHEN n_chars <= 10 THEN '4-10' WHEN n_chars <= 30 THEN '11-30' WHEN n_chars <= 60 THEN '31-60' WHEN n_chars <= 100 THEN '61-100' ELSE '101+' END AS bucket, count(*) AS n FROM documents GROUP BY 1)
        SELECT position, bucket, coalesce(n, 0) AS n, repeat('█', floor(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM c) * 50)::INT) AS bar FROM names LEFT JOIN c USING (bucket)""",
    "json_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "csv_round_trip": "SELECT c_name, CASE WHEN c_nationkey <> 0 THEN c_nationkey::VARCHAR END AS c_nationkey, NULL::VARCHAR AS \"none\", c_custkey FROM customer",
    "slices_round_trip": r"SELECT item_id::VARCHAR AS name, 'note ' || item_id AS note, trim(regexp_replace(text, '[\s\x{0b}]+', ' ', 'g')) AS text FROM benchmark",
    "array_round_trip": "SELECT n_nationkey, n_name FROM nation",
}
