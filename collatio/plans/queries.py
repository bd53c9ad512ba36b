"""Queries on the driver's tables, each with the same result in DuckDB's SQL.

Those tables hold text in Latin letters, so the LATIN profile stands in for
the Han ones; the operators are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.operators import align, parse, reports, segment
from collatio.plans import corpora, files, witnesses
from collatio.profiles import LATIN
from collatio.sources import readers
from collatio.storage import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs, numbered from 1."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    parts = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("k", "para"))
    return parts.select("doc_id", "lang", "source", (F.col("k") + 1).alias("paragraph_idx"), "para")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.sentences(_paragraphs(spark, sf_dir), ["doc_id", "lang", "source", "paragraph_idx"], "para", LATIN)
    return rows.withColumn("char_count", F.length("plain"))


# The pieces of documents in SQL: split behind a terminator, strip, drop without letters, number.
_SQL_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SQL_SENTENCES = rf"""
paras AS (
  SELECT doc_id, lang, source, unnest(parts) AS para, generate_subscripts(parts, 1) AS paragraph_idx
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)),
pieces AS (
  SELECT doc_id, lang, source, paragraph_idx, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (
    SELECT doc_id, lang, source, paragraph_idx,
           regexp_extract_all(regexp_replace(para, '\([^()/]{{0,7}}/[^()/]{{0,7}}\)', '', 'g'), '[^.?!]*[.?!]|[^.?!]+') AS p FROM paras)),
stripped AS (
  SELECT doc_id, lang, source, paragraph_idx, k,
         regexp_replace(regexp_replace(piece, '^{_SQL_SPACE}+', ''), '{_SQL_SPACE}+$', '') AS text,
         regexp_replace(piece, '[^\p{{L}}]', '', 'g') AS plain FROM pieces),
sentences AS (
  SELECT doc_id, lang, source, paragraph_idx,
         row_number() OVER (PARTITION BY doc_id, paragraph_idx ORDER BY k) AS sentence_idx,
         text, plain, length(plain) AS char_count FROM stripped WHERE plain <> '')
"""


def segment_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "paragraph_idx", "sentence_idx", "text", "plain", "char_count")


def skipped_pieces(spark, sf_dir):
    return segment.skipped_pieces(_paragraphs(spark, sf_dir), "para", LATIN)


def sentence_ids(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = segment.number_sentences(docs, ["doc_id"], F.split("text", "\n"), LATIN)
    return rows.select("doc_id", "paragraph_idx", "sentence_idx", F.format_string("S%06d", "seq").alias("sentence_id"), F.format_string("%s#p%03d", F.col("doc_id").cast("string"), "paragraph_idx").alias("utterance_id"))


def annotate_category(spark, sf_dir):
    rows = reports.annotate(_sentences(spark, sf_dir), "plain", LATIN)
    return rows.select("doc_id", "paragraph_idx", "sentence_idx", "has_tion", "has_ment", "tion_ment_category")


def category_distribution(spark, sf_dir):
    return reports.category_distribution(reports.annotate(_sentences(spark, sf_dir), "plain", LATIN), LATIN)


def length_profile(spark, sf_dir):
    return reports.length_profile(_sentences(spark, sf_dir))


def length_histogram(spark, sf_dir):
    return reports.length_histogram(_sentences(spark, sf_dir))


def top_sections(spark, sf_dir):
    return reports.top_groups(_sentences(spark, sf_dir), "source", ["doc_id", "paragraph_idx", "sentence_idx"])


def rollup_report(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return reports.rollup(docs, "lang", "source", ["n_chars"])


def order_rollup(spark, sf_dir):
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).select("c_mktsegment", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return reports.rollup(rows, "c_mktsegment", "o_orderpriority", ["cents"])


def conditional_summary(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "n_chars").join(labels, "doc_id").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"), "n_chars")
    return reports.conditional_summary(rows, "good", "bad", "n_chars")


def byline_strip(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    # a digit group in parentheses stands for the note; any character is the mark
    marked = docs.select("doc_id", F.regexp_replace("text", r"\((\d{1,6})\)", "($1/)").alias("t"))
    kept, byline = T.trailing_byline(F.col("t"), LATIN, 80)
    return marked.select("doc_id", T.without_bylines(kept, LATIN).alias("clean"), byline.alias("byline"))


def dedupe_repeats(spark, sf_dir):
    rows = _paragraphs(spark, sf_dir).select("doc_id", F.col("paragraph_idx").alias("line_no"), F.col("para").alias("text"))
    return parse.drop_repeats(rows, ["doc_id"])


def witness_join(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    pairs = align.witness_join(align.last_per_label(docs.select("source", "doc_id"), "source", ["doc_id"]), align.last_per_label(labels.join(docs.select("doc_id", "source"), "doc_id"), "source", ["doc_id"]), "source")
    return pairs.select(F.col("a.source").alias("source"), F.col("a.doc_id").alias("a_id"), F.col("b.doc_id").alias("b_id"), F.col("b.quality").alias("quality"))


def overall_totals(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("n_chars", "text")).select(F.col("n_chars").alias("char_count_raw"), F.length(T.plain(F.col("text"), LATIN)).cast("long").alias("char_count_plain"))
    return reports.overall(docs, _sentences(spark, sf_dir))


def plain_text(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.plain(F.col("text"), LATIN).alias("plain"), T.drop_marks_and_separators(F.col("text")).alias("unmarked"), T.without_space(F.col("text")).alias("compact"))


def char_counts(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = T.plain(F.col("text"), LATIN)
    return docs.select("doc_id", F.length("text").alias("chars"), F.length(F.replace("text", F.lit("\n"), F.lit(""))).alias("chars_raw"), F.length(plain).alias("chars_plain"), F.substring(plain, 1, 50).alias("first_50"))


def line_numbers(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line")).select("doc_id", "line_no", F.length(T.rstrip(F.col("line"))).alias("n"), T.strip(F.col("line")).startswith("T").alias("starts_t"))


def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", readers.page_text(F.col("html")).alias("text"))


def sexagenary_years(spark, sf_dir):
    """Years of annotations that name two years of the cycle."""
    names = F.array(*[F.lit(n) for n in T.SEXAGENARY_YEARS])
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 37).cast("int").alias("a"), (F.col("o_custkey") % 31).cast("int").alias("b"))
    note = F.concat_ws("○", F.lit("甲"), F.coalesce(F.get(names, F.col("a")), F.lit("x")), F.coalesce(F.get(names, F.col("b")), F.lit("y")))
    return orders.select("o_orderkey", T.sexagenary_year(note).alias("year"))


def stage_counters(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("text"))
    sections = docs.select(F.split("text", "\n").alias("paragraphs"), F.col("text").alias("raw_concat"), F.transform(F.split("text", "\n"), lambda p: F.when(p.endswith(")"), F.struct(p.alias("raw")))).alias("paragraphs_byline"))
    return parse.stage_counters(sections)


def numerals(spark, sf_dir):
    """Numbers of the parts written out and read back."""
    digits = F.array(*[F.lit(d) for d in ["", *"一二三四五六七八九"]])
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    tens, ones = (F.col("p_size") / 10).cast("int"), (F.col("p_size") % 10).cast("int")
    label = F.concat(F.lit("卷"), F.when(tens > 1, F.get(digits, tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.get(digits, ones))
    return parts.select("p_partkey", T.volume_number(label, anywhere=True).alias("number"))


QUERIES = {
    f.__name__: f
    for f in (
        segment_sentences, skipped_pieces, sentence_ids, annotate_category, category_distribution, length_profile, length_histogram,
        top_sections, rollup_report, order_rollup, conditional_summary, byline_strip, dedupe_repeats, witness_join, overall_totals,
        plain_text, char_counts, line_numbers, page_text, stage_counters, numerals, sexagenary_years,
    )
}
QUERIES |= witnesses.QUERIES | corpora.QUERIES | files.QUERIES

_CATEGORY = "CASE WHEN contains(plain, 'tion') AND contains(plain, 'ment') THEN 'both' WHEN contains(plain, 'tion') THEN 'tion_only' WHEN contains(plain, 'ment') THEN 'ment_only' ELSE 'neither' END"
_BUCKET = "CASE WHEN char_count <= 3 THEN '1-3' WHEN char_count <= 10 THEN '4-10' WHEN char_count <= 30 THEN '11-30' WHEN char_count <= 60 THEN '31-60' WHEN char_count <= 100 THEN '61-100' ELSE '101+' END"

ORACLE_SQL = {
    "segment_sentences": f"WITH {_SQL_SENTENCES} SELECT doc_id, paragraph_idx, sentence_idx, text, plain, char_count FROM sentences",
    "skipped_pieces": f"WITH {_SQL_SENTENCES} SELECT count(*) AS skipped FROM stripped WHERE plain = '' AND text <> ''",
    "sentence_ids": f"""WITH {_SQL_SENTENCES} SELECT doc_id, paragraph_idx, sentence_idx,
        'S' || lpad((row_number() OVER (ORDER BY doc_id, paragraph_idx, sentence_idx))::VARCHAR, 6, '0') AS sentence_id,
        doc_id || '#p' || CASE WHEN paragraph_idx < 1000 THEN lpad(paragraph_idx::VARCHAR, 3, '0') ELSE paragraph_idx::VARCHAR END AS utterance_id FROM sentences""",
    "annotate_category": f"WITH {_SQL_SENTENCES} SELECT doc_id, paragraph_idx, sentence_idx, contains(plain, 'tion') AS has_tion, contains(plain, 'ment') AS has_ment, {_CATEGORY} AS tion_ment_category FROM sentences",
    "category_distribution": f"""WITH {_SQL_SENTENCES}, names(position, tion_ment_category) AS (VALUES (0, 'both'), (1, 'tion_only'), (2, 'ment_only'), (3, 'neither')),
        counts AS (SELECT {_CATEGORY} AS c, count(*) AS n FROM sentences GROUP BY 1)
        SELECT position, tion_ment_category, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM counts) AS share FROM names LEFT JOIN counts ON c = tion_ment_category""",
    "length_profile": f"""WITH {_SQL_SENTENCES}, ranked AS (SELECT char_count AS v, row_number() OVER (ORDER BY char_count) AS r, count(*) OVER () AS n FROM sentences)
        SELECT count(*) AS n, sum(v)::DOUBLE / count(*) AS mean, min(v) AS min, max(v) AS max, max(CASE WHEN r = n // 2 + 1 THEN v END) AS upper_median,
        floor((max(CASE WHEN r = (n - 1) // 2 + 1 THEN v END) + max(CASE WHEN r = n // 2 + 1 THEN v END)) / 2.0)::INT AS median_int FROM ranked""",
    "length_histogram": f"""WITH {_SQL_SENTENCES}, names(position, bucket) AS (VALUES (0, '1-3'), (1, '4-10'), (2, '11-30'), (3, '31-60'), (4, '61-100'), (5, '101+')),
        counts AS (SELECT {_BUCKET} AS b, count(*) AS n FROM sentences GROUP BY 1)
        SELECT position, bucket, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM counts) AS share FROM names LEFT JOIN counts ON b = bucket""",
    "top_sections": f"WITH {_SQL_SENTENCES} SELECT source, count(*) AS n FROM sentences GROUP BY source ORDER BY n DESC, min((doc_id, paragraph_idx, sentence_idx)) LIMIT 10",
    "rollup_report": "SELECT lang, source, (GROUPING(lang, source))::BIGINT AS level, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (lang, source) HAVING GROUPING(lang, source) < 3",
    "order_rollup": "SELECT c_mktsegment, o_orderpriority, (GROUPING(c_mktsegment, o_orderpriority))::BIGINT AS level, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority) HAVING GROUPING(c_mktsegment, o_orderpriority) < 3",
    "conditional_summary": """SELECT count(*) AS total, count_if(quality = 1) AS first, count_if(toxic = 1) AS second, count_if(quality = 1 AND toxic = 1) AS both,
        count_if(quality = 1 AND toxic <> 1) AS first_only, count_if(quality <> 1 AND toxic = 1) AS second_only, count_if(quality <> 1 AND toxic <> 1) AS neither,
        avg(n_chars) AS mean, max(n_chars) AS max, min(n_chars) AS min FROM documents JOIN labels USING (doc_id)""",
    "byline_strip": rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '\((\d{{1,6}})\)', '(\1/)', 'g') AS t FROM documents),
        c AS (SELECT doc_id, t, regexp_extract(t, '\(([^()]{{1,80}})\){_SQL_SPACE}*$', 1) AS inside, regexp_extract(t, '\(([^()]{{1,80}})\){_SQL_SPACE}*$') AS tail FROM m),
        k AS (SELECT doc_id, CASE WHEN contains(inside, '/') AND length(inside) <= 8 THEN regexp_replace(t[1:length(t) - length(tail)], '{_SQL_SPACE}+$', '') ELSE t END AS kept,
                     CASE WHEN contains(inside, '/') AND length(inside) <= 8 THEN tail END AS byline FROM c)
        SELECT doc_id, regexp_replace(kept, '\([^()/]{{0,7}}/[^()/]{{0,7}}\)', '', 'g') AS clean, byline FROM k""",
    "dedupe_repeats": """WITH paras AS (SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
        c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS n, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_no) AS k FROM paras)
        SELECT doc_id, line_no, text FROM c WHERE n < 5 OR k = 1""",
    "witness_join": """WITH a AS (SELECT source, max(doc_id) AS a_id FROM documents GROUP BY source),
        b AS (SELECT source, max(doc_id) AS b_id, arg_max(quality, doc_id) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY source)
        SELECT source, a_id, b_id, quality FROM a JOIN b USING (source)""",
    "overall_totals": rf"""WITH {_SQL_SENTENCES}, d AS (SELECT count(*) AS letters, sum(n_chars)::BIGINT AS chars_raw, sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')))::BIGINT AS chars_plain FROM documents)
        SELECT letters, chars_raw, chars_plain, (SELECT count(*) FROM sentences) AS sentences, chars_plain::DOUBLE / (SELECT count(*) FROM sentences) AS mean_length FROM d""",
    "plain_text": rf"""SELECT doc_id, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS plain, regexp_replace(text, '[\p{{P}}\p{{Z}}]', '', 'g') AS unmarked, regexp_replace(text, '{_SQL_SPACE}+', '', 'g') AS compact FROM documents""",
    "char_counts": r"""SELECT doc_id, length(text) AS chars, length(replace(text, chr(10), '')) AS chars_raw, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS chars_plain,
        substr(regexp_replace(text, '[^\p{L}]', '', 'g'), 1, 50) AS first_50 FROM documents""",
    "line_numbers": rf"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line, len(p) AS total FROM (
          SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM documents))
        SELECT doc_id, line_no, length(regexp_replace(line, '{_SQL_SPACE}+$', '')) AS n, starts_with(regexp_replace(line, '^{_SQL_SPACE}+', ''), 'T') AS starts_t
        FROM l WHERE NOT (line_no = total - 1 AND line = '')""",
    "page_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""",
    "stage_counters": """WITH p AS (SELECT text, string_split(text, chr(10)) AS parts FROM documents),
        s AS (SELECT count(*) AS records, sum(len(parts))::BIGINT AS paragraphs, sum(length(text))::BIGINT AS chars, sum(len(list_filter(parts, lambda x: ends_with(x, ')'))))::BIGINT AS bylines FROM p)
        SELECT records, paragraphs, chars, bylines, bylines::DOUBLE / paragraphs AS byline_share FROM s""",
    "sexagenary_years": "SELECT o_orderkey, CASE WHEN least(o_orderkey % 37, o_custkey % 31) < 30 THEN (1554 + least(o_orderkey % 37, o_custkey % 31))::INT END AS year FROM orders",
    "numerals": "SELECT p_partkey, CASE WHEN p_size = 0 THEN -1 ELSE p_size END AS number FROM part",
}
ORACLE_SQL |= witnesses.ORACLE_SQL | corpora.ORACLE_SQL | files.ORACLE_SQL
