"""Collation queries: two witnesses made of `documents`, and the same results in DuckDB's SQL.

Every word of a document becomes one Han character that tells its position, so
that what an alignment must find follows from the words: SQL gets it by gaps
and islands, without a matcher.  Witness b holds all characters, with marks
behind those whose word ends in one; it gives every section twice, of which
only the later one is right, and names sections of fewer than SHORT words
otherwise.  In witness a, words of 7 letters are another character, those of 8
are missing, those of 9 are two others, and behind those of 10 and 11 stand
five and two characters more; a word with a line break begins a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.operators import align, reports, segment, transfer
from collatio.profiles import HAN_CORPUS
from collatio.storage import materialised, spread

#: Words of a section: as many characters tell positions apart.
SECTION_WORDS = 60_000
SHORT = 8
_FIRST, _OTHER, _SECOND = 0x20000, 0x4E00, 0x3400
_FIVE, _TWO = "豈" * 5, "更" * 2
_MARKS = ((".", "。」"), (",", "，"), ("?", "？"), ("!", "！"), (";", "；"), (":", "："))


def _alphabet(n: Column, first: int, many: int) -> Column:
    """Characters of the places 0 to n - 1, decoded in one go."""
    codes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(i % many + first), 8, "0"))
    return T.chars(F.decode(F.unhex(F.array_join(codes, "")), "UTF-32"))


def sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(witness a, witness b) of all documents, as parsed sections."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    blocks = docs.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / SECTION_WORDS).cast("int"))).alias("block"))
    words = blocks.select("doc_id", "block", F.slice("words", F.col("block") * SECTION_WORDS + 1, F.lit(SECTION_WORDS)).alias("words"))
    label = F.concat_ws(".", "doc_id", "block")

    def in_a(x: Column, at: Column) -> Column:
        size = F.length(x["words"])
        piece = (
            F.when(size == 7, x["other"]).when(size == 8, F.lit("")).when(size == 9, F.concat(x["other"], x["second"]))
            .when(size == 10, F.concat(x["own"], F.lit(_FIVE))).when(size == 11, F.concat(x["own"], F.lit(_TWO))).otherwise(x["own"])
        )
        return F.concat(F.when(x["words"].contains("\n") & (at > 0), F.lit("\n")).otherwise(F.lit("")), piece)

    def in_b(word: Column, own: Column) -> Column:
        mark = F.lit("")
        for end, written in _MARKS:
            mark = F.when(word.endswith(end), F.lit(written)).otherwise(mark)
        return F.concat(own, mark)

    # arguments of transform and zip_with are worked out once, not for each word
    n = F.size("words")
    own, other, second = _alphabet(n, _FIRST, SECTION_WORDS), _alphabet(n, _OTHER, 20_000), _alphabet(n, _SECOND, 6_000)

    def section(source: str, label: Column, paragraphs: Column, no: int) -> list[Column]:
        return [
            F.col("doc_id").cast("int").alias("juan_num"), label.alias("juan_label"), F.lit(source).alias("file_name"),
            F.array().cast("array<struct<level:int,text:string>>").alias("headings"), paragraphs.alias("paragraphs"),
            F.transform(paragraphs, lambda p: F.lit(None).cast("struct<raw:string>")).alias("paragraphs_byline"),
            F.format_string("%012d", "doc_id").alias("source_file"), (F.col("block") * 2 + no).cast("long").alias("section"),
        ]

    zipped = F.arrays_zip("words", own.alias("own"), other.alias("other"), second.alias("second"))
    whole = F.split(F.array_join(F.transform(zipped, in_a), ""), "\n")
    a = words.select(section("a", label, F.filter(whole, lambda p: p != ""), 0))
    named = F.when(F.size("words") < SHORT, F.concat(label, F.lit(" short"))).otherwise(label)
    right = F.array(F.concat(F.lit("「"), F.array_join(F.zip_with("words", own, in_b), "")))
    b = words.select(section("b", named, F.array(F.lit("無")), 0)).unionByName(words.select(section("b", named, right, 1)))
    return a, b


def _aligned(spark, sf_dir) -> DataFrame:
    return align.align(*sections(spark, sf_dir), autojunk=False)


def align_opcodes(spark, sf_dir):
    return _aligned(spark, sf_dir).select("juan_label", F.posexplode("ops").alias("op_no", "op")).select("juan_label", "op_no", "op.*")


def align_summary(spark, sf_dir):
    return align.summary(_aligned(spark, sf_dir))


def align_mismatches(spark, sf_dir):
    return align.mismatches(_aligned(spark, sf_dir))


def mismatch_split(spark, sf_dir):
    """How many rows the three mismatch exports hold."""
    rows = align.split_mismatches(align.mismatches(materialised(_aligned(spark, sf_dir))))
    named = [part.select(F.lit(name).alias("export")) for name, part in zip(("all", "variant", "substantive"), rows)]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("export").agg(F.count("*").alias("n"))


def mismatch_types(spark, sf_dir):
    return align.type_distribution(align.mismatches(_aligned(spark, sf_dir)))


def alignment_totals(spark, sf_dir):
    return align.weighted_means(align.summary(_aligned(spark, sf_dir)))


def alignment_lowest(spark, sf_dir):
    return align.lowest(align.summary(_aligned(spark, sf_dir))).select("juan_label", "juan_num", "relaxed_ratio")


def unmatched_keys(spark, sf_dir):
    return align.unmatched(*sections(spark, sf_dir))


def _marked(spark, sf_dir) -> DataFrame:
    """Written once, as the chain does: what reads it does not work the units out again for each paragraph."""
    return materialised(transfer.marked(*sections(spark, sf_dir)))


def punctuated_sections(spark, sf_dir):
    """Paragraphs with the marks of witness b, and where each character comes from."""
    rows = transfer.punctuated(_marked(spark, sf_dir))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("juan_label", "matched", "fallback_span_count", F.size("paragraphs_plain").alias("paragraphs"), joined("paragraphs_punctuated"), joined("paragraphs_provenance"))


def fallback_spans(spark, sf_dir):
    return transfer.spans(_marked(spark, sf_dir))


def fallback_statistics(spark, sf_dir):
    return transfer.fallback_statistics(transfer.spans(_marked(spark, sf_dir)))


def transfer_totals(spark, sf_dir):
    return transfer.transfer_totals(transfer.punctuated(_marked(spark, sf_dir)))


def corpus_sentences(spark, sf_dir):
    """Annotated sentences of the punctuated sections, numbered through."""
    rows = segment.corpus_sentences(transfer.punctuated(_marked(spark, sf_dir)))
    return reports.annotate(rows).select("sentence_id", "juan_label", "paragraph_idx", "sentence_idx", "utterance_id", "text_punctuated", "text_plain", "char_count", "li_qi_category")


def decode_labels(spark, sf_dir):
    """Marks of witness b put behind their characters as predictions."""
    _, b = sections(spark, sf_dir)
    texts = align.last_per_label(b).select("juan_label", F.array_join("paragraphs", "").alias("text"))
    chars, marks = T.marks_after(F.col("text"), HAN_CORPUS)
    # the first mark behind a character is predicted; the label of a mark is its place in the list
    names = "".join(m[0] for _, m in _MARKS)
    ends = F.transform(marks, lambda m, i: F.struct((i + 1).alias("end"), F.substring(m, 1, 1).alias("mark")))
    preds = F.transform(F.filter(ends, lambda p: p["mark"] != ""), lambda p: F.struct(p["end"].alias("end"), F.concat(F.lit("B-"), F.instr(F.lit(names), p["mark"]).cast("string")).alias("entity")))
    table = F.create_map(*[x for i, m in enumerate(names, start=1) for x in (F.lit(f"B-{i}"), F.lit(m))], F.lit("O"), F.lit(""))
    ready = texts.select("juan_label", F.array_join(chars, "").alias("plain"), preds.alias("preds"))
    return ready.select("juan_label", T.apply_predictions(F.col("plain"), F.col("preds"), table).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        align_opcodes, align_summary, align_mismatches, mismatch_split, mismatch_types, alignment_totals, alignment_lowest, unmatched_keys,
        punctuated_sections, fallback_spans, fallback_statistics, transfer_totals, corpus_sentences, decode_labels,
    )
}

_MARK_SQL = "CASE " + " ".join(f"WHEN ends_with(word, '{end}') THEN '{written}'" for end, written in reversed(_MARKS)) + " ELSE '' END"
#: items: the words as runs of a and b characters; ops: what lies between equal characters.
_SQL_SECTIONS = f"""
blocks AS (
  SELECT doc_id, k // {SECTION_WORDS} AS block, k % {SECTION_WORDS} AS pos, word FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS k FROM documents)),
words AS (
  SELECT doc_id, block, doc_id || '.' || block AS label, pos::INT AS pos, word, length(word) AS size,
         chr(({_FIRST} + pos)::INT) AS own, chr(({_OTHER} + pos % 20000)::INT) || CASE WHEN length(word) = 9 THEN chr(({_SECOND} + pos % 6000)::INT) ELSE '' END AS other,
         {_MARK_SQL} AS mark, sum((contains(word, chr(10)) AND pos > 0)::INT) OVER (PARTITION BY doc_id, block ORDER BY pos) AS para,
         count(*) OVER (PARTITION BY doc_id, block) AS n_words FROM blocks),
paired AS (SELECT * FROM words WHERE n_words >= {SHORT}),
items AS (
  SELECT label, pos, 0 AS part, para, 'equal' AS kind, own AS a, own AS b FROM paired WHERE size NOT IN (7, 8, 9) UNION ALL
  SELECT label, pos, 0, para, 'gap', CASE WHEN size = 8 THEN '' ELSE other END, own FROM paired WHERE size IN (7, 8, 9) UNION ALL
  SELECT label, pos, 1, para, 'gap', CASE WHEN size = 10 THEN '{_FIVE}' ELSE '{_TWO}' END, '' FROM paired WHERE size IN (10, 11)),
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY label ORDER BY pos, part) AS run FROM (
    SELECT *, (lag(kind, 1, '') OVER (PARTITION BY label ORDER BY pos, part) <> kind)::INT AS starts FROM items)),
grouped AS (
  SELECT label, run, any_value(kind) AS kind, string_agg(a, '' ORDER BY pos, part) AS a, string_agg(b, '' ORDER BY pos, part) AS b FROM runs GROUP BY label, run),
ops AS (
  SELECT label, run, (run - 1)::INT AS op_no, a, b,
         CASE WHEN kind = 'equal' THEN 'equal' WHEN a = '' THEN 'insert' WHEN b = '' THEN 'delete' ELSE 'replace' END AS tag,
         (sum(length(a)) OVER w - length(a))::INT AS i1, (sum(length(a)) OVER w)::INT AS i2, (sum(length(b)) OVER w - length(b))::INT AS j1, (sum(length(b)) OVER w)::INT AS j2,
         kind = 'gap' AND a <> '' AND length(a) = length(b) AS is_variant
  FROM grouped WINDOW w AS (PARTITION BY label ORDER BY run)),
texts AS (SELECT label, string_agg(a, '' ORDER BY run) AS a, string_agg(b, '' ORDER BY run) AS b FROM grouped GROUP BY label),
marked_b AS (SELECT label, sum(1 + length(mark)) + 1 AS chars FROM paired GROUP BY label)"""

# rounding of a ratio to four decimals by its exact binary value, ties to even
_R4 = "((n // 4722366482869645213696::HUGEINT)::BIGINT + CASE WHEN n % 4722366482869645213696::HUGEINT > 2361183241434822606848::HUGEINT THEN 1 WHEN n % 4722366482869645213696::HUGEINT < 2361183241434822606848::HUGEINT THEN 0 ELSE ((n // 4722366482869645213696::HUGEINT) % 2)::BIGINT END) / 10000.0::DOUBLE"


def _rounded(x: str) -> str:
    n = f"(((floor(({x}) * 1048576.0::DOUBLE)::HUGEINT) * 4503599627370496::HUGEINT + floor((({x}) * 1048576.0::DOUBLE - floor(({x}) * 1048576.0::DOUBLE)) * 4503599627370496.0::DOUBLE)::HUGEINT) * 10000::HUGEINT)"
    return "(" + _R4.replace("(n ", f"({n} ").replace("WHEN n ", f"WHEN {n} ") + ")"


_SQL_SUMMARY = f"""{_SQL_SECTIONS},
counted AS (
  SELECT label, sum(i2 - i1) AS na, sum(j2 - j1) AS nb, coalesce(sum(i2 - i1) FILTER (tag = 'equal'), 0) AS eq, coalesce(sum(i2 - i1) FILTER (is_variant), 0) AS va,
         count(*) FILTER (tag <> 'equal') AS mm, count(*) FILTER (is_variant) AS vc FROM ops GROUP BY label),
ratio AS (SELECT *, CASE WHEN na + nb > 0 THEN 2.0::DOUBLE * eq / (na + nb) ELSE 1.0 END AS strict, CASE WHEN na + nb > 0 THEN 2.0::DOUBLE * (eq + va) / (na + nb) ELSE 0.0 END AS relaxed FROM counted),
summary AS (
  SELECT label AS juan_label, split_part(label, '.', 1)::INT AS juan_num, na::INT AS a_chars, nb::INT AS b_plain_chars, chars::INT AS b_with_punct_chars,
         {_rounded('strict')} AS strict_ratio, {_rounded('relaxed')} AS relaxed_ratio, mm::INT AS mismatch_count, vc::INT AS variant_count, (mm - vc)::INT AS substantive_count
  FROM ratio JOIN marked_b USING (label))"""

#: Characters of a with the marks they get; para_no counts paragraphs that hold any.
_SQL_MARKED = f"""{_SQL_SECTIONS},
a_chars AS (
  SELECT label, pos, part, run, para, unnest(string_split(a, '')) AS c, generate_subscripts(string_split(a, ''), 1) AS k FROM runs WHERE a <> ''),
a_placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos, part, k) - 1 AS i FROM a_chars),
units AS (
  SELECT p.label, p.i, p.run, p.para, p.c, CASE WHEN o.tag = 'equal' OR o.is_variant THEN w.mark ELSE '' END AS m
  FROM a_placed p JOIN ops o ON o.label = p.label AND o.run = p.run LEFT JOIN paired w ON w.label = p.label AND w.pos = o.j1 + p.i - o.i1),
short_units AS (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY pos, k) - 1 AS i, 0 AS run, para, c, '' AS m FROM (
    SELECT label, pos, para, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS k FROM (
      SELECT label, pos, para, CASE size WHEN 7 THEN other WHEN 8 THEN '' WHEN 9 THEN other WHEN 10 THEN own || '{_FIVE}' WHEN 11 THEN own || '{_TWO}' ELSE own END AS t
      FROM words WHERE n_words < {SHORT}) WHERE t <> '')),
all_units AS (SELECT *, true AS matched FROM units UNION ALL SELECT *, false FROM short_units),
paras AS (
  SELECT label, matched, para, row_number() OVER (PARTITION BY label ORDER BY para) AS para_no, count(*) AS n_chars, sum(length(m)) AS n_marks,
         string_agg(c || m, '' ORDER BY i) AS text, string_agg(' ' || repeat('Z', length(m)), '' ORDER BY i) AS provenance FROM all_units GROUP BY label, matched, para),
span AS (
  SELECT o.*, CASE WHEN tag = 'replace' THEN 'replace_lendiff' ELSE 'delete_large' END AS type FROM ops o
  WHERE (tag = 'replace' AND NOT is_variant) OR (tag = 'delete' AND i2 - i1 > 3)),
outs AS (SELECT label, string_agg(c || m, '' ORDER BY i) AS out FROM units GROUP BY label),
written AS (SELECT label, run, sum(length(c || m)) AS n FROM units GROUP BY label, run),
upto AS (SELECT o.label, o.run, coalesce(sum(n) OVER (PARTITION BY o.label ORDER BY o.run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pre FROM ops o LEFT JOIN written USING (label, run)),
spans AS (
  SELECT s.label AS juan_label, s.op_no, s.type, s.i1 AS k_start, s.i2 AS k_end, s.a AS k_text, s.b AS z_text,
         substr(out, greatest(0, pre - 50) + 1, pre - greatest(0, pre - 50)) AS context_before, substr(out, pre + s.i2 - s.i1 + 1, 50) AS context_after, pre AS out_start, (pre + s.i2 - s.i1)::INT AS out_end
  FROM span s JOIN upto USING (label, run) JOIN outs USING (label))"""

ORACLE_SQL = {
    "align_opcodes": f"WITH {_SQL_SECTIONS} SELECT label AS juan_label, op_no, tag, i1, i2, j1, j2 FROM ops",
    "align_summary": f"WITH {_SQL_SUMMARY} SELECT * FROM summary",
    "align_mismatches": f"""WITH {_SQL_SECTIONS} SELECT ops.label AS juan_label, split_part(ops.label, '.', 1)::INT AS juan_num, op_no, tag AS type, i1 || '-' || i2 AS a_pos, ops.a AS a_text, ops.b AS b_text,
        substr(texts.a, greatest(0, i1 - 20) + 1, i1 - greatest(0, i1 - 20)) AS context_before, substr(texts.a, i2 + 1, 20) AS context_after, is_variant
        FROM ops JOIN texts USING (label) WHERE tag <> 'equal'""",
    "mismatch_split": f"""WITH {_SQL_SECTIONS}, m AS (SELECT is_variant FROM ops WHERE tag <> 'equal'), e AS (
        SELECT 'all' AS export FROM m UNION ALL SELECT 'variant' FROM m WHERE is_variant UNION ALL SELECT 'substantive' FROM m WHERE NOT is_variant)
        SELECT export, count(*) AS n FROM e GROUP BY export""",
    "mismatch_types": f"WITH {_SQL_SECTIONS} SELECT tag AS type, count(*) AS n FROM ops WHERE tag <> 'equal' AND NOT is_variant GROUP BY tag",
    "alignment_totals": f"""WITH {_SQL_SUMMARY} SELECT count(*) AS sections, sum(strict_ratio * (a_chars + b_plain_chars)) / sum(a_chars + b_plain_chars) AS strict,
        sum(relaxed_ratio * (a_chars + b_plain_chars)) / sum(a_chars + b_plain_chars) AS relaxed, sum(a_chars)::BIGINT AS a_chars, sum(b_plain_chars)::BIGINT AS b_chars,
        sum(mismatch_count)::BIGINT AS mismatches, sum(variant_count)::BIGINT AS variants, sum(substantive_count)::BIGINT AS substantive,
        100.0 * sum(variant_count) / sum(mismatch_count) AS variant_pct, 100.0 * sum(substantive_count) / sum(mismatch_count) AS substantive_pct FROM summary""",
    "alignment_lowest": f"WITH {_SQL_SUMMARY} SELECT juan_label, juan_num, relaxed_ratio FROM summary ORDER BY relaxed_ratio, juan_num, juan_label LIMIT 5",
    "unmatched_keys": f"""WITH {_SQL_SECTIONS}, s AS (SELECT DISTINCT label FROM words WHERE n_words < {SHORT})
        SELECT label AS juan_label, 'a' AS only_in FROM s UNION ALL SELECT label || ' short', 'b' FROM s""",
    "punctuated_sections": f"""WITH {_SQL_MARKED}, s AS (SELECT label, any_value(n_words) >= {SHORT} AS matched FROM words GROUP BY label),
        p AS (SELECT label, count(*) AS n, string_agg(text, '|' ORDER BY para) AS text, string_agg(provenance, '|' ORDER BY para) AS provenance FROM paras GROUP BY label),
        f AS (SELECT juan_label AS label, count(*) AS n FROM spans GROUP BY 1)
        SELECT s.label AS juan_label, s.matched, coalesce(f.n, 0)::INT AS fallback_span_count, coalesce(p.n, 0)::INT AS paragraphs, coalesce(text, '') AS paragraphs_punctuated, coalesce(provenance, '') AS paragraphs_provenance
        FROM s LEFT JOIN p USING (label) LEFT JOIN f USING (label)""",
    "fallback_spans": f"WITH {_SQL_MARKED} SELECT * FROM spans",
    "fallback_statistics": f"WITH {_SQL_MARKED} SELECT type, count(*) AS n, sum(k_end - k_start)::BIGINT AS chars FROM spans GROUP BY type",
    "transfer_totals": f"WITH {_SQL_MARKED} SELECT count(*) AS paragraphs, sum(length(text))::BIGINT AS out_chars, sum(n_marks)::BIGINT AS marks FROM paras WHERE matched",
    "corpus_sentences": f"""WITH {_SQL_MARKED},
        pieces AS (SELECT label, para_no, unnest(p) AS t, generate_subscripts(p, 1) AS k FROM (SELECT label, para_no, regexp_extract_all(text, '[^。？！；]*[。？！；]|[^。？！；]+') AS p FROM paras)),
        kept AS (SELECT label, para_no, k, t, regexp_replace(t, '[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{20000}}-\\x{{2ffff}}]', '', 'g') AS plain FROM pieces),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY label, para_no ORDER BY k) AS s,
          row_number() OVER (ORDER BY split_part(label, '.', 1)::INT, split_part(label, '.', 2)::INT, para_no, k) AS seq FROM kept WHERE plain <> '')
        SELECT 'S' || lpad(seq::VARCHAR, greatest(6, length(seq::VARCHAR))::INT, '0') AS sentence_id, label AS juan_label, para_no::INT AS paragraph_idx, s::INT AS sentence_idx,
          label || '#p' || lpad(para_no::VARCHAR, greatest(3, length(para_no::VARCHAR))::INT, '0') AS utterance_id, t AS text_punctuated, plain AS text_plain, length(plain)::INT AS char_count,
          CASE WHEN contains(plain, '理') AND contains(plain, '氣') THEN 'both' WHEN contains(plain, '理') THEN 'li_only' WHEN contains(plain, '氣') THEN 'qi_only' ELSE 'neither' END AS li_qi_category FROM numbered""",
    "decode_labels": f"""WITH {_SQL_SECTIONS} SELECT CASE WHEN any_value(n_words) < {SHORT} THEN label || ' short' ELSE label END AS juan_label, string_agg(own || substr(mark, 1, 1), '' ORDER BY pos) AS text FROM words GROUP BY label""",
}
