"""Licence recognition by sentences and ordered rules, in SQL functions alone.

A text is cut into sentences, which may be wrapped over lines, commented out
and listed; a sentence that is not known is tried by clauses, and a clause by
lines.  Each is brought to a normal form (A-Z lower-cased, everything but
letters a-z and digits as one blank) and looked up among the known licence
sentences.  The identifiers found, in order, are the text's sequence.  Rules
are runs of identifiers (sentences that are not known may lie between); the
sequence is read from its start, the longest rule that fits is met there and
its identifiers are used up.  All of it is work on one row, so nothing is
shuffled and no row depends on another.

Every known sentence holds one of a few words, so a text that holds none of
them is not cut at all.

The sentences are those of license_rules.json, and families made by rule:
licence lines, SPDX lines and Creative Commons notices.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip()


def _load() -> tuple[list[tuple[int, str]], list[tuple[str, str, tuple[int, ...]]]]:
    """(identifier, normal form) of the sentences; (rule, licence, identifiers), longer rules first."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_rules.json"), encoding="utf-8") as f:
        known = json.load(f)
    sentences = {_plain(s): int(i) for i, s in known["sentences"].items()}
    rules = [(name, licence, tuple(ids)) for name, licence, ids in known["rules"]]

    def family(first: int, each) -> None:
        for k, (sentence, rule, licence) in enumerate(each):
            if _plain(sentence) not in sentences:
                sentences[_plain(sentence)] = first + k
                rules.append((rule, licence, (first + k,)))

    lines = known["lines"]
    family(100, ((f"{verb} {name}", f"{licence.lower()}-line", licence) for licence, name in lines["names"] for verb in lines["verbs"]))
    family(300, ((f"SPDX-License-Identifier: {i}", f"{i.lower()}-spdx", i) for i in known["spdx"]))
    cc = known["creative_commons"]
    family(400, ((f"This work is licensed under a Creative Commons {name} {v} {scope} License", f"cc-{kind.lower()}-{v}-notice", f"CC-{kind}-{v}") for kind, name in cc["kinds"] for v, scope in cc["versions"]))
    return [(i, s) for s, i in sentences.items()], sorted(rules, key=lambda r: -len(r[2]))


SENTENCES, RULES = _load()

#: Comment leaders and list marks at the start of a line.
_LEADER = r"^[ \t]*(?:<!--|/?[*]+/?|//+|#+|;+|--+|%+|>+)[ \t]*"
_MARK = r"^[ \t]*[(]?[0-9a-zA-Z]{1,2}[)][ \t]+"
#: The blank line before the address in a notice, which ends no sentence.
_ADDRESS = r"(License at)[ \t]*\n[ \t]*\n[ \t]*(http)"
#: Ends of sentences; single newlines are no ends.  Then of clauses, and of lines.
_SENTENCE = r"[.!?]+(?:[ \t\n]+|$)|:[ \t]*\n|\n[ \t]*\n"
_CLAUSE, _LINE = r";[ \t\n]+", r"\n+"


def telling_words(sentences: list[tuple[int, str]]) -> list[str]:
    """Words of which every sentence holds one: those that most hold, of them the longest."""
    left, out = [s for _, s in sentences], []
    while left:
        # long words are rarer in other texts
        words = {w for s in left for w in s.split()}
        out.append(max(words, key=lambda w: (sum(w in s for s in left) * (len(w) >= 7), len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def identifiers(text: Column, sentences: list[tuple[int, str]] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order, repeats included."""
    ids = F.array(*[F.lit(i) for i, _ in sentences])
    known = F.array(*[F.lit(s) for _, s in sentences])
    shortest = min(len(s) for _, s in sentences)

    def looked_up(text: Column, ends: str) -> Column:
        """Pieces with their place among the known; none is shorter than its normal form."""
        long = F.filter(F.split(text, ends), lambda x: F.length(x) >= shortest)
        return F.transform(long, lambda x: F.struct(x.alias("piece"), F.array_position(known, normal(x)).alias("at")))

    def within(text: Column, ends: list[str]) -> Column:
        """Places in order; a piece that is not known is cut further."""
        if len(ends) == 1:
            return F.transform(looked_up(text, ends[0]), lambda x: x["at"])
        return F.flatten(F.transform(looked_up(text, ends[0]), lambda x: F.when(x["at"] > 0, F.array(x["at"])).otherwise(within(x["piece"], ends[1:]))))

    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bare = F.regexp_replace(F.regexp_replace(lines, f"(?md){_LEADER}", ""), f"(?md){_MARK}", "")
    whole = F.regexp_replace(bare, _ADDRESS, "$1 $2")
    places = within(whole, [f"(?d){_SENTENCE}", _CLAUSE, _LINE])
    return F.transform(F.filter(places, lambda p: p > 0), lambda p: F.element_at(ids, p.cast("int")))


def _written(ids: tuple[int, ...]) -> str:
    return "".join(f"L{i}," for i in ids)


def scan(docs: DataFrame, sentences: list[tuple[int, str]] = SENTENCES, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, identifiers, rules, licences, licensed) for every row.

    identifiers, rules and licences are comma-separated texts: identifiers in
    the order of the text, rules one for each time that one is met, in order,
    licences sorted and distinct; all are empty where nothing is met, as for
    null and empty texts.  Where two rules are equally long the first of the
    list is met.  Repeated rows and null ids stay; an empty table gives an
    empty table.
    """
    rules = sorted(rules, key=lambda r: -len(r[2]))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.lower(text).alias("_low"))
    told = F.lit(False)
    for word in telling_words(sentences):
        told = told | F.col("_low").contains(word)
    held = F.when(told, F.transform(identifiers(F.col("_text"), sentences), lambda i: F.concat(F.lit("L"), i.cast("string"), F.lit(","))))
    found = slim.select("_id", F.array_join(F.coalesce(held, F.array().cast("array<string>")), "").alias("seq"))
    forms = F.array(*[F.lit(_written(ids)) for *_, ids in rules])
    table = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence")) for name, licence, _ in rules])
    pattern = "|".join(dict.fromkeys(_written(ids) for *_, ids in rules))
    met = F.transform(F.regexp_extract_all("seq", F.lit(f"({pattern})"), F.lit(1)), lambda m: F.element_at(table, F.array_position(forms, m).cast("int")))
    found = found.select("_id", "seq", F.when(F.col("seq") == "", F.slice(table, 1, 0)).otherwise(met).alias("met"))
    return found.select(
        F.col("_id").alias(id_col),
        F.expr("trim(BOTH ',' FROM replace(seq, 'L', ''))").alias("identifiers"),
        F.array_join(F.transform("met", lambda r: r["rule"]), ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("met", lambda r: r["licence"]))), ",").alias("licences"),
        (F.size("met") > 0).alias("licensed"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', {i})" for i, s in SENTENCES)
    rules = ", ".join(f"('{name}', '{licence}', '{_written(ids)}')" for name, licence, ids in RULES)
    pattern = "|".join(dict.fromkeys(_written(ids) for *_, ids in RULES))
    e = lambda p: p.replace("'", "''")
    plain = f"trim(regexp_replace(translate(piece, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    level = lambda n, source, keys, ends: f"""
cut{n} AS (SELECT {keys}, generate_subscripts(p, 1) AS p{n}, unnest(p) AS piece FROM (SELECT {keys}, regexp_split_to_array(piece, '{e(ends)}') AS p FROM {source})),
at{n} AS (SELECT cut{n}.*, id FROM cut{n} LEFT JOIN known ON known.sentence = {plain}),"""  # noqa: E731
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rules(rule, licence, form) AS (VALUES {rules}),
rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS txt FROM documents),
lines AS (SELECT r, replace(replace(txt, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM rows),
bare AS (SELECT r, regexp_replace(regexp_replace(t, '(?m){e(_LEADER)}', '', 'g'), '(?m){e(_MARK)}', '', 'g') AS t FROM lines),
whole AS (SELECT r, regexp_replace(t, '{e(_ADDRESS)}', '\\1 \\2', 'g') AS piece FROM bare),
{level(1, "whole", "r", _SENTENCE)}
{level(2, "(SELECT * FROM at1 WHERE id IS NULL)", "r, p1", _CLAUSE)}
{level(3, "(SELECT * FROM at2 WHERE id IS NULL)", "r, p1, p2", _LINE)}
every AS (
  SELECT r, p1, 0 AS p2, 0 AS p3, id FROM at1 WHERE id IS NOT NULL UNION ALL
  SELECT r, p1, p2, 0, id FROM at2 WHERE id IS NOT NULL UNION ALL
  SELECT r, p1, p2, p3, id FROM at3 WHERE id IS NOT NULL),
found AS (SELECT r, string_agg('L' || id || ',', '' ORDER BY p1, p2, p3) AS seq FROM every GROUP BY r),
runs AS (SELECT r, generate_subscripts(m, 1) AS k, unnest(m) AS form FROM (SELECT r, regexp_extract_all(seq, '{pattern}') AS m FROM found)),
named AS (
  SELECT r, string_agg(rule, ',' ORDER BY k) AS rules, array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences
  FROM runs JOIN rules USING (form) GROUP BY r)
SELECT doc_id, coalesce(rtrim(replace(seq, 'L', ''), ','), '') AS identifiers, coalesce(rules, '') AS rules,
       coalesce(licences, '') AS licences, rules IS NOT NULL AS licensed
FROM rows LEFT JOIN found USING (r) LEFT JOIN named USING (r)
"""


ORACLE_SQL = _sql()
