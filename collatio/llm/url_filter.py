"""URL filtering: a blocked Bloom filter before an exact hash join.

A rule (host, path) is listed under its canonical form, host and path joined
(hosts hold no slash and paths start with one, so forms are unambiguous).
Every distinct url proposes the listed forms that could fit it: each suffix of
its host at a label, with each prefix of its path that has the length of some
rule's path.  Proposals are tested against a blocked Bloom filter of the list
(a 512-bit block for each form, one bit in each of its eight words), and only
possible hits leave the workers, to be joined with the list by hash, which
removes the filter's false positives.  Of the rules that fit, the longest form
decides, of equally long ones that with the longer host; where a form is
listed twice, block wins.

The filter is the only thing that is broadcast; its size is BITS_PER_RULE for
each rule up to MAX_FILTER_BYTES, beyond which it passes more false positives
to the join but stays right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm.common import cut, join_counted

BITS_PER_RULE = 16
MAX_FILTER_BYTES = 32 << 20
_BLOCK_WORDS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null or no `://`.

    pages has no columns of these names (judge() takes only what it needs).
    """
    url = F.col(f"`{url_col}`")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return pages.select(
        "*",
        F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def _places(forms: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each form, and its bit in each of the block's words."""
    a = np.array([xxhash.xxh64_intdigest(f, 0) for f in forms], dtype=np.uint64)
    b = np.array([xxhash.xxh64_intdigest(f, 1) for f in forms], dtype=np.uint64)
    block = (a % np.uint64(blocks)).astype(np.int64)
    shifts = (np.arange(_BLOCK_WORDS, dtype=np.uint64) * np.uint64(6))[None, :]
    bits = np.uint64(1) << ((b[:, None] >> shifts) & np.uint64(63))
    return block, bits


class BlockedBloom:
    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, _BLOCK_WORDS)

    @classmethod
    def empty(cls, blocks: int) -> BlockedBloom:
        return cls(np.zeros(blocks * _BLOCK_WORDS, dtype=np.uint64))

    def add(self, forms: list[bytes]) -> None:
        if forms:
            block, bits = _places(forms, len(self.words))
            np.bitwise_or.at(self.words, block, bits)

    def __contains__(self, form: bytes) -> bool:
        return bool(self.test([form])[0])

    def test(self, forms: list[bytes]) -> np.ndarray:
        if not forms:
            return np.zeros(0, dtype=bool)
        block, bits = _places(forms, len(self.words))
        return ((self.words[block] & bits) == bits).all(axis=1)


def build_filter(forms: DataFrame, n_forms: int) -> BlockedBloom:
    """Filter of the column `form`: partial filters are joined word by word.

    Each task sends only words it has set; the driver gets one filter.
    """
    wanted = max(1, n_forms * BITS_PER_RULE // 512 + 1)
    blocks = min(wanted, MAX_FILTER_BYTES // 64)

    def part(batches):
        bloom = BlockedBloom.empty(blocks)
        for batch in batches:
            bloom.add([x.encode("utf-8") for x in batch.column(0).to_pylist()])
        flat = bloom.words.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "word": pa.array(flat[at].view(np.int64), pa.int64())})

    merged = forms.select("form").mapInArrow(part, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toPandas()
    bloom = BlockedBloom.empty(blocks)
    bloom.words.reshape(-1)[merged["at"].to_numpy(dtype=np.int64)] = merged["word"].to_numpy(dtype=np.int64).view(np.uint64)
    return bloom


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    rules: (host, path, verdict), hosts in lower case; a rule fits its host and
    all subdomains if the url's path starts with the rule's.  rule is null and
    the verdict `default` where none fits, as for null urls, urls without
    `://`, and an empty list.  Rows that repeat are judged alike and all
    returned; null ids stay; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    listed = (
        rules.where("host <> ''")
        .select(F.concat("host", F.coalesce("path", F.lit(""))).alias("form"), F.length("host").alias("n_host"), F.size(F.split("host", "[.]")).alias("n_labels"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("form")
        .agg(F.max("n_host").alias("n_host"), F.max("n_labels").alias("n_labels"), F.max(F.length("path")).alias("n_path"), F.max("verdict").alias("verdict"))
    )
    bloom = build_filter(listed, listed.count())
    # one entry for each distinct length of a listed path, not for each rule
    lengths = sorted(r.n_path for r in listed.select("n_path").distinct().collect())
    most = listed.agg(F.max("n_labels")).first()[0] or 0
    shared = spark.sparkContext.broadcast((bloom, lengths))

    def propose(batches):
        bloom, lengths = shared.value
        for batch in batches:
            rows, forms = [], []
            for i, (host, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                # no listed host has more labels, however many the url's has
                labels = host.rsplit(".", most) if most else []
                for k in range(1, min(most, len(labels)) + 1):
                    suffix = ".".join(labels[-k:])
                    for n in lengths:
                        if n > len(path):
                            break
                        rows.append(i)
                        forms.append(suffix + path[:n])
            hit = np.flatnonzero(bloom.test([f.encode("utf-8") for f in forms]))
            at = pa.array([rows[j] for j in hit], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([forms[j] for j in hit], pa.string())], names=["host", "path", "form"])

    parsed = with_host_and_path(pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url")), "_url")
    # hot urls shrink to one row each before the first shuffle
    urls = cut(parsed.groupBy("host", "path").agg(F.count("*").alias("n")))
    hits = cut(urls.where("host <> ''").select("host", "path").mapInArrow(propose, "host string, path string, form string"))
    # many urls may hit one form, and many rows bear one url
    forms = cut(hits.groupBy("form").agg(F.count("*").alias("n")).join(listed.select("form", "n_host", "verdict"), "form"), slim=True)
    decided = (
        join_counted(hits, forms, ["form"], "n")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("form").alias("n"), "n_host", "form", "verdict")).alias("best"))
    )
    joined = join_counted(parsed, cut(urls.join(decided, ["host", "path"], "left")), ["host", "path"], "n", "left")
    return joined.select(
        F.col("_id").alias(id_col), "host", "path",
        F.col("best.form").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query: host, path, verdict.
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

ORACLE_SQL = """
WITH rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT row_number() OVER () AS row, page_id,
         translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM rest)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM parsed LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY row, page_id
"""
