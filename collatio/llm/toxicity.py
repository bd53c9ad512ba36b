"""Toxicity scores by subword-bag embeddings and a linear softmax.

A text is a bag of subwords: every word between its boundary marks, and the
character n-grams of the marked word.  The bag holds those subwords that the
labelled rows tie to toxic texts; their embeddings are averaged and a linear
softmax over the two labels reads the mean.  Embeddings and softmax are trained
jointly, in numpy, by Adam.  A misspelling that was never seen still shares
n-grams with the words it comes from.

The classifier is fitted on at most MAX_TRAIN_ROWS labelled rows, those with
the smallest hash of the id, and MAX_TRAIN_BYTES of their text; near copies
share the weight of one row.  Scoring reads every whole text.  Since the score
depends on a word only through its subwords' logits, a worker keeps each
word's sum and number of subwords.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.llm.common import coded, cut, ragged

#: Bounds of the sample that the classifier is fitted on: rows, and bytes of text.
MAX_TRAIN_ROWS = 6000
MAX_TRAIN_BYTES = 64 << 20
N_GRAMS = (3, 6)
#: A subword enters the bag if so many toxic training texts hold it,
MIN_TOXIC = 5
#: if it is so many times likelier in a toxic text than in another,
MIN_ODDS = 4.0
#: and if the log of these odds lies so many standard errors above 0.
MIN_Z = 3.2
DIM, EPOCHS, RATE, DECAY, SEED = 8, 300, 0.05, 1e-5, 7
THRESHOLD = 0.7
#: Words of which a worker keeps the sums.
TABLE_ENTRIES = 150_000
#: Rows of the sample whose bags are taken at once.
BLOCK_ROWS = 512
#: Texts that are cut into words at once.
SLICE_ROWS = 1000

#: What lies between words.
_BETWEEN = r"[^\p{L}\p{N}_]+"
_SENTENCES = re.compile(r"[.!?\n]+")


def subwords(word: str) -> list[str]:
    """The marked word and its character n-grams."""
    marked = f"<{word}>"
    n = len(marked)
    out = [marked[i : i + k] for k in range(N_GRAMS[0], N_GRAMS[1] + 1) for i in range(n - k + 1)]
    if not N_GRAMS[0] <= n <= N_GRAMS[1]:
        out.append(marked)
    return out


def split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of every word among the distinct ones, distinct words, words in each text)."""
    return coded(pa.compute.split_pattern_regex(pa.compute.utf8_lower(pa.compute.fill_null(texts, "")), _BETWEEN))


@dataclass
class Model:
    """Logits of label 1 over label 0: bias, and one of each subword."""

    bias: float
    logit: dict[str, float]

    def word(self, word: str) -> tuple[float, int]:
        known = [self.logit[s] for s in subwords(word) if s in self.logit]
        return sum(known), len(known)

    def score(self, texts: pa.Array, table: dict[str, tuple[float, int]] | None = None) -> np.ndarray:
        """Score of each text; table keeps the words' sums between calls."""
        index, distinct, sizes = split(texts)
        table = {} if table is None else table
        if len(table) > TABLE_ENTRIES:
            table.clear()
        for w in distinct:
            if w not in table:
                table[w] = self.word(w)
        total, n = (np.array(x, dtype=float) for x in zip(*map(table.__getitem__, distinct))) if distinct else (np.zeros(0), np.zeros(0))
        row = np.repeat(np.arange(len(sizes)), sizes)
        total, n = (np.bincount(row, x[index], len(sizes)) for x in (total, n))
        return 1.0 / (1.0 + np.exp(-(self.bias + total / np.maximum(n, 1))))


def copy_weights(texts: list[str]) -> np.ndarray:
    """Weight of each row: near copies of a text share the weight of one.

    Rows are near copies of each other if two of the four least hashes of
    their sentences agree; of n such rows each weighs 1 / n.
    """
    keys = []
    for text in texts:
        parts = [s.encode("utf-8") for s in _SENTENCES.split(text) if len(s) >= 20] or [text.encode("utf-8")]
        least = [min(zlib.crc32(p, salt) for p in parts) for salt in range(4)]
        keys.append(((0, least[0], least[1]), (1, least[2], least[3])))
    alike = Counter(k for pair in keys for k in pair)
    return np.array([1.0 / max(alike[k] for k in pair) for pair in keys])


class _Bags:
    """Subwords of the words of labelled rows, as numbers.

    Only subwords that toxic rows of weight MIN_TOXIC hold have a number;
    toxic is the weight of the toxic rows that hold each.
    """

    def __init__(self, texts: list[str], labels: np.ndarray, weight: np.ndarray):
        self.index, words, sizes = split(pa.array(texts, pa.string()))
        self.ends = np.cumsum(sizes)
        self.sizes, self.starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        held = np.zeros(len(words), dtype=bool)
        held[self.index[np.repeat(labels > 0, sizes)]] = True
        number: dict[str, int] = {}
        flat = array("i")
        for w in np.flatnonzero(held).tolist():
            self.starts[w] = len(flat)
            flat.extend(number.setdefault(s, len(number)) for s in subwords(words[w]))
            self.sizes[w] = len(flat) - self.starts[w]
        self.flat = np.array(flat, dtype=np.int32)
        toxic = np.zeros(len(number))
        for k in np.flatnonzero(labels > 0).tolist():
            toxic[np.unique(self.row(k, True))] += weight[k]
        often = np.flatnonzero(toxic >= MIN_TOXIC)
        names = list(number)
        self.toxic, self.number = toxic[often], {names[s]: i for i, s in enumerate(often.tolist())}
        del names, number
        self.keep(often, len(toxic))
        flat, n = array("i"), len(self.flat)
        for w in np.flatnonzero(~held).tolist():
            self.starts[w] = n + len(flat)
            flat.extend(self.number[s] for s in subwords(words[w]) if s in self.number)
            self.sizes[w] = n + len(flat) - self.starts[w]
        self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.int32)])

    def row(self, k: int, distinct: bool) -> np.ndarray:
        """Numbers of a row's subwords, from its distinct words or from all."""
        words = self.index[self.ends[k - 1] if k else 0 : self.ends[k]]
        words = np.unique(words) if distinct else words
        return ragged(self.flat, self.starts[words], self.sizes[words])

    def keep(self, chosen: np.ndarray, of: int) -> None:
        """Renumbers the chosen subwords of `of`, and forgets the others."""
        new = np.full(of, -1, dtype=np.int32)
        new[chosen] = np.arange(len(chosen))
        order = np.argsort(self.starts, kind="stable")
        order = order[self.sizes[order] > 0]
        # the words' stretches lie one behind the other in this order
        flat = new[self.flat]
        self.sizes = np.zeros_like(self.sizes)
        if len(order):
            self.sizes[order] = np.add.reduceat(flat >= 0, self.starts[order], dtype=np.int64)
        self.starts[order] = np.cumsum(self.sizes[order]) - self.sizes[order]
        self.flat = flat[flat >= 0]


Parameters = dict[str, np.ndarray]


def gradients(p: Parameters, bag: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, Parameters]:
    """(loss, gradients) of the weighted mean cross-entropy, with decay.

    bag: (row, subword, share), ordered by row; the shares of a row sum to 1,
    rows without any have the bias alone.  y: (rows, 2), a 1 in each row.
    """
    row, column, share = bag
    mean = np.zeros((len(y), p["e"].shape[1]))
    cuts = np.searchsorted(row, np.arange(0, len(y) + BLOCK_ROWS, BLOCK_ROWS)).tolist()
    blocks = [slice(x, z) for x, z in zip(cuts, cuts[1:]) if x < z]
    for k in blocks:
        starts = np.flatnonzero(np.r_[True, np.diff(row[k]) != 0])
        mean[row[k][starts]] = np.add.reduceat(p["e"][column[k]] * share[k, None], starts)
    z = mean @ p["w"] + p["b"]
    z -= z.max(axis=1, keepdims=True)
    log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    total = weight.sum()
    loss = -(weight[:, None] * y * log).sum() / total + 0.5 * DECAY * ((p["e"] ** 2).sum() + (p["w"] ** 2).sum())
    off = weight[:, None] * (np.exp(log) - y) / total
    inner, e = off @ p["w"].T, DECAY * p["e"]
    for k in blocks:
        back = inner[row[k]] * share[k, None]
        for d in range(back.shape[1]):
            e[:, d] += np.bincount(column[k], back[:, d], len(e))
    return loss, {"e": e, "w": mean.T @ off + DECAY * p["w"], "b": off.sum(axis=0)}


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Model of (text, label) rows; without rows or labels of 1 the bias alone."""
    texts, labels = [t or "" for t, _ in rows], np.array([y for _, y in rows], dtype=np.int64)
    weight = copy_weights(texts) if rows else np.zeros(0)
    n1 = float(weight[labels > 0].sum())
    n0 = float(weight.sum()) - n1
    prior = math.log((n1 + 0.5) / (n0 + 0.5))
    if not (labels > 0).any():
        return Model(prior, {})
    bags = _Bags(texts, labels, weight)
    other = np.zeros(len(bags.number))  # weight of the other rows that hold each subword
    for k in np.flatnonzero(labels == 0).tolist():
        other[np.unique(bags.row(k, True))] += weight[k]
    a, c = bags.toxic + 0.5, other + 0.5
    b, d = n1 - bags.toxic + 0.5, n0 - other + 0.5
    odds = np.log(a * d / (b * c))
    tied = (odds >= math.log(MIN_ODDS)) & (odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d) >= MIN_Z)
    chosen = np.flatnonzero(tied)
    if not len(chosen):
        return Model(prior, {})
    names = list(bags.number)
    bags.keep(chosen, len(names))
    parts = []
    for k in range(len(rows)):
        column, n = np.unique(bags.row(k, False), return_counts=True)
        parts.append((np.full(len(column), k), column, n / max(1, n.sum())))
    bag = tuple(np.concatenate(x) for x in zip(*parts))
    del bags, parts
    y = np.eye(2)[labels]
    rng = np.random.default_rng(SEED)
    p = {"e": rng.normal(0, 0.1, (len(chosen), DIM)), "w": rng.normal(0, 0.1, (DIM, 2)), "b": np.zeros(2)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, EPOCHS + 1):
        for k, g in gradients(p, bag, y, weight)[1].items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits = p["e"] @ (p["w"][:, 1] - p["w"][:, 0])
    return Model(float(p["b"][1] - p["b"][0]), {names[s]: float(x) for s, x in zip(chosen.tolist(), logits)})


def is_held_out(id_column: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Model of labelled rows that are not held out, max_rows and max_bytes of text at most.

    Rows with null ids or labels are not learned from; an id labelled several
    times counts once, as toxic if any label is 1; of documents with one id
    the smallest text is learned from.  Rows are taken in the order of the
    hash of their id; one that would exceed max_bytes is passed over.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL")
        .where(~is_held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # max_rows ids at most, and a row for each
    rows = cut(texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    left, chosen = max_bytes, []
    for r in rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("id"), "id").collect():
        if r.n <= left:
            left -= r.n
            chosen.append(r.id)
    taken = set(chosen)
    found = rows.collect() if left >= 0 and len(chosen) == rows.count() else rows.where(F.col("id").isin(chosen)).collect()
    return fit([(r.text, int(r.y > 0)) for r in sorted(found, key=lambda r: r.id) if r.id in taken])


_TABLES: dict[int, dict[str, tuple[float, int]]] = {}


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Score of each text, 0 to 1; null and empty texts get the bias alone."""
    shared = spark.sparkContext.broadcast(model)
    key = zlib.crc32(repr((model.bias, sorted(model.logit.items()))).encode())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        if key not in _TABLES:
            _TABLES.clear()
        table, out = _TABLES.setdefault(key, {}), []
        for a in range(0, len(texts), SLICE_ROWS):
            out.append(model.score(pa.array(texts.iloc[a : a + SLICE_ROWS], pa.string(), from_pandas=True), table))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return score(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    Repeated rows are scored alike; a null id is never held out; an empty
    table gives an empty table.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), score_column(docs.sparkSession, model, F.col(f"`{text_col}`").cast("string")).alias("score"))
    return slim.select(F.col("_id").alias(id_col), is_held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, with a score below the threshold."""
    column = score_column(docs.sparkSession, model, F.col(f"`{text_col}`").cast("string"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), column.alias("_score"))
    return packed.where(F.col("_score") < threshold).select("_row.*")
