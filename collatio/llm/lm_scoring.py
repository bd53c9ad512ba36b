"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the tokens on both sides of it, itself masked:
the embeddings of the neighbours, one table for each place in the window, are
summed into a hidden layer, and a two-level softmax (class, then token within
the class) gives the conditional probability.  A document's score is the sum
of its tokens' conditional log-probabilities.

Words are counted over all documents; the most frequent are tokens of their
own, the others share hashed tokens.  The probability of a shared token is
divided among its words: a word that occurs once in FREQUENT bytes of the
corpus has a share by its count, and what rarer words have together, with a
reserve of one occurrence, is split evenly among them and one place for words
never seen.  The words with shares are thus at most FREQUENT / 2 at any size.

Texts are cut into tokens once, and kept as token ids in the shared folder.
The network is trained in numpy on every document: rows are dealt by the hash
of id and tokens into shards of about SHARD_BYTES of text, each shard makes one
pass in the order of that hash, and the parameters are averaged.  ROUNDS such
rounds follow each other, the first from the unigram model.  Averages are sums
of whole numbers, so neither the partitions nor their order change the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm.common import coded, cut, narrow

CLASSES, WITHIN = 32, 64
TOKENS = CLASSES * WITHIN
#: Tokens that stand for all words but the most frequent.
SHARED = 256
OWN = TOKENS - SHARED
#: A word that occurs once in so many bytes of text has a share of its own.
FREQUENT = 1 << 24
WINDOW, DIM = 2, 16
RATE, BATCH, SEED, ROUNDS = 0.1, 8192, 11, 2
#: Text of one shard of training, about.
SHARD_BYTES = 4 << 20
#: Tokens scored at once.
SCORE_BATCH = 32768
#: Distinct words that a counting task holds.
COUNTER_WORDS = 300_000
#: Bytes of text taken at once.
SLICE_BYTES = 1 << 23
#: Averages are over parameters in units of this.
_UNIT = 2.0**-24
_CHUNK = 1024


def split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of every word among the distinct ones, distinct words, words in each text)."""
    words = pa.compute.utf8_split_whitespace(pa.compute.utf8_lower(pa.compute.fill_null(texts, "")))
    return coded(words)


def word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64).view(np.int64)


@dataclass
class Vocabulary:
    """Tokens of words and the logs of their shares, by hashes in order.

    rare: the log of the share of any other word of each shared token.
    """

    hashes: np.ndarray
    token: np.ndarray
    log_share: np.ndarray
    rare: np.ndarray
    unigram: np.ndarray

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token, log of its share in that token) of each word."""
        h = word_hashes(words)
        shared = h % SHARED
        if not len(self.hashes):
            return (OWN + shared).astype(np.uint16), self.rare[shared]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.token[at], OWN + shared).astype(np.uint16), np.where(known, self.log_share[at], self.rare[shared])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of all texts, tokens in each text, log of each text's shares)."""
        index, distinct, sizes = split(texts)
        token, share = self.look_up(distinct)
        ends = np.concatenate([[0.0], np.cumsum(share[index], dtype=np.float64)])[np.concatenate([[0], np.cumsum(sizes)])]
        return token[index], sizes, np.diff(ends)


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Vocabulary of all documents' words, ties in counts by the words' hash.

    Null and blank texts have no words; of a table without words all tokens
    are equally likely.
    """

    def count(batches):
        seen: Counter[str] = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(word_hashes(list(seen))), pa.array(list(seen.values()), pa.int64())], names=["hash", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for part in narrow(batch, SLICE_BYTES):
                index, distinct, _ = split(part.column(1))
                for word, n in zip(distinct, np.bincount(index, minlength=len(distinct)).tolist()):
                    if n:
                        seen[word] += n
                if len(seen) > COUNTER_WORDS:
                    yield flush()
        yield flush()

    texts = _texts(docs, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(1, -(-size // FREQUENT))

    def gather(batches):
        """(hash, n, -1) of words with shares; (shared token, sum, kinds) of the others."""
        sums, kinds = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        for batch in batches:
            h, n = (batch.column(k).to_numpy() for k in (0, 1))
            many = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[many]), pa.array(n[many]), pa.array(np.full(int(many.sum()), -1))], names=["hash", "n", "kinds"])
            np.add.at(sums, h[~many] % SHARED, n[~many])
            kinds += np.bincount(h[~many] % SHARED, minlength=SHARED)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED)), pa.array(sums), pa.array(kinds)], names=["hash", "n", "kinds"])

    counts = texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rows = counts.mapInArrow(gather, "hash long, n long, kinds long").toArrow()
    h, n, kinds = (rows[c].to_numpy() for c in ("hash", "n", "kinds"))
    rest, order = kinds >= 0, np.lexsort((h, -n, kinds >= 0))[: int((kinds < 0).sum())]
    rare = np.bincount(h[rest], n[rest], SHARED)
    every_kind = np.bincount(h[rest], kinds[rest], SHARED)
    h, n = h[order], n[order]
    token = np.arange(len(h))
    token[OWN:] = OWN + h[OWN:] % SHARED
    every = rare + np.bincount(token[OWN:] - OWN, n[OWN:], SHARED)
    log_share = np.zeros(len(h), dtype=np.float32)
    log_share[OWN:] = np.log(n[OWN:]) - np.log(every[token[OWN:] - OWN] + 1)
    unigram = np.full(TOKENS, 0.5)
    unigram[: min(OWN, len(n))] += n[:OWN]
    unigram[OWN:] += every
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], token[by_hash].astype(np.uint16), log_share[by_hash], np.log((rare + 1) / (every + 1) / (every_kind + 1)), unigram / unigram.sum())


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.lit(0).alias("none"), F.col(f"`{text_col}`").cast("string").alias("text"))


_PLACES = [o for o in range(-WINDOW, WINDOW + 1) if o]
Weights = dict[str, np.ndarray]


def start_weights(unigram: np.ndarray) -> Weights:
    """The unigram model: biases from counts, small random embeddings."""
    rng = np.random.default_rng(SEED)
    table = unigram.reshape(CLASSES, WITHIN)
    return {
        "embed": rng.normal(0, 0.1, (len(_PLACES), TOKENS + 1, DIM)).astype(np.float32),
        "hidden": np.zeros(DIM, np.float32),
        "class_w": np.zeros((DIM, CLASSES), np.float32),
        "class_b": np.log(table.sum(axis=1)).astype(np.float32),
        "within_w": np.zeros((CLASSES, DIM, WITHIN), np.float32),
        "within_b": (np.log(table) - np.log(table.sum(axis=1, keepdims=True))).astype(np.float32),
    }


def _hidden(w: Weights, ids: np.ndarray) -> np.ndarray:
    """Hidden layer of the places WINDOW.. of ids, padded by WINDOW on both sides."""
    n = len(ids) - 2 * WINDOW
    x = np.take(w["embed"][0], ids[WINDOW + _PLACES[0] : WINDOW + _PLACES[0] + n], axis=0)
    for k, o in enumerate(_PLACES[1:], start=1):
        x += np.take(w["embed"][k], ids[WINDOW + o : WINDOW + o + n], axis=0)
    x += w["hidden"]
    return np.tanh(x, out=x)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of z, in place; sums of its rows); logits are cut at 80."""
    np.exp(np.minimum(z, 80, out=z), out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def _ones(rows: np.ndarray) -> np.ndarray:
    return np.ones(len(rows), rows.dtype)


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by class, (class, first, end) of those that occur)."""
    classes = (targets // WITHIN).astype(np.uint8)  # small integers sort by radix
    order = np.argsort(classes, kind="stable")
    bounds = np.searchsorted(classes[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]


def log_probabilities(w: Weights, ids: np.ndarray) -> np.ndarray:
    """Conditional log-probability of every token of ids, 0 for padding.

    ids begins and ends with WINDOW paddings (TOKENS), and texts are apart by
    as many, so no window reaches into another text.
    """
    out = np.zeros(len(ids), dtype=np.float64)
    for a in range(0, len(ids) - 2 * WINDOW, SCORE_BATCH):
        part = ids[a : a + SCORE_BATCH + 2 * WINDOW]
        n = len(part) - 2 * WINDOW
        middle = part[WINDOW : WINDOW + n]
        real = np.flatnonzero(middle < TOKENS)
        order, classes = _by_class(middle[real])
        real = real[order]
        h, t = _hidden(w, part)[real], middle[real]
        rows = np.arange(len(t))
        z, total = _exp(h @ w["class_w"] + w["class_b"])
        p = z[rows, t // WITHIN] / total
        for c, x, y in classes:
            z, total = _exp(h[x:y] @ w["within_w"][c] + w["within_b"][c])
            p[x:y] *= z[rows[: y - x], t[x:y] % WITHIN] / total
        out[a + WINDOW + real] = np.log(np.maximum(p, 1e-30))
    return out


def gradients(w: Weights, part: np.ndarray) -> tuple[Weights, np.ndarray, int]:
    """(gradients of the mean loss, tokens whose embeddings they are, targets).

    The gradient of the embeddings has a row for each distinct token of part.
    """
    n = len(part) - 2 * WINDOW
    middle = part[WINDOW : WINDOW + n]
    real = np.flatnonzero(middle < TOKENS)
    order, classes = _by_class(middle[real])
    real = real[order]
    every = _hidden(w, part)
    h, t = every[real], middle[real]
    m, rows = max(1, len(t)), np.arange(len(t))
    off, total = _exp(h @ w["class_w"] + w["class_b"])
    off *= (1 / total)[:, None]
    off[rows, t // WITHIN] -= 1
    off *= 1 / m
    g = {"class_w": h.T @ off, "class_b": _ones(off) @ off, "within_w": np.zeros_like(w["within_w"]), "within_b": np.zeros_like(w["within_b"])}
    back = off @ w["class_w"].T
    for c, x, y in classes:
        off, total = _exp(h[x:y] @ w["within_w"][c] + w["within_b"][c])
        off *= (1 / total)[:, None]
        off[rows[: y - x], t[x:y] % WITHIN] -= 1
        off *= 1 / m
        g["within_w"][c], g["within_b"][c] = h[x:y].T @ off, _ones(off) @ off
        back[x:y] += off @ w["within_w"][c].T
    inner = np.zeros_like(every)
    inner[real] = back * (1 - h * h)
    g["hidden"] = _ones(inner) @ inner
    # one order of the tokens serves every place of the window
    order = np.argsort(part.astype(np.uint16), kind="stable")
    held = part[order]
    starts = np.flatnonzero(np.r_[True, np.diff(held) != 0])
    wide = np.zeros((n + 4 * WINDOW, DIM), dtype=inner.dtype)
    wide[2 * WINDOW : 2 * WINDOW + n] = inner
    # the token at position p stands at place o of the target p - o
    g["embed"] = np.stack([np.add.reduceat(np.take(wide, order + (WINDOW - o), axis=0), starts) for o in _PLACES])
    return g, held[starts], len(t)


class Trainer:
    """Steps of BATCH tokens, each parameter's rate by its own past gradients."""

    def __init__(self, weights: Weights):
        self.w = {k: v.copy() for k, v in weights.items()}
        self._past = {k: np.full_like(v, 1e-7) for k, v in weights.items()}
        self.tokens = 0

    def learn(self, ids: np.ndarray) -> None:
        for a in range(0, len(ids) - 2 * WINDOW, BATCH):
            g, rows, n = gradients(self.w, ids[a : a + BATCH + 2 * WINDOW])
            self.tokens += n
            for k, x in g.items():
                at = (slice(None), rows) if k == "embed" else slice(None)
                past = self._past[k][at] + x * x
                self._past[k][at] = past
                self.w[k][at] -= np.float32(RATE) * x / np.sqrt(past)


def padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of texts with WINDOW paddings before, between and behind them."""
    out = np.full(len(flat) + WINDOW * (len(sizes) + 1), TOKENS, dtype=np.int32)
    out[np.arange(len(flat)) + WINDOW * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = flat
    return out


def sums(w: Weights, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the log-probabilities of each text's tokens."""
    found = log_probabilities(w, padded(flat, sizes))
    upto = np.concatenate([[0.0], np.cumsum(found)])
    stops = np.cumsum(sizes + WINDOW) if len(sizes) else sizes
    return upto[stops] - upto[stops - sizes]


@dataclass
class Model:
    """Vocabulary and weights; score() is the whole operator on a few texts."""

    vocabulary: Vocabulary
    weights: Weights

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sums of log-probabilities, token counts)."""
        flat, sizes, share = self.vocabulary.encode(pa.array(texts, pa.string()))
        return sums(self.weights, flat, sizes) + share, sizes


def encode(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int | None = None) -> DataFrame:
    """(id, tokens binary, share, shard, h) in the shared folder, dealt by shard and ordered by h.

    shard and h are functions of id and tokens (and of the corpus' size) alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            for part in narrow(batch, SLICE_BYTES):
                flat, sizes, share = shared.value.encode(part.column(1))
                ends = np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int64)
                tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), tokens, pa.array(share, pa.float64())], names=["id", "tokens", "share"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // (shard_bytes or SHARD_BYTES) + 1
    context = spark.sparkContext
    tasks = min(3 * shards, 4 * max(context.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    coded = slim.mapInArrow(run, f"id {kind}, tokens binary, share double").withColumn("h", F.xxhash64(F.col("id").cast("string"), "tokens"))
    dealt = coded.withColumn("shard", F.pmod("h", F.lit(shards))).repartition(tasks, "shard")
    return cut(dealt.sortWithinPartitions("shard", "h", "id"))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows, tokens of each) of the column tokens."""
    held = batch.column(batch.schema.get_field_index("tokens")).to_pylist()
    sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 2
    flat = np.frombuffer(b"".join(held), dtype="<u2")
    return flat, sizes


def _round(encoded: DataFrame, weights: Weights) -> Weights | None:
    """Average of the shards' weights after a pass each; None if there are no tokens."""
    context = encoded.sparkSession.sparkContext
    shared = context.broadcast(weights)
    names = list(weights)

    def run(batches):
        total, weight, held, now = None, 0, [], None

        def learn():
            nonlocal total, weight, held
            trainer = Trainer(shared.value)
            if held:
                flat, sizes = (np.concatenate(x) for x in zip(*held))
                trainer.learn(padded(flat, sizes))
            held = []
            if trainer.tokens:
                n = 1 + (trainer.tokens >> 12)
                own = np.rint(np.concatenate([trainer.w[k].reshape(-1) for k in names]).astype(np.float64) / _UNIT).astype(np.int64) * n
                total, weight = own if total is None else total + own, weight + n

        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if a == b:
                    continue
                if shard[a] != now:
                    learn()
                    now = shard[a]
                held.append(_tokens(batch.slice(a, b - a)))
        learn()
        if total is None:
            return
        total = np.append(total, weight)
        parts = [total[a : a + _CHUNK] for a in range(0, len(total), _CHUNK)]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "part": pa.array(parts, pa.list_(pa.int64()))})

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = part.values.to_numpy()
                found[k] = found[k] + part if k in found else part.copy()
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(found), pa.int32()), "part": pa.array(list(found.values()), pa.list_(pa.int64()))})

    kind = "chunk int, part array<long>"
    each = encoded.select("shard", "tokens").mapInArrow(run, kind)
    # a model of numbers from each task is summed chunk by chunk; one comes back
    rows = each.repartition("chunk").mapInArrow(add, kind).toArrow()
    if not rows.num_rows:
        return None
    parts = dict(zip(rows["chunk"].to_pylist(), rows["part"].to_pylist()))
    flat = np.concatenate([np.array(parts[k], dtype=np.int64) for k in sorted(parts)])
    mean, a, out = flat[:-1] / flat[-1] * _UNIT, 0, {}
    for k in names:
        n = weights[k].size
        out[k] = mean[a : a + n].reshape(weights[k].shape).astype(np.float32)
        a += n
    return out


def learn(encoded: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after `rounds` averaged passes over what encode() gave."""
    weights = start_weights(words.unigram)
    for _ in range(rounds):
        weights = _round(encoded, weights) or weights
    return weights


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Model of all texts, whatever their partitions and order.

    Null and blank texts teach nothing, repeated rows count each time, null
    ids are learned from like others; of a table without words the model is
    the uniform one.
    """
    words = vocabulary(docs, text_col)
    return Model(words, learn(encode(docs, words, id_col, text_col), words, rounds))


_SCORED = ["id", "n_tokens", "log_likelihood", "mean_log_likelihood"]


def _scored(ids: pa.Array, total: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    mean = pa.array(total / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(total, pa.float64()), mean], names=_SCORED)


def _kind(docs: DataFrame, id_col: str) -> str:
    return f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, log_likelihood double, mean_log_likelihood double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_likelihood) for every row.

    log_likelihood: sum of natural logs over the whole text, 0 for null, empty
    and blank texts, whose mean is null.  Repeated rows are scored alike, null
    ids stay, and an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in narrow(batch, SLICE_BYTES):
                flat, sizes, share = shared.value.vocabulary.encode(part.column(1))
                yield _scored(part.column(0), sums(shared.value.weights, flat, sizes) + share, sizes)

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, _kind(docs, id_col)).withColumnRenamed("id", id_col)


def self_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """score() of docs by the model of the same docs, with their texts cut into tokens once."""
    words = vocabulary(docs, text_col)
    encoded = encode(docs, words, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(learn(encoded, words, rounds))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat, sizes = _tokens(part)
                yield _scored(part.column(0), sums(shared.value, flat, sizes) + part.column(2).to_numpy(), sizes)

    return encoded.select("id", "tokens", "share").mapInArrow(run, _kind(docs, id_col)).withColumnRenamed("id", id_col)
