import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from collatio.llm import lm_scoring as M
from collatio.llm import toxicity as X

RNG = random.Random(8)
PLAIN = ["".join(RNG.choice("aeioulnst") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words, bad = [rng.choice(PLAIN) for _ in range(rng.randint(5, 120))], rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbix", "Zorkface", "plugwit"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def plain_score(model, text):
    """Score by plain loops over words and their character n-grams."""
    bag = []
    for word in re.findall(r"\w+", (text or "").lower()):
        marked = f"<{word}>"
        grams = {(i, n) for n in range(X.N_GRAMS[0], X.N_GRAMS[1] + 1) for i in range(len(marked) - n + 1)} | {(0, len(marked))}
        bag += [model.logit[marked[i : i + n]] for i, n in grams if marked[i : i + n] in model.logit]
    return 1 / (1 + math.exp(-model.bias - (sum(bag) / len(bag) if bag else 0)))


def test_toxicity_scores_by_plain_loops(spark):
    rows = labelled(300, 7)
    model = X.fit([(t, y) for _, t, y in rows])
    assert model.logit
    texts = [t for _, t, _ in rows[:60]] + [None, "", "...", "Zorkface-GRUMBIX_x \u00e9t\u00e9 \u4e09"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in X.score(docs, model).collect():
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-9


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    row = np.array([0, 0, 0, 1, 3, 3])
    bag = row, np.array([0, 2, 3, 1, 0, 1]), np.array([0.5, 0.25, 0.25, 1, 0.3, 0.7])
    y, weight = np.eye(2)[[1, 0, 1, 0]], np.array([1, 0.5, 1, 0.25])
    p = {"e": rng.normal(0, 1, (5, X.DIM)), "w": rng.normal(0, 1, (X.DIM, 2)), "b": rng.normal(0, 1, 2)}
    g = X.gradients(p, bag, y, weight)[1]
    for name, values in p.items():
        flat = values.reshape(-1)
        for at in range(flat.size):
            was, found = flat[at], []
            for step in (1e-6, -1e-6):
                flat[at] = was + step
                found.append(X.gradients(p, bag, y, weight)[0])
            flat[at] = was
            assert abs((found[0] - found[1]) / 2e-6 - g[name].reshape(-1)[at]) < 1e-6


def test_toxicity_sample_is_weighed_and_bounded(spark):
    """No row is dropped: copies share the weight of one; rows over the bytes are passed over."""
    lines = [f"a sentence with number {i} in it." for i in range(8)]
    text = "\n".join(lines)
    weights = X.copy_weights([text, text, text + " ok", "other words stand here for themselves", ""])
    assert weights.tolist() == [1 / 3] * 3 + [1, 1]
    rows = labelled(120, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "zz " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert X.train(docs, labels, max_bytes=0).logit == {}
    assert X.train(docs, labels, max_bytes=1 << 20).logit == X.train(docs.repartition(7), labels).logit


def test_toxicity_held_out_accuracy(spark):
    rows = labelled(900, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(5000, None, 0.0), (5001, "", 0.0), (None, "a grumbix", 0.0), (5002, "you grumbixes and zorkfaced lot", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = X.train(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert len(got) == 904
    right = [got[i].predicted == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) / len(right) > 0.97
    for i, _, _ in rows[:50]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert got[5000].score == got[5001].score < 0.5
    assert (got[None].predicted, got[None].held_out) == (1, False)
    assert got[5002].predicted == 1  # spellings not in the training rows
    plain = sum(1 for i, t, _ in rows if got[i].score < X.THRESHOLD)
    assert X.reject(docs, model).count() == plain + 2
    assert X.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert X.score(docs, model).first().predicted == 0


def naive(model, text):
    """Sum of conditional log-probabilities by plain loops."""
    w, words = model.weights, (text or "").lower().split()
    ids, shares = model.vocabulary.look_up(words)
    ids, total = [int(x) for x in ids], float(shares.sum())
    for t, target in enumerate(ids):
        x = w["hidden"].astype(float).copy()
        for k, o in enumerate(M._PLACES):
            p = t + o
            x += w["embed"][k][ids[p] if 0 <= p < len(ids) else M.TOKENS]
        h = np.tanh(x)
        c, inner = divmod(target, M.WITHIN)
        a = h @ w["class_w"] + w["class_b"]
        b = h @ w["within_w"][c] + w["within_b"][c]
        total += a[c] - math.log(np.exp(a).sum()) + b[inner] - math.log(np.exp(b).sum())
    return total, len(ids)


def test_lm_scores(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the cat sat", "a dog ran", "one two three"]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, " \n", 1), (None, "the cat", 1), (902, "zebra " * 30_000, 1)], "doc_id long, text string, n_tokens int")
    model = M.train(docs)
    got = {r.doc_id: r for r in M.score(docs, model).collect()}
    assert len(got) == 124
    for i in (0, 1, 2, None):
        total, n = naive(model, "the cat" if i is None else texts[i])
        assert got[i].n_tokens == n
        assert abs(got[i].log_likelihood - total) < 1e-3 * max(1, abs(total))
    assert (got[900].n_tokens, got[900].log_likelihood, got[900].mean_log_likelihood) == (0, 0.0, None)
    assert got[901].n_tokens == 0
    assert got[902].n_tokens == 30_000
    start = M.Model(model.vocabulary, M.start_weights(model.vocabulary.unigram))
    assert model.score(texts)[0].sum() > start.score(texts)[0].sum()  # context helps over counts alone
    assert M.score(docs.limit(0), model).count() == M.self_scores(docs.limit(0)).count() == 0
    assert M.train(docs.where("doc_id IN (900, 901)")).score(["x"])[1].tolist() == [1]


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    """The same model and scores however the rows are dealt, with several shards."""
    monkeypatch.setattr(M, "SHARD_BYTES", 4096)
    rows = [(i if i % 9 else None, t) for i, t, _ in labelled(200, 4)] + [(7, "said twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy("text")
    found = []
    for parts in (1, 4, 13):
        scored = M.self_scores(docs.repartition(parts)).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in scored))
    assert found[0] == found[1] == found[2]
    model = M.train(docs)
    other = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in M.score(docs, model).collect())
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 for x, y in zip(other, found[0], strict=True))


def test_lm_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 200, 40)
    pad = np.full(M.WINDOW, M.TOKENS)
    part = np.concatenate([pad, ids[:25], pad, ids[25:], pad])
    w = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in M.start_weights(np.full(M.TOKENS, 1 / M.TOKENS)).items()}

    def loss():
        found = M.log_probabilities(w, part)
        return -found.sum() / (part < M.TOKENS).sum()

    g, rows, n = M.gradients(w, part)
    assert n == 40
    step = 1e-5
    for name in w:
        whole = np.zeros_like(w[name])
        whole[(slice(None), rows) if name == "embed" else slice(None)] = g[name]
        flat, places = w[name].reshape(-1), np.flatnonzero(np.abs(whole.reshape(-1)) > 1e-6)
        assert len(places)
        for at in [*rng.choice(places, 12), *rng.integers(0, flat.size, 4)]:
            was = flat[at]
            flat[at] = was + step
            up = loss()
            flat[at] = was - step
            down = loss()
            flat[at] = was
            assert abs((up - down) / (2 * step) - whole.reshape(-1)[at]) < 1e-6, name


def test_lm_words_and_shares(spark, monkeypatch):
    """Words as str.split has them; every one has its share of its token, unseen ones come last."""
    for text in (None, "", " ", "a  B\tc\n", " x", "\u3000y\u00a0Z "):
        index, distinct, sizes = M.split(pa.array([text, "q"], pa.string()))
        assert [distinct[i] for i in index] == (text or "").lower().split() + ["q"]
        assert sizes.tolist() == [len((text or "").split()), 1]
    ranked = [f"w{i}" for i in range(M.OWN + 1500)]
    counts = {w: 120 if i < M.OWN else 60 if i < M.OWN + 300 else 25 if i < M.OWN + 600 else 2 for i, w in enumerate(ranked)}
    texts = [" ".join(w for w in ranked if k < counts[w]) for k in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    least = 20
    monkeypatch.setattr(M, "FREQUENT", -(-sum(len(t.encode()) for t in texts) // least))
    vocabulary = M.vocabulary(docs)
    token, share = (dict(zip(ranked, x.tolist())) for x in vocabulary.look_up(ranked))
    assert {w for w in ranked if token[w] < M.OWN} == set(ranked[: M.OWN])
    for bucket in range(M.SHARED):
        mine = [w for w in ranked if token[w] == M.OWN + bucket]
        total = sum(counts[w] for w in mine)
        rare = [w for w in mine if counts[w] < least]
        for w in mine:
            want = counts[w] / (total + 1) if counts[w] >= least else (sum(counts[v] for v in rare) + 1) / (total + 1) / (len(rare) + 1)
            assert abs(math.exp(share[w]) - want) < 1e-5
        unseen = next(x for x in map("zz{}".format, range(10**6)) if vocabulary.look_up([x])[0][0] == M.OWN + bucket)
        assert abs(sum(math.exp(share[w]) for w in mine) + math.exp(vocabulary.look_up([unseen])[1][0]) - 1) < 1e-5
    model = M.Model(vocabulary, M.start_weights(vocabulary.unigram))
    known, often, unseen = (model.score([t])[0][0] for t in ("w1", f"w{M.OWN + 1}", "qxzzyq"))
    assert known > often > unseen


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against plain definitions."""
    import corpus_pipeline as P
    from collatio.llm import decontam

    rows = labelled(240, 2)
    item = " ".join(PLAIN[:40])
    texts = [(i, t) for i, t, _ in rows]
    texts += [(1000 + k, texts[k][1]) for k in range(20)] + [(2000, "x " + item + " y"), (2001, None), (2002, "")]
    long = [" ".join(rng.choice(PLAIN) for _ in range(200)) for rng in map(random.Random, range(5))]
    texts += [(3000 + k, t) for k, t in enumerate(long)] + [(3100 + k, t + " end") for k, t in enumerate(long)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        ids = {r.doc_id for r in out.collect()}
        if name == "toxicity":
            model = X.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            want = {i for i, t in before.items() if plain_score(model, t) < X.THRESHOLD}
        elif name == "exact_dedup":
            want = set({t or "": i for i, t in sorted(before.items())}.values())
        elif name == "simhash_near_dedup":
            sets = {}
            for i, t in before.items():
                words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
                sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
            up = {i: i for i in before}

            def find(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a in before:
                for b in before:
                    if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        p, q = find(a), find(b)
                        up[max(p, q)] = min(p, q)
            want = {find(i) for i in before}
            assert len(want) <= len(before) - 5
        elif name == "benchmark_decontamination":
            want = {i for i, t in before.items() if not decontam.Index([(1, item)]).search(t)}
            assert 2000 in before and 2000 not in want
        else:
            want = set(before)
        assert ids == want, name
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
            before = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == set(before)
