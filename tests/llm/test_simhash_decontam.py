import random
import re

import numpy as np
import pytest
import xxhash

from collatio.llm import common as C
from collatio.llm import decontam as D
from collatio.llm import simhash as S
from collatio.llm.common import retain


def fingerprint(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def families(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(rng.choice([" ", "\t", " \n"]).join(copy))
    rows += [None, "", "  \n", "One", "one", "one two", "\u00a0", "\u3000x"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,split,hot", [(1, S.SPLIT, 1000), (2, 3, 30)])
def test_near_duplicates(spark, seed, split, hot, monkeypatch):
    monkeypatch.setattr(S.links, "__defaults__", (None, split))
    monkeypatch.setattr(C, "HOT_PARTS", hot)
    monkeypatch.setattr(S, "HELD_BYTES", 64 * split)
    texts = families(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[4], 1)], "doc_id long, text string, rep int")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    fps = [fingerprint(t, 3) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = {(i, f"{fps[i]:016x}", find(i)) for i in range(len(texts))} | {(None, f"{fps[4]:016x}", find(4))}
    assert got == want
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_close_pairs_and_cells():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, 1), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (1500, 1)).astype(np.uint64)
    a = base[rng.integers(0, 40, 1500)] ^ flips
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i, 0] ^ a[j, 0]).bit_count() <= 2}
    got = {(min(i, j), max(i, j)) for x, y in S.close_pairs(a, None, 2) for i, j in zip(x.tolist(), y.tolist())}
    assert got == want
    both = {(i, j) for x, y in S.close_pairs(a[:700], a[700:], 2) for i, j in zip(x.tolist(), y.tolist())}
    assert both == {(i, j - 700) for i, j in want if i < 700 <= j}
    many = (base[rng.integers(0, 40, 20_000)] ^ (np.uint64(1) << rng.integers(0, 64, (20_000, 1)).astype(np.uint64)))
    low, high = S._bounds(S.popcounts(many, 8)[np.lexsort(S.popcounts(many, 8).T[::-1])])
    apart = np.maximum(0, np.maximum(low[None] - high[:, None], low[:, None] - high[None])).sum(axis=2)
    assert (apart > 2).mean() > 0.3  # tiles are skipped
    assert not list(S.close_pairs(a[:0], None, 2)) and not list(S.close_pairs(a, a[:0], 2))
    steps = S._half_ball(4, 2)
    assert len(steps) == len(set(steps)) == 20


def test_near_copies_stage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, groups = [], []
    for g in range(30):
        base = [word() for _ in range(200)]
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(200)] = word()
            groups.append(g)
            rows.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(1000, "", "x"), (1001, " ", "x"), (None, None, "x")], "doc_id long, text string, fp string")
    kept = retain(docs, S.kept_keys(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [3 * g for g in range(30)] + [1000]
    assert kept.columns == docs.columns


@pytest.mark.parametrize("split", [S.SPLIT_SETS, 3, 20])
def test_near_copies_by_exact_similarity(spark, split, monkeypatch):
    """Fingerprints of texts at 0.6 to 0.8 are close, but only 0.8 links."""
    monkeypatch.setattr(S, "SPLIT_SETS", split)
    monkeypatch.setattr(S, "HELD_BYTES", split)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = ["", None, "one", "One", "one two"]
    for g in range(25):
        base = [word() for _ in range(rng.choice([8, 9, 60, 150, 300]))]
        for k in range(6):
            copy = list(base)
            for at in range(2, len(base), 150):
                for _ in range(k if len(base) > 9 else 1):
                    copy[rng.randrange(at, min(at + 150, len(base)))] = word()
            rows.append(" ".join(copy if k % 2 else copy[: len(base) - k // 2]))
    sets = []
    for t in rows:
        words = (t or "").lower().split()
        sets.append({" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    below = 0
    for a in range(len(rows)):
        for b in range(a):
            shared, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not every or shared / every >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
            below += 0.6 < shared / max(1, every) < 0.8
    assert below > 30
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").union(spark.createDataFrame([(5, rows[5])], "doc_id long, text string"))
    kept = sorted(r.doc_id for r in retain(docs, S.kept_keys(docs)).collect())
    assert kept == [i for i in range(len(rows)) if find(i) == i]


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_decontamination_against_plain_alignment():
    rng = random.Random(5)
    letters = "abcde fghij klm"
    hits = 0
    for _ in range(150):
        items = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([5, 20, 60, 120])))) for i in range(3)]
        text = [rng.choice(letters) for _ in range(rng.choice([0, 30, 300]))]
        if rng.random() < 0.8:
            p = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(p) // 8))):
                k, what = rng.randrange(len(p) + 1), rng.random()
                if what < 0.33 and p:
                    p[min(k, len(p) - 1)] = rng.choice(letters)
                elif what < 0.66:
                    p.insert(k, rng.choice(letters))
                elif k < len(p):
                    p.pop(k)
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        text = "".join(text)
        got = list(D.Index(items).search_all(["x" * 9, text, None]))[1]
        flat, want = D.normal(text), {}
        for i, p in items:
            p = D.normal(p)
            k = min(int(D.ERROR_RATE * len(p)), len(p) // D.Q - 1) if len(p) >= D.Q else 0
            if p and edits(p, flat) <= k:
                want[i] = edits(p, flat)
        hits += len(want)
        assert {r[0]: r[1] for r in got} == want
        for i, e, start, stop in got:
            assert edits(D.normal(dict(items)[i]), flat[start:stop]) == e
    assert hits > 50


def test_decontamination_of_repeated_grams(monkeypatch):
    """One letter over and over: hits are taken in pieces, bands joined; the rows do not change."""
    items = [(1, "a" * 100), (2, "a" * 60 + "b" + "a" * 60), (3, "ab" * 40)]
    texts = ["a" * 300_000, "b" + "a" * 119, "x" * 50, "ab" * 30, "a" * 60 + "c" + "a" * 60]
    index = D.Index(items)
    got = list(index.search_all(texts))
    assert [[r[:2] for r in rows] for rows in got] == [[(1, 0), (2, 1)], [(1, 0), (2, 2)], [], [], [(1, 1), (2, 1)]]
    assert len(index.candidates(D.codes(texts[0]))) <= 3
    monkeypatch.setattr(D, "MAX_HITS", 1000)
    monkeypatch.setattr(D, "MAX_WIDTH", 64)
    for text, rows in zip(texts[1:], got[1:]):
        assert index.search(text) == rows


def test_decontamination_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away into the dark forest"
    docs = spark.createDataFrame([(1, "Lead. " + item.upper() + " tail", 0), (2, "nothing here", 0), (3, None, 0), (None, item.replace("fox", "f0x"), 0), (1, "", 0)], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "dog"), (10, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, sorted(m.item_id for m in r.matches)) for r in D.scan(docs, bench).collect()), key=str)
    assert got == sorted([(1, True, [10, 10, 13]), (2, False, []), (3, False, []), (None, True, [10, 10, 13]), (1, False, [])], key=str)
    assert D.clean(docs, bench).count() == 3 and D.clean(docs, bench).columns == docs.columns
    monkeypatch.setattr(D, "BLOCK_CHARS", 40)
    assert sorted(((r.doc_id, r.contaminated, sorted(m.item_id for m in r.matches)) for r in D.scan(docs, bench).collect()), key=str) == got
    assert D.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert D.scan(docs.limit(0), bench).count() == 0


def test_near_copies_meet_by_shingles(spark, monkeypatch):
    """Texts of one size that share nothing are not compared; what shares is, in groups of any size."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [" ".join(word() for _ in range(30)) for _ in range(300)]
    base = [word() for _ in range(60)]
    for _ in range(20):
        rows.append(" ".join(base[:-1] + [word()]))
    met = []
    spread = S.links
    monkeypatch.setattr(S, "SPLIT_SETS", 7)
    monkeypatch.setattr(S, "links", lambda celled, *a, **b: (met.append([r["count"] for r in celled.groupBy("cell").count().collect()]), spread(celled, *a, **b))[1])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in retain(docs, S.kept_keys(docs)).collect()) == list(range(301))
    assert met and max(max(n) for n in met) <= 20


def test_spanning_and_rarest():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, (12, 4), dtype=np.uint64)[rng.integers(0, 12, 200)]
    fps ^= np.uint64(1) << rng.integers(0, 64, (200, 4)).astype(np.uint64)
    sizes = rng.integers(50, 200, 200)
    one, two = S.Forest(200), S.Forest(200)
    for i, j in S.close_pairs(fps, None, 6, (sizes, sizes, 0.8)):
        for x, y in zip(i.tolist(), j.tolist()):
            one.join(x, y)
    got = S.spanning(fps, sizes, 6, 0.8)
    assert all(two.join(x, y) for x, y in got)
    assert [one.find(x) for x in range(200)] == [two.find(x) for x in range(200)]
    counts = rng.integers(0, 50, 1 << S.COUNT_BITS).astype(np.uint32)
    for n in range(1, 120):
        for shared in range(1, n + 1):
            every = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(every[:n]), np.unique(every[n - shared : 2 * n - shared])
            if S.jaccard(a, b) >= 0.8:
                assert set(S.rarest(a, counts, 0.8).tolist()) & set(S.rarest(b, counts, 0.8).tolist())
