import hashlib
import random
import zlib

import pytest

from collatio.llm import exact_dedup as D
from collatio.llm import sharding
from collatio.llm.common import connected_components, retain

SCHEMA = "doc_id long, text string, size int, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(3)


def brute(rows, largest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        first = True
        for i in sorted(ids, key=str):
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("budget", [D.TRIE_BYTES, 1500])
def test_dedup(spark, keep, budget):
    rng = random.Random(1)
    texts = ["", None, "a", "ab", "abc", "abd", "x" * 3000, "x" * 2999 + "y", "é", "e\u0301", " a"]
    rows = [(rng.randint(0, 400), rng.choice(texts) if rng.random() < 0.5 else "p" * rng.randint(0, 30) + str(rng.randint(0, 40))) for _ in range(500)]
    rows += [(None, "a"), (None, "only null"), (None, "only null"), (7, "twice"), (7, "twice"), (3, "twice")]
    found = D.dedup(docs(spark, rows), keep=keep, trie_bytes=budget)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == brute(rows, keep == "largest")
    kept = retain(docs(spark, rows), D.kept_keys(docs(spark, rows), keep=keep))
    assert kept.columns == ["doc_id", "text", "size", "kept"]
    assert kept.count() == len({t or "" for _, t in rows})


def test_dedup_empty(spark):
    assert D.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_spills():
    made = []

    class File:
        def __init__(self):
            self.parts = []
            made.append(self)

        def write(self, raw):
            self.parts.append(raw)

        def read(self):
            import struct

            head = struct.calcsize("<Q?qqq")
            for raw in self.parts:
                size, null, best, n, mine = struct.unpack("<Q?qqq", raw[:head])
                yield raw[head : head + size], (None if null else best, n, mine)

    rng = random.Random(2)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))).encode() for _ in range(3000)]
    trie, want = D.Trie(True, 9000, File), {}
    for i, k in enumerate(keys):
        trie.insert(k, (i, 1, 1))
        want[k] = (i, want.get(k, (0, 0, 0))[1] + 1, 1)
    found = list(trie.items())
    assert len(found) == len(want) and dict(found) == want
    assert len(made) > 1


@pytest.mark.parametrize("n_shards", [1, 4, 40])
def test_shards(spark, n_shards):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "é" * rng.randint(0, 50), "x" * rng.randint(0, 300)])) for i in rng.sample(range(1000), 200)]
    got = sharding.shard_by_bytes(docs(spark, rows), n_shards).collect()
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    total, lead, want = sum(size.values()), 0, {}
    for i in sorted(size):
        want[i] = min(n_shards - 1, (2 * lead + size[i]) * n_shards // (2 * total))
        lead += size[i]
    slots = {}
    for r in sorted(got, key=lambda r: r.doc_id):
        assert (r.size, r.shard, r.law, r.grown_shard) == (size[r.doc_id], want[r.doc_id], "bytes", None)
        assert r.text_crc32 == zlib.crc32((dict(rows)[r.doc_id] or "").encode())
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
    assert len(got) == len(rows)


def test_shards_ties_nulls_empty(spark):
    rows = [(1, "a")] * 50 + [(None, "b")] * 10
    got = sharding.shard_by_bytes(docs(spark, rows), 3).collect()
    assert len(got) == 60
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA), 3).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(120)], "star": [(500, i) for i in range(60)], "random": [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(110)]}[shape]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
