"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, in numpy, by exclusive-or and bit counts,
tile against tile.  A tile holds fingerprints that are alike in a population
signature: the bit counts of parts of the fingerprint.  The Hamming distance of
two fingerprints is at least the summed difference of their part counts, so
tile pairs whose counts differ by more than the radius hold no link and are
never formed.  Equal fingerprints are one class before anything is compared;
a task emits only links that join what it has not joined yet, at most one for
each fingerprint it holds, so a group of near copies never turns into all its
pairs.  Nothing is capped: tiles of a crowded signature are split and every
pair of the splits is compared.

At the radius of near copies bit counts prune nothing, so there fingerprints are
compared only where the texts share one of their rarest shingles, as any two of
the similarity asked for must.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm.common import connected_components, cut, join_counted

#: Shingles hashed at once: bounds what a very long text needs.
CHUNK_SHINGLES = 1 << 18
#: Fingerprints of one side compared at once.
TILE = 512
#: A signature with more fingerprints is split into tiles of about this size.
SPLIT = 65536
#: The same where the shingle sets travel along.
SPLIT_SETS = 1024
#: Bytes of visitors that a task holds before they are compared.
HELD_BYTES = 1 << 25
#: Counters of shingles, by the first bits of their hash, and the slices they travel in.
COUNT_BITS, COUNT_SLICES = 20, 16
#: Shingles of a bucket, on the mean, where texts meet by the shingles they share.
BUCKET = 1 << 19
#: Texts that share a shingle are paired up to this number, and beyond it linked by spanning().
PAIRED = 8
SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in bounded pieces."""
    if not words:
        return
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(starts), CHUNK_SHINGLES):
        pairs = zip(starts[a : a + CHUNK_SHINGLES], stops[a : a + CHUNK_SHINGLES])
        yield np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    found = list(shingle_hashes(words_of(text), width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle_set(), not both empty."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two runs: a merge
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def _widen(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """(n, lanes) words of each hash: itself, then mixes of it (splitmix64)."""
    out = np.empty((len(hashes), lanes), dtype=np.uint64)
    out[:, 0] = hashes
    for k in range(1, lanes):
        z = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(pieces: Iterator[np.ndarray], lanes: int = 1) -> tuple[np.ndarray, int]:
    """(lanes words, number of hashes): a bit is 1 if over half the hashes set it."""
    ones, n = np.zeros(64 * lanes, dtype=np.int64), 0
    for hashes in pieces:
        wide = _widen(hashes, lanes)
        bits = np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(hashes), 8 * lanes), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").astype(np.uint64), n


def fingerprints(docs: DataFrame, width: int, lanes: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, fp array<long>, n_shingles, same) for every row.

    Texts of fewer words than the shingle width give one shingle of the whole
    sequence; null, empty and blank texts give none and a fingerprint of
    zeros.  distinct: every shingle counts once, and same is a hash of the set
    of shingles (otherwise 0); there is a column counts, which is null but in
    rows for shingle_counts() that are no documents.
    """

    def run(batches):
        counts, held, weight = np.zeros(1 << COUNT_BITS if distinct else 0, np.int64), [], 0
        for batch in batches:
            rows, same = [], []
            for text in batch.column(2):
                if distinct:
                    found = shingle_set(text.as_py(), width)
                    pieces = iter([found] if len(found) else [])
                    same.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    held.append(found)
                    weight += len(found)
                    if weight > CHUNK_SHINGLES:
                        counts += _counted(held)
                        held, weight = [], 0
                else:
                    pieces = shingle_hashes(words_of(text.as_py()), width)
                    same.append(0)
                rows.append(fingerprint(pieces, lanes))
            fps = pa.array([fp.view(np.int64) for fp, _ in rows], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), fps, pa.array([n for _, n in rows], pa.int64()), pa.array(np.array(same, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(rows), pa.binary())] * distinct, names=names)
        if held:
            counts += _counted(held)
        if counts.any():
            slices = np.minimum(counts, 255).astype(np.uint8).reshape(COUNT_SLICES, -1)
            none = [pa.nulls(COUNT_SLICES, kind) for kind in (pa.int64(), pa.string(), pa.list_(pa.int64()))]
            of = pa.array(range(COUNT_SLICES), pa.int64())
            yield pa.RecordBatch.from_arrays([*none, of, of, pa.array([zlib.compress(x.tobytes(), 1) for x in slices], pa.binary())], names=names)

    names = ["id", "sha", "fp", "n_shingles", "same"] + ["counts"] * distinct
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    return slim.mapInArrow(run, "id long, sha string, fp array<long>, n_shingles long, same long" + ", counts binary" * distinct)


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    places = (np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
    return np.bincount(places, minlength=1 << COUNT_BITS)


def shingle_counts(counted: DataFrame) -> np.ndarray:
    """About how many rows bear the shingles of each counter; counted: rows of fingerprints() with counts.

    A list of fixed length.  A partition adds 255 to a counter at most: the
    counts only say which shingles to take first, and any order is right.
    """

    def add(batches):
        sums = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at] = sums.get(at, 0) + np.frombuffer(zlib.decompress(packed), np.uint8).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["at", "counts"])

    out = np.zeros((COUNT_SLICES, (1 << COUNT_BITS) // COUNT_SLICES), np.uint32)
    for row in counted.select(F.col("n_shingles").alias("at"), "counts").repartition("at").mapInArrow(add, "at long, counts binary").collect():
        out[row.at] += np.frombuffer(row.counts, np.uint32)
    return out.ravel()


def rarest(found: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, by count, then hash: two sets whose Jaccard
    similarity is at least `least` have one of them in common.

    They share at least least * n of the n shingles of either, so at most
    n - least * n of a set come before the first that is shared.
    """
    n = len(found)
    order = np.argsort(counts[(found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")
    return found[order[: n - math.ceil(least * n - 1e-9 * n) + 1]]


def popcounts(fps: np.ndarray, parts: int) -> np.ndarray:
    """(n, parts) bit counts of equal parts of each fingerprint (n, lanes)."""
    counts = np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), parts, -1))
    return counts.sum(axis=2, dtype=np.int16)


class Forest:
    """Union-find; join() tells whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(fps: np.ndarray, sizes: np.ndarray, radius: int, least_ratio: float) -> list[tuple[int, int]]:
    """Links, at most one a row, that connect all rows linked by radius and quotient.

    One row at a time is compared with those not joined to it.  Of two rows in
    different components one is outside the largest, so that one needs no
    comparisons of its own, and a group of near copies costs its rows, not
    their pairs.
    """
    n = len(fps)
    label, count = np.arange(n), np.ones(n, np.int64)
    waiting, out, x = np.ones(n, bool), [], 0
    while True:
        waiting[x] = False
        other = np.flatnonzero(waiting & (label != label[x]))
        if len(other):
            distance = np.bitwise_count(fps[other] ^ fps[x]).sum(axis=1, dtype=np.int64)
            fit = np.minimum(sizes[other], sizes[x]) >= least_ratio * np.maximum(sizes[other], sizes[x])
            for y in other[(distance <= radius) & fit].tolist():
                here, there = label[x], label[y]
                if here != there:
                    out.append((x, y))
                    if count[there] == 1:
                        label[y] = here
                    else:
                        label[label == there] = here
                    count[here] += count[there]
                    count[there] = 0
        rest = np.flatnonzero(waiting & (label != np.argmax(count)))
        if not len(rest):
            return out
        x = int(rest[0])


def _bounds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest count of every part in each tile of TILE rows."""
    starts = np.arange(0, len(counts), TILE)
    return np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int, ratio: tuple[np.ndarray, np.ndarray, float] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) at most radius apart, tile by tile.

    a, b: (n, lanes) words; b None: pairs i < j inside a.  Rows are taken in
    the order of the bit counts of their eight parts, and a pair of tiles is
    skipped if those counts, as intervals, lie further apart in sum than the
    radius.  ratio: (sizes of a, sizes of b, least quotient).
    """
    if not len(a) or b is not None and not len(b):
        return
    inside = b is None
    b = a if inside else b
    ca = popcounts(a, 8)
    cb = ca if inside else popcounts(b, 8)
    oa = np.lexsort(ca.T[::-1])
    ob = oa if inside else np.lexsort(cb.T[::-1])
    low_a, high_a = _bounds(ca[oa])
    low_b, high_b = _bounds(cb[ob])
    for k, x in enumerate(range(0, len(oa), TILE)):
        ia = oa[x : x + TILE]
        apart = np.maximum(0, np.maximum(low_b - high_a[k], low_a[k] - high_b)).sum(axis=1)
        near = np.flatnonzero(apart <= radius)
        for y in near[near >= k].tolist() if inside else near.tolist():
            ib = ob[y * TILE : (y + 1) * TILE]
            distance = np.zeros((len(ia), len(ib)), dtype=np.uint16)
            for lane in range(a.shape[1]):
                distance += np.bitwise_count(a[ia, lane][:, None] ^ b[ib, lane][None, :])
            i, j = np.nonzero(distance <= radius)
            if inside and y == k:
                i, j = i[j > i], j[j > i]
            i, j = ia[i], ib[j]
            if ratio is not None and len(i):
                na, nb = ratio[0][i], ratio[1][j]
                fit = np.minimum(na, nb) >= ratio[2] * np.maximum(na, nb)
                i, j = i[fit], j[fit]
            if len(i):
                yield i, j


def _half_ball(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Count differences that the radius allows, one of each pair d, -d; without 0."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        out = [(*d, x) for d in out for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in out if d > (0,) * parts]


def _cells_by_counts(classes: DataFrame, parts: int, radius: int) -> tuple[DataFrame, list[int]]:
    """Adds the column cell; the steps from a cell to the cells it must meet."""
    base = 64 // parts + 1 + 2 * radius  # no step runs into another part's digit
    mask = (1 << (64 // parts)) - 1
    cell = F.lit(0)
    for k in range(parts):
        part = F.shiftrightunsigned(F.col("fp")[0], k * (64 // parts)).bitwiseAND(F.lit(mask))
        cell = cell * base + F.bit_count(part)
    steps = []
    for d in _half_ball(parts, radius):
        step = 0
        for x in d:
            step = step * base + x
        steps.append(step)
    return classes.withColumn("cell", cell.cast("int")), steps


def links(celled: DataFrame, steps: list[int], lanes: int, radius: int, least_ratio: float | None = None, split: int = SPLIT, *, confirm: float | None = None) -> DataFrame:
    """(a, b): ids of linked classes, enough to connect all that link.

    celled: (rep long, fp, size, cell int), one row per class; classes link
    only if their cells are equal or a step apart.  Every class is host in its
    own cell and guest in those a step away.  The number of cells is bounded by
    the signature, so their counts are broadcast; a crowded cell's hosts are
    dealt into blocks, and every block meets every other once, and all guests.
    Without steps there may be any number of cells; only the counts of crowded
    ones are broadcast.
    rep and fp are never null (a null text has a fingerprint); repeated rows of
    one rep only repeat work; an empty table gives an empty table.
    confirm: classes close by fingerprint link only if the Jaccard similarity
    of their sets (another column, grams binary) is at least this; it is worked
    out only for those not yet joined by links that held.
    """
    whole = ["rep", "fp", "size"] + (["grams"] if confirm is not None else [])
    counts = celled.groupBy("cell").agg(F.ceil(F.count("*") / split).cast("int").alias("blocks"))
    counts = F.broadcast(counts if steps else counts.where("blocks > 1"))
    counted = celled.join(counts, "cell", "inner" if steps else "left").fillna(1, ["blocks"])
    hosts = counted.select(*whole, "cell", F.pmod(F.hash("rep"), F.col("blocks")).alias("at"), "blocks")
    # a host of block k leads its own block and visits half of the others, so
    # that every two blocks meet once and all blocks have as many visitors
    half = F.floor((F.col("blocks") - 1) / 2) + ((F.col("blocks") % 2 == 0) & (F.col("at") < F.col("blocks") / 2)).cast("int")
    others = F.when(half >= 1, F.transform(F.sequence(F.lit(1), half.cast("int")), lambda d: (F.col("at") + d) % F.col("blocks"))).otherwise(F.array().cast("array<int>"))
    own = hosts.select(*whole, "cell", F.posexplode(F.concat(F.array("at"), others)).alias("role", "block"))
    own = own.select(*whole, "cell", "block", F.least("role", F.lit(1)).alias("role"))
    parts = own
    if steps:
        moved = celled.select(*whole, F.explode(F.array(*[F.col("cell") + s for s in steps])).alias("cell"))
        guests = moved.join(counts, "cell").select(*whole, "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"))
        parts = own.unionByName(guests)

    def meet(batches):
        """Rows arrive sorted by (cell, block, role): the hosts, then the visitors."""

        class Block:
            """Hosts, linked once; visitors come in parts and are let go."""

            def __init__(self, hosts):
                self.hosts, self.forest, self.edges = hosts, Forest(len(hosts[0])), []
                self.rep, self.sets = hosts[0], self._sets(hosts)
                for i, j in close_pairs(hosts[1], None, radius, least_ratio and (hosts[2], hosts[2], least_ratio)):
                    self._link(i, j)

            def _sets(self, rows):
                return [np.frombuffer(g, dtype=np.uint64) for g in rows[3]] if confirm is not None else []

            def visit(self, rows):
                own, sets, n = self.hosts, self.sets, len(self.hosts[0])
                self.rep, self.sets = np.concatenate([own[0], rows[0]]), sets + self._sets(rows)
                self.forest.up += range(n, n + len(rows[0]))
                for i, j in close_pairs(own[1], rows[1], radius, least_ratio and (own[2], rows[2], least_ratio)):
                    self._link(i, n + j)
                # the smaller place leads: no host's way up leads through a visitor
                del self.forest.up[n:]
                self.rep, self.sets = own[0], sets

            def _link(self, i, j):
                places, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = np.fromiter(map(self.forest.find, places.tolist()), dtype=np.int64, count=len(places))[at]
                apart = root[: len(i)] != root[len(i) :]
                for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                    if confirm is not None and (self.forest.find(x) == self.forest.find(y) or jaccard(self.sets[x], self.sets[y]) < confirm):
                        continue
                    if self.forest.join(x, y):
                        self.edges.append((self.rep[x], self.rep[y]))

            def found(self):
                if self.edges:
                    a, b = zip(*self.edges)
                    self.edges = []
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def columns(rows):
            if not rows:
                return np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
            return tuple(np.concatenate(c) for c in zip(*rows))

        key, block_now, held, weight = None, None, [], 0

        def settle():
            """Compares what is held: hosts if the block has none yet, then visitors."""
            nonlocal block_now, held, weight
            if held and block_now is None:
                block_now = Block(columns(held))
            elif held:
                block_now.visit(columns(held))
            held, weight = [], 0
            if block_now is not None:
                yield from block_now.found()

        was = None
        for batch in batches:
            rep, size, cell, block, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "size", "cell", "block", "role"))
            grams = batch.column("grams").to_numpy(zero_copy_only=False) if confirm is not None else rep
            fp = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            if not len(rep):
                continue
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(rep)]):
                if (cell[s], block[s], role[s]) != was:
                    yield from settle()
                    was = (cell[s], block[s], role[s])
                    if was[:2] != key:
                        key, block_now = was[:2], None
                if role[s] == 1 and block_now is None:
                    continue  # a block without hosts
                held.append((rep[s:e], fp[s:e], size[s:e], grams[s:e]))
                weight += 8 * int(size[s:e].sum()) if confirm is not None else 64 * int(e - s)
                if role[s] == 1 and weight > HELD_BYTES:
                    yield from settle()
        yield from settle()

    dealt = parts.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    return dealt.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, parts: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row, by 64-bit fingerprints.

    Rows link if their fingerprints differ in at most radius bits; the
    component id is the smallest id reachable.  Null, empty and blank texts
    have the fingerprint zero, linked like any other; repeated rows are in one
    class and all returned; a null id gives way to any other, and a component
    of null ids alone has a null id; an empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, width, 1, False, id_col, text_col).select("id", "fp"))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # the first word itself names a class
    named = cut(classes.select(F.col("fp")[0].alias("rep"), "fp", F.lit(0).cast("long").alias("size"), "least", "n"), slim=True)
    celled, steps = _cells_by_counts(named.drop("least", "n"), parts, radius)
    edges = cut(links(celled, steps, 1, radius), slim=True)
    roots = connected_components(edges)
    linked = named.join(roots, named.rep == roots.node).select("rep", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    grouped = linked.join(smallest, "root").select("rep", "component")
    each = cut(named.select("rep", "least", "n").join(grouped, "rep", "left").select("rep", F.coalesce("component", "least").alias("component"), "n"), slim=True)
    # a third of all rows may be copies of one text
    joined = join_counted(prints.select("id", F.col("fp")[0].alias("rep")), each, ["rep"], "n")
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("rep"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Near copies: at least this Jaccard similarity of the sets of shingles of
NEAR, NEAR_WIDTH = 0.8, 5
#: words; candidates by fingerprints of 256 bits: sets that similar are expected
#: to differ in 39 bits (standard deviation 6), unrelated ones in 128 (8).
NEAR_LANES, NEAR_RADIUS = 4, 52
#: Candidates: five deviations more than expected, four for sets of 4 and 5.
NEAR_REACH = 72


def near_groups(docs: DataFrame, width: int = NEAR_WIDTH, lanes: int = NEAR_LANES, radius: int = NEAR_REACH, least_ratio: float = NEAR, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Near copies by exact similarity of shingle sets: (classes, members).

    A class is a set of shingles.  Two classes are candidates if their wide
    fingerprints differ in at most radius bits and their sizes have a quotient
    of at least least_ratio (which the similarity implies); they link if the
    Jaccard similarity of the sets is at least least_ratio.  Fingerprints are
    compared where classes share one of their rarest() shingles (which the
    similarity implies too), and then all with all inside a component of
    candidates, where links are confirmed on the sets.  Sets are kept only of
    classes that have a candidate.
    classes: (rep, root, best), best being the row of the class with the
    smallest id, then text hash; members: (id, sha, rep), with copies.
    Null, empty and blank texts are one class; null ids come last.
    """
    prints = cut(fingerprints(docs, width, lanes, True, id_col, text_col))
    members = prints.where("counts IS NULL").groupBy("id", "sha", "fp", "n_shingles", "same").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha", "n")).alias("best")
    classes = cut(members.groupBy("fp", "n_shingles", "same").agg(best).withColumn("rep", F.monotonically_increasing_id()), slim=True)
    named = classes.select("rep", "fp", F.col("n_shingles").alias("size"), "same")
    counts = shingle_counts(prints.where("counts IS NOT NULL"))
    first = members.agg(F.sum(F.ceil(F.col("n_shingles") * (1 - least_ratio)) + 1)).first()[0] or 0
    found = _sharing(docs, counts, max(4 * docs.sparkSession.sparkContext.defaultParallelism, first // BUCKET), width, least_ratio, text_col)
    near = connected_components(_candidates(found, named, lanes, radius, least_ratio))
    celled = classes.join(near, classes.rep == near.node).select("rep", "fp", F.col("n_shingles").alias("size"), F.col("root").alias("cell"), "best")
    crowded = near.groupBy(F.col("root").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_SETS).select("cell")
    close = _with_sets(docs, celled, width, id_col, text_col)
    if crowded.isEmpty():
        roots = _confirmed(close, lanes, radius, least_ratio)
    else:
        close, crowded = cut(close), F.broadcast(cut(crowded, slim=True))
        roots = _confirmed(close.join(crowded, "cell", "left_anti"), lanes, radius, least_ratio)
        edges = cut(links(close.join(crowded, "cell", "left_semi"), [], lanes, radius, least_ratio, SPLIT_SETS, confirm=least_ratio), slim=True)
        roots = roots.unionByName(connected_components(edges))
    rooted = classes.join(roots, classes.rep == roots.node, "left")
    return rooted.select("rep", "fp", "n_shingles", F.coalesce("root", "rep").alias("root"), "best"), members


def _sharing(docs: DataFrame, counts: np.ndarray, buckets: int, width: int, least_ratio: float, text_col: str) -> DataFrame:
    """(token, a, b): sets, named by their hash, with a shingle in common among their rarest.

    Up to PAIRED sets that share one are paired: token null, a and b sets.  Of
    more there is a row for each: a the set, token what they share, b null.
    Shingles go by bucket and half their hash; that two fall together only adds
    candidates.
    """
    order = docs.sparkSession.sparkContext.broadcast(counts)

    def deal(batches):
        firsts, names, weight = [], [], 0

        def dealt():
            tokens = np.concatenate(firsts)
            owner = np.repeat(np.array(names, np.uint64), [len(x) for x in firsts])
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = (tokens[by] >> np.uint64(32)).astype(np.uint32), owner[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]
            columns = [[x[s:e].tobytes() for s, e in zip(starts, ends)] for x in (tokens, owner)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "tokens", "owners"])

        for batch in batches:
            for text in batch.column(0):
                found = shingle_set(text.as_py(), width)
                if len(found):
                    firsts.append(rarest(found, order.value, least_ratio))
                    names.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    weight += len(firsts[-1])
                    if weight > 2 * BUCKET:
                        yield dealt()
                        firsts, names, weight = [], [], 0
        if firsts:
            yield dealt()

    def paired(bucket, tokens, owner):
        by = np.lexsort((owner, tokens))
        tokens, owner = tokens[by], owner[by]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])  # copies bear one set
        tokens, owner = tokens[fresh], owner[fresh]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.append(starts, len(tokens)))
        shared = np.repeat(sizes, sizes)
        pairs = []
        few = (shared > 1) & (shared <= PAIRED)
        t, o = tokens[few], owner[few]
        for k in range(1, PAIRED):
            at = np.flatnonzero(t[k:] == t[:-k])
            pairs.append(np.column_stack([o[at], o[at + k]]))
        pairs = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
        many = shared > PAIRED
        token = (np.uint64(bucket) << np.uint64(32) | tokens[many].astype(np.uint64)).view(np.int64)
        for columns in ((pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])), (pa.array(token), pa.array(owner[many].view(np.int64)), pa.nulls(len(token), pa.int64()))):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(list(columns), names=["token", "a", "b"])

    def meet(batches):
        """Rows arrive sorted by bucket."""
        now, held = None, []
        for batch in batches:
            for bucket, tokens, owner in zip(*(c.to_pylist() for c in batch.columns)):
                if held and bucket != now:
                    yield from paired(now, *map(np.concatenate, zip(*held)))
                    held = []
                now = bucket
                held.append((np.frombuffer(tokens, np.uint32), np.frombuffer(owner, np.uint64)))
        if held:
            yield from paired(now, *map(np.concatenate, zip(*held)))

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    dealt_out = texts.mapInArrow(deal, "bucket int, tokens binary, owners binary").repartition(buckets, "bucket")
    return cut(dealt_out.sortWithinPartitions("bucket").mapInArrow(meet, "token long, a long, b long"))


def _candidates(found: DataFrame, named: DataFrame, lanes: int, radius: int, least_ratio: float) -> DataFrame:
    """(a, b): classes whose fingerprints and sizes are close, enough to connect all such among those that found (of _sharing) brings together.

    named: (rep, fp, size, same).  A shingle shared by more than SPLIT classes
    is a cell of links(), which has blocks for them; others are held whole.
    """
    one, two = (named.select(*(F.col(c).alias(f"{c}_{x}") for c in named.columns)) for x in "ab")
    pairs = found.where("token IS NULL").select("a", "b").distinct()
    pairs = pairs.join(one, F.col("a") == F.col("same_a")).join(two, F.col("b") == F.col("same_b"))
    distance = sum((F.bit_count(F.col("fp_a")[k].bitwiseXOR(F.col("fp_b")[k])) for k in range(lanes)), F.lit(0))
    alike = F.least("size_a", "size_b") >= least_ratio * F.greatest("size_a", "size_b")
    edges = pairs.where((distance <= radius) & alike).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    def meet(batches):
        """Rows arrive sorted by cell."""

        def joined():
            rep, fps, size = (np.concatenate(c) for c in zip(*held))
            ends = np.array(spanning(fps, size, radius, least_ratio), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rep[ends[:, 0]]), pa.array(rep[ends[:, 1]])], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            rep, size, cell = (batch.column(c).to_numpy() for c in ("rep", "size", "cell"))
            fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
            cuts = (np.flatnonzero(np.diff(cell)) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(cell)] if len(cell) else []):
                if held and cell[s] != now:
                    yield joined()
                    held = []
                now = cell[s]
                held.append((rep[s:e], fp[s:e], size[s:e]))
        if held:
            yield joined()

    many = found.where("token IS NOT NULL").select(F.col("token").alias("cell"), "a")
    crowded = many.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("cell")
    celled = many.join(named, F.col("a") == F.col("same")).select("rep", "fp", "size", "cell")
    if not crowded.isEmpty():
        crowded = F.broadcast(cut(crowded, slim=True))
        edges = edges.union(links(celled.join(crowded, "cell", "left_semi"), [], lanes, radius, least_ratio))
        celled = celled.join(crowded, "cell", "left_anti").select("rep", "fp", "size", "cell")
    edges = edges.union(celled.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long"))
    return edges


def _confirmed(close: DataFrame, lanes: int, radius: int, least_ratio: float) -> DataFrame:
    """(node, root) of the classes of each cell that link, as links() with confirm; every cell is held whole."""

    def meet(batches):
        """Rows arrive sorted by cell."""

        def joined():
            rep, fps, size, grams = (np.concatenate(c) for c in zip(*held))
            sets, forest = [np.frombuffer(g, np.uint64) for g in grams], Forest(len(rep))
            for i, j in close_pairs(fps, None, radius, (size, size, least_ratio)):
                for x, y in zip(i.tolist(), j.tolist()):
                    if forest.find(x) != forest.find(y) and jaccard(sets[x], sets[y]) >= least_ratio:
                        forest.join(x, y)
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rep[[forest.find(x) for x in range(len(rep))]])], names=["node", "root"])

        now, held = None, []
        for batch in batches:
            rep, size, cell = (batch.column(c).to_numpy() for c in ("rep", "size", "cell"))
            fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
            grams = batch.column("grams").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(np.diff(cell)) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(cell)] if len(cell) else []):
                if held and cell[s] != now:
                    yield joined()
                    held = []
                now = cell[s]
                held.append((rep[s:e], fp[s:e], size[s:e], grams[s:e]))
        if held:
            yield joined()

    rows = close.select("rep", "fp", "size", "cell", "grams").repartition("cell").sortWithinPartitions("cell")
    return cut(rows.mapInArrow(meet, "node long, root long"), slim=True)


def _with_sets(docs: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, fp, size, cell) with the column grams, the shingle set of the row best."""

    def run(batches):
        for batch in batches:
            grams = pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "fp", "size", "cell")), grams], names=["rep", "fp", "size", "cell", "grams"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.sha2(text, 256).alias("_sha"), text.alias("text"))
    named = texts.join(classes, (F.col("_sha") == F.col("best.sha")) & F.col("_id").eqNullSafe(F.col("best.id")))
    # rows repeated in full bear one class
    single = named.groupBy("rep").agg(F.first(F.struct("text", "fp", "size", "cell")).alias("row")).select("rep", "row.*")
    return single.mapInArrow(run, "rep long, fp array<long>, size long, cell long, grams binary")


def kept_keys(docs: DataFrame, **options) -> DataFrame:
    """(id, sha, n) of the row that stays of every group, for common.retain.

    The smallest id stays, a null one only where there is no other, of equal
    ids the text of the smallest hash; null, empty and blank texts are one
    group; n counts rows repeated in full; an empty table gives an empty table.
    """
    classes, _ = near_groups(docs, **options)
    stays = classes.groupBy("root").agg(F.min("best").alias("best"))
    return stays.select("best.id", "best.sha", "best.n")
