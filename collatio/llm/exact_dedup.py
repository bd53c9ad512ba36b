"""Exact deduplication with compressed radix tries.

Rows are combined within each input partition, dealt out by (length, content
hash), and the full byte strings of a partition are inserted into a radix trie
whose terminal nodes hold the identifier that stays and the counts.  Equality
is thus decided by bytes, never by hashes.  Documents find their group again
by (length, xxhash64, sha-256); texts that share all three lie in the same
partition, so the trie sees it if that triple ever names two texts, and fails
rather than merging them.

A trie over its budget writes its heaviest subtree to the shared folder and
sends later strings below it there; those files are worked off afterwards,
each with a trie of its own.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm.common import cut, join_counted, narrow, open_fs, shared_dir

#: Bytes that the trie of one task may hold before it spills.
TRIE_BYTES = 64 << 20
#: Bytes of text that a task combines before shuffling.
COMBINE_BYTES = 16 << 20
#: Bytes of text taken at once.
SLICE_BYTES = 4 << 20
#: Bytes that a spilled subtree collects before they go to the shared folder.
SEGMENT_BYTES = 1 << 20
_NODE_BYTES = 300
_BATCH_ROWS = 4096

#: What a terminal holds: (identifier that stays, rows, rows that bear it).
Held = tuple[int | None, int, int]


def merge(a: Held, b: Held, largest: bool) -> Held:
    """Joint state; a null identifier gives way to any other."""
    rows = a[1] + b[1]
    if a[0] == b[0]:
        return a[0], rows, a[2] + b[2]
    if a[0] is None or (b[0] is not None and (b[0] > a[0]) == largest):
        return b[0], rows, b[2]
    return a[0], rows, a[2]


class _Node:
    __slots__ = ("label", "kids", "held", "file")

    def __init__(self, label: bytes):
        self.label, self.kids, self.held, self.file = label, {}, None, None


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:]."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie of byte strings, which spills by subtree.

    new_file() gives a spill file with write(bytes), and read() after that.
    """

    def __init__(self, largest: bool, budget: int, new_file: Callable):
        self.root, self.largest, self.budget, self.new_file = _Node(b""), largest, budget, new_file
        self.bytes, self.files = 0, []

    def insert(self, key: bytes, held: Held) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                node.file.write(_record(key, held))
                return
            if at == len(key):
                node.held = held if node.held is None else merge(node.held, held, self.largest)
                break
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node(key[at:])
                kid.held = held
                self.bytes += len(kid.label) + _NODE_BYTES
                break
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            n = _shared(kid.label, key, at)
            fork = _Node(kid.label[:n])
            kid.label = kid.label[n:]
            fork.kids[kid.label[0]] = kid
            node.kids[key[at]] = fork
            self.bytes += _NODE_BYTES
            node, at = fork, at + n
        if self.bytes > self.budget:
            self._spill()

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, Held]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.held is not None:
                yield prefix, node.held
            stack.extend((kid, prefix + kid.label) for kid in node.kids.values())

    def _size(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + _NODE_BYTES
            stack.extend(node.kids.values())
        return total

    def _spilled(self, node: _Node) -> list:
        out, stack = [], [node]
        while stack:
            node = stack.pop()
            if node.file is not None:
                out.append(node.file)
            stack.extend(node.kids.values())
        return out

    def _spill(self) -> None:
        """Writes out the heaviest subtree of the first fork on the heavy path."""
        node, prefix = self.root, b""
        while True:
            kids = [k for k in node.kids.values() if k.file is None]
            if not kids:
                return
            kid = max(kids, key=self._size)
            whole = self._size(kid)
            if whole > self.bytes // 2 and any(k.file is None for k in kid.kids.values()):
                node, prefix = kid, prefix + kid.label
                continue
            break
        if not kid.kids and self.bytes - whole < _NODE_BYTES:
            return  # a single string: nothing smaller to hold
        file = self.new_file()
        for key, held in self._walk(kid, prefix + kid.label):
            file.write(_record(key, held))
        # what lay in the shared folder below it goes along: one file for each subtree
        for below in self._spilled(kid):
            self.files.remove(below)
            for key, held in below.read():
                file.write(_record(key, held))
        kid.kids, kid.held, kid.file = {}, None, file
        self.files.append(file)
        self.bytes -= whole - _NODE_BYTES

    def items(self) -> Iterator[tuple[bytes, Held]]:
        """Every distinct string with its state, spilled ones after the rest."""
        yield from self._walk(self.root, b"")
        self.root = _Node(b"")
        for file in self.files:
            below = Trie(self.largest, self.budget, self.new_file)
            for key, held in file.read():
                below.insert(key, held)
            yield from below.items()
        self.files = []


def _record(key: bytes, held: Held) -> bytes:
    best, rows, mine = held
    return struct.pack("<Q?qqq", len(key), best is None, best or 0, rows, mine) + key


class _SharedFile:
    """A spilled subtree in the shared folder: segments, none of them kept open."""

    def __init__(self, folder: str):
        self._fs, root = open_fs(folder)
        self._path = f"{root}/trie-{uuid.uuid4().hex}"
        self._fs.create_dir(root, recursive=True)
        self._held, self._size, self._segments = [], 0, 0

    def write(self, record: bytes) -> None:
        self._held.append(record)
        self._size += len(record)
        if self._size > SEGMENT_BYTES:
            with self._fs.open_output_stream(f"{self._path}-{self._segments}") as out:
                out.write(b"".join(self._held))
            self._held, self._size, self._segments = [], 0, self._segments + 1

    def read(self) -> Iterator[tuple[bytes, Held]]:
        head = struct.calcsize("<Q?qqq")
        for k in range(self._segments):
            with self._fs.open_input_stream(f"{self._path}-{k}") as source:
                while len(raw := source.read(head)) == head:
                    size, null, best, rows, mine = struct.unpack("<Q?qqq", raw)
                    yield source.read(size), (None if null else best, rows, mine)
            self._fs.delete_file(f"{self._path}-{k}")
        for record in self._held:
            _, null, best, rows, mine = struct.unpack_from("<Q?qqq", record)
            yield record[head:], (None if null else best, rows, mine)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES, combine_bytes: int = COMBINE_BYTES) -> DataFrame:
    """One row per distinct text: (size, hash, sha, keep_id, n_rows, n_keep).

    n_keep: how many rows bear both the text and keep_id (repeated rows).
    """
    largest = {"largest": True, "smallest": False}[keep]
    folder = shared_dir(docs.sparkSession) + "/trie-spill"

    def combine(batches):
        """One row for each text met: hot groups shrink before the shuffle."""
        seen: dict[str, list] = {}
        held_bytes = 0

        def flush():
            rows = [(text, *v) for text, v in seen.items()]
            seen.clear()
            for a in range(0, len(rows), _BATCH_ROWS):
                text, size, code, held = zip(*rows[a : a + _BATCH_ROWS])
                best, n, mine = zip(*held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size, pa.int32()), pa.array(code, pa.int64()), pa.array(text, pa.string()), pa.array(best, pa.int64()), pa.array(n, pa.int64()), pa.array(mine, pa.int64())],
                    names=["size", "hash", "text", "best", "n", "mine"],
                )

        for batch in batches:
            for part in narrow(batch, SLICE_BYTES):
                for doc_id, text, size, code in zip(*(c.to_pylist() for c in part.columns)):
                    if (known := seen.get(text)) is None:
                        seen[text] = [size, code, (doc_id, 1, 1)]
                        held_bytes += size + _NODE_BYTES
                        if held_bytes > combine_bytes:
                            yield from flush()
                            held_bytes = 0
                    else:
                        known[2] = merge(known[2], (doc_id, 1, 1), largest)
        yield from flush()

    def insert(batches):
        trie = Trie(largest, trie_bytes, lambda: _SharedFile(folder))
        for batch in batches:
            text, best, n, mine = (batch.column(i) for i in (2, 3, 4, 5))
            for key, *held in zip(text, best.to_pylist(), n.to_pylist(), mine.to_pylist()):
                trie.insert(key.as_py().encode("utf-8"), tuple(held))
        out: list[tuple] = []
        names = ["size", "hash", "sha", "keep_id", "n_rows", "n_keep"]

        def pack():
            size, code, sha, best, n, mine = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(code, pa.int64()), pa.array(sha, pa.string()), pa.array(best, pa.int64()), pa.array(n, pa.int64()), pa.array(mine, pa.int64())], names=names)

        digests = array("Q")  # of each text 16 bytes: no two texts of a partition share a sha-256
        for key, held in trie.items():
            digest = hashlib.sha256(key)
            digests.frombytes(digest.digest()[:16])
            code = np.uint64(xxhash.xxh64_intdigest(key, 42)).astype(np.int64)
            out.append((len(key), int(code), digest.hexdigest(), *held))
            if len(out) >= _BATCH_ROWS:
                yield pack()
        if out:
            yield pack()
        pairs = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)
        first = np.sort(pairs[:, 0])
        twice = first[1:][first[1:] == first[:-1]]
        if len(twice):
            alike = pairs[np.isin(pairs[:, 0], twice)]
            if len(np.unique(alike, axis=0)) < len(alike):
                raise ValueError("two texts share a sha-256")

    rows = _columns(docs, id_col, text_col).select("id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))
    partial = rows.mapInArrow(combine, "size int, hash long, text string, best long, n long, mine long")
    dealt = partial.repartition("size", "hash")
    return dealt.mapInArrow(insert, "size int, hash long, sha string, keep_id long, n_rows long, n_keep long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    A null text counts as empty, so null and empty texts form one group; the
    row with the largest (or smallest) id of a group stays, a null id only
    where the group has no other; of rows repeated with that same id and text
    one is kept; group_size counts rows.  An empty table gives an empty table.
    """
    found = cut(groups(docs, id_col, text_col, keep, trie_bytes), slim=True)
    rows = cut(
        _columns(docs, id_col, text_col)
        .select("id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"), F.sha2("text", 256).alias("sha"))
        .groupBy("id", "size", "hash", "sha")
        .agg(F.count("*").alias("copies")),
        slim=True,
    )
    # one group may hold a third of all rows
    joined = join_counted(rows, found, ["size", "hash", "sha"], "n_rows")
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n_rows").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_keys(docs: DataFrame, **options) -> DataFrame:
    """(id, sha, n) of the row that stays of every group, for common.retain."""
    return groups(docs, **options).select(F.col("keep_id").alias("id"), "sha", F.col("n_keep").alias("n"))


ORACLE_SQL = """
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM (
  SELECT doc_id,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
         sha256(coalesce(text, '')) AS text_sha256
  FROM documents)
"""
