"""Token ids in seekable zstandard files.

A file holds one stream of little-endian uint32 ids, cut into independent
zstandard frames of FRAME_IDS ids each (the last may be shorter), then a
skippable frame with the document index (ids, null flags and stream ends, in
file order), then the seek table of the public zstd seekable format: for each
frame its compressed size, its size and the low 32 bits of the XXH64 of its
content.  A reader opens the tail, finds a document's range in the index and
decompresses only the frames that the range touches, checking each.

A run writes one file for each partition of a range partitioning by doc_id;
the manifest names the files of the task attempts that counted, so retried and
speculative attempts leave no doubt, and files that it does not name are waste.
Files and manifest go to the folder given, which executors and driver share.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.llm.common import narrow, open_fs, ragged

FRAME_IDS = 1 << 17
LEVEL = 1
#: Marks and odd words whose ids an encoder keeps.
TABLE_ENTRIES = 50_000
#: A word of Latin letters, then marks that no contraction begins with.
_CORE_AND_MARKS = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!\x22#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)$"
#: Cores that the library gets in one text.
_TOGETHER = 1000
#: Bytes of text whose words are made distinct together.
SLICE_BYTES = 8 << 20
#: What a tokenizer's ids for single words must join to, or whole texts go to it.
PROBES = (
    "", " ", "the The THE", " two  blanks ", "line\nbreak\n\n", "tab\there\r\n", "it's don't we'll O'Neil's", "end. (and) [more]... #5 3.14 a1b2 x_y",
    "Ünïcödé straße ÉTÉ naïve", "ﬁne ① ½ Å", "日本語 テキスト 한국어", "emoji 👩‍👩‍👧 ok!", "a\u00a0b\u3000c\u200bd", "</w> <unk> <s>", "w" * 70, "\u0130stanbul Ω ς",
)
#: Ids that a task reads back, in whole files.
READ_IDS = 8 << 20

MANIFEST = "part int, file string, n_docs long, n_ids long, first_id long, last_id long"

# Fixed values of the public zstd seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_INDEX_FRAME = 0x184D2A5B
_HAS_CHECKSUM = 0x80


class Encoder:
    """Encodes a column of texts, each distinct word once by the library.

    Pre-tokens of the tokenizer never hold white space, so words between
    blanks and line ends are independent.  Distinct words are split in Arrow
    into letters and a run of marks behind them, which are pre-tokens of their
    own; a pre-token's last id stands for a piece that ends a word, so the
    library gets many distinct cores in one text and its ids are cut behind
    such pieces.  Words of any other form go to the library alone.  Ids are
    then joined by position.  Nothing is kept between slices but the ids of
    marks and odd words, TABLE_ENTRIES at most.
    """

    def __init__(self, tokenizer, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self._tok, self._entries, self._alone = tokenizer, entries, {}
        # for cores, which are in normal form as they stand
        self._plain = Tokenizer(tokenizer.model)
        self._plain.pre_tokenizer = tokenizer.pre_tokenizer
        pieces = tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self._ends[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True
        # of another kind of tokenizer whole texts are encoded by the library
        self.by_words = True
        self.by_words = self._joins()

    def _joins(self) -> bool:
        """Whether ids of words, joined, are the library's ids of the text, on PROBES."""
        try:
            ids, ends = self.encode_column(pa.array(PROBES, pa.string()))
        except Exception:  # a tokenizer that words cannot be taken from
            return False
        return all(x.tolist() == self._tok.encode(t, add_special_tokens=False).ids for x, t in zip(np.split(ids, ends[:-1]), PROBES))

    def alone(self, word: str) -> list[int]:
        found = self._alone.get(word)
        if found is None:
            found = self._tok.encode(word, add_special_tokens=False).ids
            if len(self._alone) >= self._entries:
                self._alone.clear()
            if len(word) <= 64:
                self._alone[word] = found
        return found

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.alone(word) for word in words]
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words of plain lower-case letters."""
        flat, sizes = [], []
        for a in range(0, len(words), _TOGETHER):
            part = words[a : a + _TOGETHER]
            encoded = self._plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            ids = np.asarray(encoded, dtype=np.uint32)
            cuts = np.flatnonzero(self._ends.take(ids)) + 1
            if len(cuts) == len(part):
                flat.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                ids, n = self._each(part)
                flat.append(ids)
                sizes.append(n)
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of distinct words."""
        split = pc.extract_regex(words, pattern=_CORE_AND_MARKS)
        simple = pc.is_valid(split).to_numpy(zero_copy_only=False)
        kept = split.filter(pa.array(simple))
        cores = pc.utf8_lower(pc.struct_field(kept, 0)).dictionary_encode()
        marks = pc.struct_field(kept, 1).dictionary_encode()
        core_ids, core_n = self._cores(cores.dictionary.to_pylist())
        mark_ids, mark_n = self._each(marks.dictionary.to_pylist())
        odd_ids, odd_n = self._each(words.filter(pa.array(~simple)).to_pylist())
        flat = np.concatenate([core_ids, mark_ids, odd_ids])
        # two stretches for each word: letters and marks, or the odd word and nothing
        starts, sizes = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        c, m = cores.indices.to_numpy(), marks.indices.to_numpy()
        starts[simple, 0], sizes[simple, 0] = (np.cumsum(core_n) - core_n).take(c), core_n.take(c)
        starts[simple, 1], sizes[simple, 1] = (np.cumsum(mark_n) - mark_n + len(core_ids)).take(m), mark_n.take(m)
        starts[~simple, 0], sizes[~simple, 0] = np.cumsum(odd_n) - odd_n + len(core_ids) + len(mark_ids), odd_n
        return ragged(flat, starts.reshape(-1), sizes.reshape(-1)), sizes.sum(axis=1)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids); null counts as empty."""
        if not self.by_words:
            found = [e.ids for e in self._tok.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], dtype=np.uint32), np.cumsum([len(ids) for ids in found], dtype=np.int64)
        blanks = pc.replace_substring(pc.fill_null(texts, ""), pattern="\n", replacement=" ")
        lists = pc.split_pattern(blanks, pattern=" ")
        words = lists.flatten().dictionary_encode()
        ids, n = self._distinct(words.dictionary)
        place = words.indices.to_numpy()
        each = n.take(place)
        ends = np.concatenate([[0], np.cumsum(each)])
        bounds = lists.offsets.to_numpy()
        return ragged(ids, (np.cumsum(n) - n).take(place), each), ends[bounds[1:]]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])] if len(texts) else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _ENCODERS:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[tokenizer_file] = Encoder(Tokenizer.from_file(tokenizer_file))
    return _ENCODERS[tokenizer_file]


class Writer:
    """Writes one file; close() adds index and seek table."""

    def __init__(self, sink, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        self._sink, self._size = sink, 4 * frame_ids
        self._frame_ids = frame_ids
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._buffer, self._held = [], 0
        self._seek: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []
        self._ends: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._ids.append(doc_id)
        self.total += len(ids) // 4
        self._ends.append(self.total)
        self._buffer.append(ids)
        self._held += len(ids)
        if self._held >= self._size:
            self._cut(final=False)

    def _cut(self, final: bool) -> None:
        data = b"".join(self._buffer)
        at = 0
        while len(data) - at >= self._size or (final and at < len(data)):
            self._frame(data[at : at + self._size])
            at += self._size
        self._buffer, self._held = [data[at:]], max(0, len(data) - at)

    def _frame(self, raw: bytes) -> None:
        packed = self._zstd.compress(raw)
        self._sink.write(packed)
        self._seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._cut(final=True)
        nulls = np.array([x is None for x in self._ids], dtype="u1")
        ids = np.array([x or 0 for x in self._ids], dtype="<i8")
        ends = np.array(self._ends, dtype="<i8")
        body = struct.pack("<QI", len(ids), self._frame_ids) + zstandard.ZstdCompressor(level=3).compress(nulls.tobytes() + ids.tobytes() + ends.tobytes())
        self._sink.write(struct.pack("<II", _INDEX_FRAME, len(body)) + body)
        self._seek.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *x) for x in self._seek)
        self._sink.write(struct.pack("<II", _SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self._seek), _HAS_CHECKSUM, _SEEKABLE))


class Reader:
    """Reads one file by its tail; decompresses only what is asked for."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE or not flags & _HAS_CHECKSUM:
            raise ValueError("not a seekable file with checksums")
        source.seek(size - 9 - 12 * frames)
        self.seek_table = np.frombuffer(source.read(12 * frames), dtype="<u4").reshape(frames, 3)
        self._at = np.concatenate([[0], np.cumsum(self.seek_table[:, 0], dtype=np.int64)])
        source.seek(int(self._at[-2]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != _INDEX_FRAME:
            raise ValueError("no document index")
        body = source.read(length)
        n, self._frame_ids = struct.unpack("<QI", body[:12])
        raw = zstandard.ZstdDecompressor().decompress(body[12:])
        #: ids are in order behind the null ones
        self.nulls = np.frombuffer(raw, dtype="u1", count=n)
        self.ids = np.frombuffer(raw, dtype="<i8", count=n, offset=n)
        self.ends = np.frombuffer(raw, dtype="<i8", count=n, offset=9 * n)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if n else self.ends
        self.doc_ids = [None if z else x for z, x in zip(self.nulls.tolist(), self.ids.tolist())]
        self._zstd = zstandard.ZstdDecompressor()
        self._last: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self._source.seek(int(self._at[k]))
            raw = self._zstd.decompress(self._source.read(int(self.seek_table[k, 0])))
            if len(raw) != self.seek_table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek_table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._last = (k, raw)
        return self._last[1]

    def document(self, i: int) -> bytes:
        """Ids of the i-th document of the file, as bytes."""
        start, end = int(self.starts[i]), int(self.ends[i])
        parts, at = [], start
        while at < end:
            k, inside = divmod(at, self._frame_ids)
            stop = min(end - k * self._frame_ids, self._frame_ids)
            parts.append(self.frame(k)[4 * inside : 4 * stop])
            at = k * self._frame_ids + stop
        return b"".join(parts)


def write(df: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id, write files below path; the manifest.

    Rows are ordered by (id, text), null ids first; a null text counts as
    empty (the end id alone); repeated rows are written as often as they
    occur; an empty table writes no file.  path must be empty or new.
    Manifest: (part, file, n_docs, n_ids, first_id, last_id), by part; the least
    and largest id are null where a file has none.
    """
    spark = df.sparkSession
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        name = f"part-{part:06d}-{attempt}.ids.zst"
        fs, root = open_fs(path)
        words = encoder(tokenizer_file)
        writer = sink = None
        docs, first, last = 0, None, None
        for batch in batches:
            for part_of in narrow(batch, SLICE_BYTES):
                low, high = (pc.min_max(part_of.column(0))[k].as_py() for k in ("min", "max"))
                first, last = low if first is None else first, last if high is None else high
                if writer is None:
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = Writer(sink)
                ids, ends = words.encode_column(part_of.column(1))
                raw, start = ids.astype("<u4", copy=False).tobytes(), 0
                for doc_id, stop in zip(part_of.column(0).to_pylist(), (4 * ends).tolist()):
                    writer.add(doc_id, raw[start:stop] + end)
                    start = stop
                docs += part_of.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [docs], "n_ids": [writer.total], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64())})

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text")
    # one row for each partition
    rows = ordered.mapInArrow(run, MANIFEST).collect()
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files that count, in the order of their ids; of an empty table none."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("part")


def _scan(spark: SparkSession, path: str, each, schema: str, wanted: np.ndarray | None = None) -> DataFrame:
    """each(reader, global start) of every file, or of those whose ids span one that is wanted (in order)."""
    files, start, total = [], 0, 0
    for row in read_manifest(spark, path).collect():
        if wanted is None or row.first_id is not None and np.searchsorted(wanted, row.first_id) < np.searchsorted(wanted, row.last_id, "right"):
            files.append((row.file, start))
            total += row.n_ids
        start += row.n_ids
    if not files:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(files)

    def run(batches):
        fs, root = open_fs(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, start = shared.value[k]
                with fs.open_input_file(f"{root}/{name}") as source:
                    yield from each(Reader(source), start)

    tasks = min(len(files), total // READ_IDS + 1)
    return spark.range(0, len(files), 1, tasks).mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, in any order.

    Null ids and repeated rows are given as written; no file gives no row.
    """

    def each(reader: Reader, start: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(reader.doc_ids), 256):
            rows = range(a, min(a + 256, len(reader.doc_ids)))
            ids = [np.frombuffer(reader.document(i), dtype="<i4") for i in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([reader.doc_ids[i] for i in rows], pa.int64()),
                "start": pa.array([start + int(reader.starts[i]) for i in rows], pa.int64()),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.list_(pa.int32())),
            })

    return _scan(spark, path, each, "doc_id long, start long, n_tokens long, ids array<int>")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): read back, without moving ids to the JVM.

    Null ids and repeated rows are given as written; no file gives no row.
    """

    def each(reader: Reader, start: int) -> Iterator[pa.RecordBatch]:
        crc = [zlib.crc32(reader.document(i)) for i in range(len(reader.doc_ids))]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(reader.doc_ids, pa.int64()),
            "start": pa.array(reader.starts + start, pa.int64()),
            "n_tokens": pa.array(reader.ends - reader.starts, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        })

    return _scan(spark, path, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents asked for.

    Only files whose ids span one of them are opened, and only frames that hold
    them decompressed; ids not present give no row, repeated documents one each.
    """
    wanted = np.unique(np.array(doc_ids, dtype=np.int64))

    def each(reader: Reader, start: int) -> Iterator[pa.RecordBatch]:
        nulls = int(reader.nulls.sum())
        known = reader.ids[nulls:]
        for a, b in zip(np.searchsorted(known, wanted, "left").tolist(), np.searchsorted(known, wanted, "right").tolist()):
            for i in range(nulls + a, nulls + b):
                ids = np.frombuffer(reader.document(i), dtype="<i4")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([reader.doc_ids[i]], pa.int64()), "start": pa.array([start + int(reader.starts[i])], pa.int64()),
                    "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32())),
                })

    return _scan(spark, path, each, "doc_id long, start long, n_tokens long, ids array<int>", wanted)
