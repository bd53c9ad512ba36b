"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of such a model holds a whitespace marker behind another character,
so a text falls into chunks (a run of markers and what follows up to the next
marker) whose segmentations do not depend on each other.  Every distinct chunk
is segmented once by the library and kept, with its ids as bytes; a text's ids
are the chunks' bytes joined by position.  `crossing_pieces` tells whether a
model has the property; `encode` refuses one that lacks it.  If a model's
normaliser changes texts across chunks, which PROBES show, whole texts go to
the library instead.

The table is that of a slice of a batch (SLICE_BYTES), found in Arrow.  A table
shared by the whole cluster would need every occurrence of every chunk to be
shuffled twice (several times the input); a table for each slice needs no
shuffle, and is bounded by the slice.  Texts with runs of blanks are cut into
chunks one by one, with a bounded table that the Python worker keeps.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm.common import narrow, ragged

#: Entries of one generation of the chunk table, of which two are kept.
TABLE_ENTRIES = 50_000
#: Longer chunks are segmented without being kept.
KEEP_CHARS = 64
#: Bytes of text handled at once: bounds what a worker holds besides a text.
SLICE_BYTES = 8 << 20

_MARK = "▁"
#: What chunks must join to the library's ids of, or whole texts go to it.
PROBES = (
    "", " ", "a", "two words", "  lead and trail  ", "a   b", "\ttab\nline\r\n", f"{_MARK}mark {_MARK}{_MARK} x{_MARK}", "ﬁne ① ½ Å ÅNGSTRÖM", "日本語 テキスト 한국어",
    "emoji 👩‍👩‍👧 ok!", "a\u00a0b\u3000c\u200bd\ufeff", "<s> </s> <unk> <0x0A>", "\x00\x01 x", "e\u0301 e \u0301",
)
_CHUNKS = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+")


class ChunkTable(dict):
    """Chunk (without its first marker) -> ids as little-endian uint32 bytes."""

    def __init__(self, sp, entries: int = TABLE_ENTRIES):
        super().__init__()
        self._sp, self._entries, self._old = sp, entries, {}

    def _segment(self, chunk: str) -> list[int]:
        # a marker alone is no text to the library, which would drop it
        return self._sp.encode(chunk) if chunk else [self._sp.piece_to_id(_MARK)]

    def __missing__(self, chunk: str) -> bytes:
        found = self._old.get(chunk)
        if found is None:
            found = np.asarray(self._segment(chunk), dtype="<u4").tobytes()
        if len(chunk) <= KEEP_CHARS:
            if len(self) >= self._entries:
                self._old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def load(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def crossing_pieces(sp) -> list[str]:
    """Pieces with a marker behind another character (must be none)."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return [p for p in pieces if _MARK in p.lstrip(_MARK)]


class Codec:
    """Encoder and decoder of one model file, as a worker holds it."""

    def __init__(self, model_file: str, entries: int = TABLE_ENTRIES):
        self.sp = load(model_file)
        if bad := crossing_pieces(self.sp):
            raise ValueError(f"pieces cross whitespace markers: {bad[:3]}")
        self.table = ChunkTable(self.sp, entries)
        self.begin = np.asarray([self.sp.bos_id()], dtype="<u4").tobytes()
        self.end = np.asarray([self.sp.eos_id()], dtype="<u4").tobytes()
        self.by_chunks = True
        joined = self.encode_column(pa.array(PROBES, pa.string()))
        self.by_chunks = all(x == self._whole(t) for x, t in zip(joined, PROBES))

    def _whole(self, text: str) -> bytes:
        return self.begin + np.asarray(self.sp.encode(text), dtype="<u4").tobytes() + self.end

    def body(self, text: str) -> bytes:
        """Ids without begin and end, as bytes."""
        if not text:
            return b""
        if "  " in text or _MARK in text or text[0] == " " or text[-1] == " ":
            marked = _MARK + text.replace(" ", _MARK)
            chunks = (m.group()[1:] for m in _CHUNKS.finditer(marked))
        else:
            chunks = text.split(" ")
        return b"".join(map(self.table.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        if not self.by_chunks:
            return self._whole(text or "")
        return self.begin + self.body(text or "") + self.end

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """encode() of every text; each distinct chunk of the column is segmented once.

        Where blanks stand alone between other characters, chunks are what
        lies between them, and Arrow finds the distinct ones; other texts are
        cut by `body`.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_chunks:
            return [self._whole(t) for t in texts.to_pylist()]
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, _MARK))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, ""))))
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), pattern=" ")
        chunks = lists.flatten().dictionary_encode()
        found = self.sp.encode(chunks.dictionary.to_pylist(), num_threads=1)
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(n.sum()))
        place = chunks.indices.to_numpy()
        sizes = n.take(place)
        raw = ragged(flat, (np.cumsum(n) - n).take(place), sizes).tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()]
        plain = (self.begin + raw[a:b] + self.end for a, b in zip(ends.tolist(), ends[1:].tolist()))
        others = map(self.encode, texts.filter(odd).to_pylist())
        return [next(others) if x else next(plain) for x in odd.to_pylist()]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, dtype="<u4").tolist())


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(model_file: str, entries: int = TABLE_ENTRIES) -> Codec:
    key = (model_file, entries)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """(id, ids array<int>) with begin and end ids for every row.

    A null text counts as empty (begin and end only); null ids and repeated
    rows pass through as they are; an empty table gives an empty table.
    """

    def run(batches):
        c = codec(model_file, entries)
        for batch in batches:
            for part in narrow(batch, SLICE_BYTES):
                ids = [np.frombuffer(x, dtype="<i4") for x in c.encode_column(part.column(1))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ids, by the library's decode.

    A null list gives a null text, an empty one an empty text; control ids
    (begin, end) leave no text; ids outside the vocabulary raise.
    """

    def run(batches):
        sp = codec(model_file).sp
        for batch in batches:
            texts = [None if x is None else sp.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return slim.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digest(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), without moving ids to the JVM.

    Cases as in `encode`; the decoded text is made from the ids alone.
    """

    def run(batches):
        c = codec(model_file, entries)
        for batch in batches:
            for part in narrow(batch, SLICE_BYTES):
                rows = []
                for ids in c.encode_column(part.column(1)):
                    back = c.decode(ids).encode("utf-8")
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = slim.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
