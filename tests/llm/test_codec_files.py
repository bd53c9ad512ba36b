import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from collatio.llm import sentencepiece_codec as S
from collatio.llm import token_files as W
from collatio.llm.queries import tokenizer_path

MODEL, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb\r\n", "▁", "a▁b ▁ c", "甲乙。丙", "é̀ ﬁ Å", "\u0000x", "<s> </s>", "<0x41>", "x" * 5000,
    "word, word. 'tis don't I'll", "…—", "🙂🙂 a🙂", "Ünï cödé ÜNÏ", "a\tb\u00a0c\u3000d", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ǅ", "1,234.5 a1b2 (x) [y]--z", "the,, the.. the!! the&&&",
]


def some_texts():
    rng = random.Random(3)
    alphabet = "abcdeé ÀÇ  ,.'!?\n123甲乙▁🙂<|>"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(150)]


def test_codec_equals_library(spark):
    texts = some_texts()
    sp = S.load(MODEL)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in S.round_trip_digest(docs, MODEL).collect()}
    encoded = S.encode(docs, MODEL)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: r.text for r in S.decode(encoded, MODEL).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert ids[i] == want, repr(t)
        assert back[i] == sp.decode(want)
        raw = np.array(want, "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(want).encode()).hexdigest())


def test_codec_small_table_and_empty(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} the") for i in range(200)], "doc_id long, text string")
    assert sorted(S.round_trip_digest(docs, MODEL, entries=5).collect()) == sorted(S.round_trip_digest(docs, MODEL).collect())
    assert S.round_trip_digest(docs.limit(0), MODEL).count() == 0
    assert S.crossing_pieces(S.load(MODEL)) == []


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("entries", [3, 60_000])
def test_words_equal_library(entries):
    tok, table = library(), W.Encoder(library(), entries)
    texts = some_texts()
    for _ in range(2):
        for t, ids in zip(texts, table.encode_all(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A tokenizer whose words do not join to its ids is noticed, and right all the same."""
    import os

    assert W.encoder(WORDS).by_words and S.codec(MODEL).by_chunks
    other = os.path.join(os.path.dirname(WORDS), "byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok, table = Tokenizer.from_file(other), W.encoder(other)
    assert not table.by_words
    for t, ids in zip(ODD, table.encode_all(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids
    c = S.Codec(MODEL)
    c.by_chunks = False
    assert c.encode_column(S.pa.array(ODD, S.pa.string())) == [S.codec(MODEL).encode(t) for t in ODD]


def test_file_format():
    out = io.BytesIO()
    writer = W.Writer(out, frame_ids=10)
    docs = [np.arange(i * 4, dtype="<u4").tobytes() for i in (0, 1, 9, 0, 3, 1)]
    for i, d in enumerate(docs):
        writer.add(None if i == 2 else i, d)
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = W.Reader(Source(out.getvalue()))
    assert reader.doc_ids == [0, 1, None, 3, 4, 5]
    assert [reader.document(i) for i in range(6)] == docs
    fresh = W.Reader(Source(out.getvalue()))
    assert fresh.document(5) == docs[5]
    assert fresh.frames_read == 1  # of several, only the one that holds the document
    damaged = bytearray(out.getvalue())
    damaged[20] ^= 1
    with pytest.raises(Exception):
        bad = W.Reader(Source(bytes(damaged)))
        bad.document(1), bad.document(2)


def test_write_and_read(spark, tmp_path):
    texts = some_texts()
    rows = [(i * 3 % 101, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (5, "same", 1), (5, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    path = str(tmp_path / "out")
    manifest = W.write(docs, WORDS, path)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)
    got = W.read(spark, path).orderBy("start").collect()
    tok = library()
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    want = sorted(((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in got), key=str) == want
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in W.read_digest(spark, path).collect()}
    for r in got:
        assert digest[(r.doc_id, r.start)] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert len(W.lookup(spark, path, [5, 10_000]).collect()) == sum(r[0] == 5 for r in rows)
    assert W.lookup(spark, path, [-4, 10_000]).count() == W.lookup(spark, path, []).count() == 0
    some = {(r.doc_id, r.start, tuple(r.ids)) for r in W.lookup(spark, path, [100, 7, 7, 50]).collect()}
    assert some == {(r.doc_id, r.start, tuple(r.ids)) for r in got if r.doc_id in (7, 50, 100)}
    spans = [(r.first_id, r.last_id) for r in manifest.collect() if r.first_id is not None]
    assert spans == sorted(spans) and spans[0][0] == 0 and spans[-1][1] == 100


def test_write_empty(spark, tmp_path):
    W.write(spark.createDataFrame([], "doc_id long, text string"), WORDS, str(tmp_path / "none"))
    assert W.read(spark, str(tmp_path / "none")).count() == 0
