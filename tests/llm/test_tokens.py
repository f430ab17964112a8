"""Token id files and pieces against the libraries."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelseek.llm import dac, pieces
from tests.llm.helpers import clash, docs

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = ["", " ", "   ", " a", "a ", "a  b", "a \n b", "x  y　 z", "it's  we'll 12 3", "\t tab", "a\u0085 b\x1c c"]
ODD += ["🙂 🙂 a", "é è", "a _ b __ c", "<|endoftext|> x", "</s> <s>", "x² ½ a", "Anea.\nOf that, no. a..b", "x" * 3000]
ODD += ["日本語テキスト 한국어", "\x00\x01", "aaaaaaaaaaaaaaaaaaa bbbbbbb", "1234567890", "....... ---- ====", "a\n\nb\r\nc", "a\nb \nc\n", "!'s a''s 't it'sx a12b½", "٣٤ a\u00a0b", "e\u0301 x\U000e0fff y"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "aeiou tnsrhdlcm.,\né日ñ12"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segment(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << 32, n, dtype=np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
    segment = dac.Segment.read(dac.encode_segment(ids))
    assert segment.all().tolist() == ids.tolist()
    assert [segment.get(i) for i in range(n)] == ids.tolist()


def test_file(tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT", 10)
    rng = np.random.default_rng(0)
    documents = [(None if d == 0 else d, rng.integers(0, 70_000, n).astype(np.uint32)) for d, n in enumerate([3, 0, 45, 1, 10])]
    path = str(tmp_path / "deep" / "x.dac")
    assert dac.write_file(path, iter(documents)) == (5, 59)
    file = dac.IdFile(path)
    assert [x.tolist() for x in file.documents()] == [x.tolist() for _, x in documents]
    flat = np.concatenate([x for _, x in documents])
    assert [file.get(i) for i in range(59)] == flat.tolist()
    assert file.nulls.tolist() == [1, 0, 0, 0, 0]


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|><|endoftext|>\n", "<|endoftext", "x" * 9000 + "<|endoftext|>y"]


def test_added_tokens():
    assert [x.tolist() for x in dac.ByteBpe(BPE)(ADDED[:2])] == [[64, 220, 50256, 275], [50256]]


def test_byte_bpe(monkeypatch):
    library = Tokenizer.from_file(BPE)
    monkeypatch.setattr(dac, "REMEMBERED", 3000)
    encode = dac.ByteBpe(BPE)
    texts = ADDED + ODD + random_texts(800) + ADDED
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        got = [x.tolist() for x in encode(part)]
        assert got == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_written_and_read(spark, checkpoint_dir):
    library = Tokenizer.from_file(BPE)
    table = [(i * 3 % 101, t, "en", "s") for i, t in enumerate(ADDED + ODD + random_texts(40))]
    table += [(None, "no id", None, None), (500, None, "en", "s"), (500, "same id", "en", "s"), (500, "same id", "en", "s")]
    manifest = dac.write_ids(clash(docs(spark, table), F), lambda: dac.byte_bpe(BPE), 2)
    got = sorted(dac.read_ids(manifest).collect(), key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and ids[0] == -1
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    want = sorted((-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in table)
    assert sorted((i, np.frombuffer(r["ids"], "<u4").tolist()) for i, r in zip(ids, got)) == want


def test_nothing_written(spark, checkpoint_dir):
    assert dac.read_ids(dac.write_ids(docs(spark, []), lambda: dac.byte_bpe(BPE), 2)).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECES)


def test_viterbi_equals_the_library(model, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(7)
    texts = [*ODD, *random_texts(1500)]
    texts += ["".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(500)]
    texts += ["".join(rng.choices(model.text[300:], k=rng.randint(1, 6))).replace("▁", " ") for _ in range(3000)]
    monkeypatch.setattr(pieces, "BATCH_CHARS", 5000)
    monkeypatch.setattr(pieces, "REMEMBERED", 2000)
    encode = pieces.Encoder(model)
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == library.encode(text), text
        assert pieces.decode(model, ids.tolist()) == text


def test_long_units_take_the_same_search(model, monkeypatch):
    """Texts without a blank, of 5000 characters and more: never the heap, and the library's ids."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(11)
    letters_ = [c for c in {c for t in model.text[300:] for c in t} if c != "▁"]
    texts = [
        "".join(rng.choices("ab", k=5000)),
        "a" * 6000,
        "".join(rng.choices(letters_, k=5000)),
        "".join(t.replace("▁", "") for t in rng.choices(model.text[300:], k=3000)),
        "https://example.org/" + "/".join(rng.choices(["index", "page", "12", "ü"], k=2000)),
    ]
    monkeypatch.setattr(pieces.Pieces, "merge", lambda *a: pytest.fail("a heap merge"))
    encode = pieces.Encoder(model)
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == library.encode(text), text[:50]
    for unit in ["▁hello", "▁internationalisation", "xyzzy", "überall", "a"]:
        flat, _ = encode.viterbi(pieces.code_points(unit)[None, :])
        assert encode.viterbi_one(pieces.code_points(unit)).tolist() == flat.tolist()


def test_heap_merge_equals_viterbi(model):
    encode = pieces.Encoder(model)
    for unit in ["▁hello", "▁internationalisation", "xyzzy", "aaaaaaa", "▁123", "überall"]:
        flat, n = encode.viterbi(pieces.code_points(unit)[None, :])
        assert flat.tolist() == model.merge(unit) and n.tolist() == [len(flat)]


def test_columns(spark):
    table = [(i, t, "en", "s") for i, t in enumerate([*ODD, "a▁b"])] + [(90, None, None, None), (90, None, None, None)]
    d = clash(docs(spark, table), F)
    told = d.select("doc_id", "text", pieces.encoded(PIECES, F.col("text")).alias("e"))
    told = told.withColumn("back", pieces.decoded(PIECES, F.col("e.ids"))).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(told) == len(table)
    for r in told:
        assert r["e"]["ids"] == library.encode(r["text"] or "")
        assert r["e"]["exact"] == ("▁" not in (r["text"] or "")) and r["back"] == (r["text"] or "").replace("▁", " ")
    assert docs(spark, []).select(pieces.encoded(PIECES, F.col("text"))).count() == 0
