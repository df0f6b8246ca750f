import random
import zlib

import numpy as np
import pytest

from lectern.llm.packing import best_filling, fillings, pack_documents
from lectern.llm.tokens import byte_encoder


def test_best_filling_is_the_best():
    r = random.Random(1)
    for _ in range(300):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(1, 60)
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * i for s in sums for i in range(v + 1)}
        used = best_filling(counts, room)
        assert all(v <= counts[k] for k, v in used.items())
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)


def test_fillings_use_every_piece_once():
    counts = {7: 5, 3: 9, 10: 2, 1: 1}
    left = dict(counts)
    for used, repeat in fillings(dict(counts), 12):
        assert 0 < sum(k * v for k, v in used.items()) <= 12
        for k, v in used.items():
            left[k] -= v * repeat
    assert not any(left.values())


LONG = 1_000_000


@pytest.mark.parametrize(
    "text",
    ["\n" * LONG, " " * LONG, "\t" * LONG, "a" + " " * LONG + "b", "a" + "\n" * (3 * LONG) + " b", " \n\t" * LONG, "a\n" + "\u3000" * 5000 + "é", "x" + "\u00a0" * 1000 + " y  z" + "\n" * 999 + "q", "a b " * 300_000, "a" * LONG, "<|endoftext|>" + " " * 5000 + "<|endoftext|>a" + "\n" * 2000, "\x1c" * 3000 + "a"],
    ids=range(12),
)
def test_long_texts_are_encoded_as_by_the_library(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert byte_encoder().encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    from lectern.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 10)
    own = tokens.ByteEncoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    text = " ".join(f"w{i}" for i in range(500)) + " " + "z" * 10_000
    assert own.encode(text) == byte_encoder().encode(text)
    assert len(own.after_blank) <= 10 and max(map(len, own.after_blank)) <= tokens.KEPT_CHARS


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, "\n" * LONG), (2, "a" + " " * LONG + "b"), (3, None)], "doc_id long, text string")
    rows = pack_documents(docs).collect()
    for i, text in ((1, "\n" * LONG), (2, "a" + " " * LONG + "b"), (3, "")):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        total = len(byte_encoder().encode(text)) // 4 + 1
        assert sum(r.length for r in own) == total == own[0].doc_tokens and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]


@pytest.mark.parametrize("text", ["", " ", "a  b", "a   b", " \n b", "x\n\n y", "it's  fine", "a<|endoftext|>b", "tab\t here", "é ü 中文 12 3", "a \n", "\n a", "a \t b c", "don't  we'll"])
def test_encoder_equals_the_library(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert np.frombuffer(byte_encoder().encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_tile_documents_and_sequences(spark):
    texts = {0: "word " * 5000, 1: None, 2: "", 3: "a b c", 4: "a b c", 5: "Ünï " * 300}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string")
    rows = pack_documents(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.append(np.frombuffer(byte_encoder().encode(text or ""), "<u4"), 1).astype("<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
