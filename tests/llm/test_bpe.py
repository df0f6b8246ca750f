import random

import numpy as np
import pytest

from lectern.llm.bpe import Encoder, WordBpe, default_vocabulary, encode_documents
from lectern.llm.lexicon import Lexicon, compile_lexicon, save

TEXTS = ["", "  ", "Hello  World's idiot", "a<|endoftext|>B <|startoftext|>", "tab\tnl\n x", "École naïve 42 I'll", "éa ́", "ΣΑΣ İstanbul", "中文字 emoji 😀😀", "x" * 300, "!!!??? ...", "don't we'Re 1234", "a\x1cb\x1d", " nbsp em", "<|not|> <|endoftext|", "ǅ ß ẞ", "ab" * 400 + "1" + "é" * 90]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_lexicon_finds_its_words_only(tmp_path):
    r = random.Random(2)
    words = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))): [r.randint(0, 99) for _ in range(r.randint(1, 3))] for _ in range(200)}
    save(compile_lexicon(words), tmp_path)
    lex = Lexicon(tmp_path)
    probes = [*words, b"", b"zz", *(w + b"x" for w in words), *(w[:-1] for w in words)]
    for w, n in zip(probes, lex.numbers(probes)):
        assert (lex.output(n) if n >= 0 else None) == words.get(w)


def test_lexicon_shares_suffixes():
    parts = compile_lexicon({w: [1] for w in (b"walking", b"talking", b"balking", b"stalking")})
    assert len(parts["final"]) <= 12


def test_ids_and_decoded_equal_the_library(library, tmp_path):
    bpe = WordBpe(default_vocabulary())
    save(compile_lexicon({w: bpe.merge(w) for w in (b"hello", b"world", b"idiot", "é".encode())}), tmp_path)
    for lexicon in (None, Lexicon(tmp_path)):
        for text, (ids, decoded) in zip(TEXTS, Encoder(bpe, lexicon).encode(TEXTS)):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text
            assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_documents(spark, library):
    rows = [(i, t, "z") for i, t in enumerate([None, *TEXTS, TEXTS[2]])]
    got = {r.doc_id: r for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
