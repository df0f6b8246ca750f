"""Token ids of whole texts under the byte-level vocabulary, from the tokenizers library's own file format.

The vocabulary's words never reach over a blank that has no other white space beside it, so a text can be
cut at such blanks and the pieces looked up in a table of pieces seen before. The vocabulary file that
the encoder reads is a parameter; its ids equal those of the JSON file of the same name.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

SPECIAL = "<|endoftext|>"
#: White space on both sides of a blank: there the text isn't cut.
UNSAFE = re.compile(r"\s \s|^ \s")
#: Pieces kept by a worker, none of more characters than ``KEPT_CHARS``; beyond that it starts anew. Bounds memory, never results.
KEPT_PIECES, KEPT_CHARS = 300_000, 64
#: White space as the pattern below has it, so much in a row that its matching goes too deep for the library's pattern engine.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Encodes as tokenizers does with ``add_special_tokens=False``; ids come as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.whole = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.after_blank: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        Long white space is one piece of its own up to the text's end, or but for its last character before something else, which belongs to what follows.
        """
        out, a = [], 0
        for run in LONG_SPACE.finditer(text):
            b = run.end() if run.end() == len(text) else run.end() - 1
            out += self.whole.encode_ordinary(text[a : run.start()])
            out += self.whole._encode_single_piece(text[run.start() : b])
            a = b
        return np.array(out + self.whole.encode_ordinary(text[a:] if a else text), dtype="<u4").tobytes()

    def _new(self, word: str) -> bytes:
        out = self._ids(" " + word)
        if len(word) <= KEPT_CHARS:
            if len(self.after_blank) >= KEPT_PIECES:
                self.after_blank.clear()
            self.after_blank[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            parts = self.at_special.split(text)
            return b"".join([np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts)])
        if "  " in text or UNSAFE.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known, new = self.after_blank.get, self._new
        return self._ids(first) + b"".join([known(w) or new(w) for w in rest])


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str | None = None) -> ByteEncoder:
    """The worker's encoder for the vocabulary at ``path`` (default: the public byte-level one)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
