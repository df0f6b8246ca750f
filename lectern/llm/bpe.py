"""Encoding and decoding of whole texts under a word-level BPE vocabulary.

Frequent words, counted over all texts, are compiled with their ids into a minimal acyclic transducer
(``lexicon``) on the driver; its size is bounded by ``LEXICON_WORDS``. Workers write it to local files and map
them into memory. Words that it doesn't hold are merged exactly, lowest rank first. What a text's blanks divide is
encoded apart from its neighbours, so each worker keeps the pieces it has met (bounded, results unaffected).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import tempfile
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointing, map_texts, stored, texts_of
from .lexicon import Lexicon, compile_lexicon, save
from .tokens import byte_alphabet

#: Words in the transducer at most.
LEXICON_WORDS = 150_000
#: Pieces and words whose results a worker keeps. They bound its memory; others are worked out each time.
KEPT_PIECES, KEPT_WORDS = 200_000, 100_000
#: The vocabulary's pre-tokenizer pattern (fixed value), with white space as the library's engine has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def default_vocabulary() -> str:
    """Where the public word-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """The vocabulary's normalisation, word split and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in (self.vocab | self.special).items()}
        self.stand_in = {b: c for c, b in byte_alphabet().items()}  # for str.translate
        self.pattern = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, character by character as the library has it."""
        if text.isascii():
            return text.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", text)])

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        return self.pattern.findall(self.normal(text))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: its bytes, the last with the end mark, merged by rank, leftmost first."""
        parts = [*word.decode("latin-1").translate(self.stand_in)]
        parts[-1] += self.suffix
        if len(parts) > 64:
            parts = self._merge_long(parts)
        else:
            get, none = self.ranks.get, len(self.ranks)
            ranks = [get(p, none) for p in zip(parts, parts[1:])]
            while ranks and (best := min(ranks)) != none:
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((parts[i - 1], parts[i]), none)
                if i < len(ranks):
                    ranks[i] = get((parts[i], parts[i + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a queue: n log n for words of any length."""
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(queue)
        alive: list[str | None] = list(parts)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if alive[i] != pair[0] or j < 0 or alive[j] != pair[1]:
                continue
            alive[i], alive[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (p := (alive[a], alive[after[a]])) in ranks:
                    heapq.heappush(queue, (ranks[p], a, p))
        return [p for p in alive if p is not None]

    def decode(self, ids: list[int]) -> str:
        """As the library does for a vocabulary without decoder: the tokens with a blank between them."""
        return " ".join([self.by_id[i] for i in ids if i in self.by_id])


class Encoder:
    """Encodes texts; words come from the lexicon if it has them. A result is (little-endian 32-bit ids, decoded UTF-8)."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None):
        self.bpe, self.lexicon = bpe, lexicon
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def word_results(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """The results of words that aren't kept: the lexicon's, or merged."""
        bpe, tokens = self.bpe, self.bpe.by_id
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        found = self.lexicon.numbers(data).tolist() if self.lexicon else [-1] * len(words)
        out = {}
        for w, b, n in zip(words, data, found):
            ids = self.lexicon.output(n) if n >= 0 else bpe.merge(b)
            out[w] = array("I", ids).tobytes(), " ".join([tokens[i] for i in ids]).encode()
        if len(self.words) < KEPT_WORDS:
            self.words |= out
        return out

    def piece_results(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """The results of pieces that aren't kept."""
        split = self.bpe.words
        parts = {p: ([low] if p.isascii() and (low := p.lower()).isalpha() else split(p)) for p in pieces}
        new = set().union(*parts.values()) - self.words.keys()
        known, new = self.words, self.word_results([*new])
        out = {}
        for piece, words in parts.items():
            done = [known.get(w) or new[w] for w in words]
            out[piece] = done[0] if len(done) == 1 else (b"".join([d[0] for d in done]), b" ".join([d[1] for d in done if d[0]]))
        if len(self.pieces) < KEPT_PIECES:
            self.pieces |= out
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The result of each text. The many small results hold no cycles, so the collector would only walk through them."""
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        divided = []
        for text in texts:
            runs = self.bpe.cut.split(text) if self.bpe.cut and "<|" in text else [text]
            divided.append([r if i % 2 else r.split(" ") for i, r in enumerate(runs)])
        known = self.pieces
        new = self.piece_results(set().union(*(r for runs in divided for r in runs if isinstance(r, list))) - known.keys())
        special, out = self.bpe.special, []
        get = known.get
        for runs in divided:
            found = []
            for r in runs:
                found += [get(p) or new[p] for p in r] if isinstance(r, list) else [(special[r].to_bytes(4, "little"), r.encode())]
            found = [f for f in found if f[0]]
            ids, decoded = zip(*found) if found else ((), ())
            out.append((b"".join(ids), b" ".join(decoded)))
        return out


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words of all texts, ``most`` at most; which ones are taken changes speed, never ids.

    How many words have which count tells the least count to take, so that no task ranks them all.
    """
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = stored(docs.select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where("n > 2"), "words")
    left, least = most, 3
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        left, least = left - row.words, row.n
        if left < 0:
            least += 1
            break
    return counts.where(F.col("n") >= least)


def frequent_lexicon(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> dict[str, np.ndarray]:
    """The transducer of the frequent words; at most ``most`` words reach the driver."""
    bpe = WordBpe(vocabulary)
    words = {w for r in frequent_words(docs, most).toLocalIterator() for w in bpe.words(r.word)}
    return compile_lexicon({w.encode(): bpe.merge(w.encode()) for w in words})


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(vocabulary: str | None, key: str, parts: dict[str, np.ndarray]) -> Encoder:
    """The worker's encoder; the lexicon's files lie in its temporary folder until they are mapped."""
    if (vocabulary, key) not in _ENCODERS:
        with tempfile.TemporaryDirectory(prefix="lexicon-") as folder:
            save(parts, folder)
            lexicon = Lexicon(folder)  # the mappings outlive the files' names
        _ENCODERS.clear()
        _ENCODERS[vocabulary, key] = Encoder(WordBpe(vocabulary or default_vocabulary()), lexicon)
    return _ENCODERS[vocabulary, key]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, binary) and decoded text of every row of ``docs`` (doc_id, text).

    Null texts are empty and have no ids. Repeated rows come out repeated; other columns aren't read; an
    empty table gives no rows. ``vocabulary`` is the path of the file on all machines; default: the public one.
    """
    checkpointing(docs.sparkSession)
    parts = frequent_lexicon(docs, vocabulary or default_vocabulary(), lexicon_words)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    key = hashlib.sha256(b"".join(parts[n].tobytes() for n in sorted(parts))).hexdigest()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = _encoder(vocabulary, key, shared.value).encode(texts_of(batch, "text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "doc_id long, ids binary, decoded string", work)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    rows = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
