"""Toxicity of whole texts by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings, hashed into ``BUCKETS``. Besides a weight,
each bucket has a short vector; the product of two vectors is what the two terms say together, such as an insult
and the group it is meant for. It is trained here, in numpy, on a bounded sample of labelled texts (``SAMPLE`` of each
label); prediction is one pass inside the tasks that read the texts.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, texts_of

BUCKETS = 1 << 18
FACTORS = 4
#: Labelled texts of each label in the training sample, on average; also the bound on what training sees.
SAMPLE = {1: 3000, 0: 6000}
#: Distinct terms that training takes from a text at most, spread over its terms by their hashes.
TRAINED_TERMS = 4000
EPOCHS = 40
BATCH = 128
RATE = 0.1
DECAY = 1e-4
#: Texts in which a term must occur in training to count.
LEAST = 4
#: Least chi-squared (one degree of freedom) between a term and the label for the term to be learned for its own sake; others
#: would add up to noise in long texts.
TELLING = 20.0
#: Terms, the most frequent of training, whose pairs are looked at too; least chi-squared between a pair and the label for both of
#: its terms to be learned, whatever each says alone. It is higher, as there are so many pairs.
PAIRED, TELLING_PAIR = 2000, 45.0
BEGINNING = 4
WORD = re.compile(r"[^\W_]+")
_KEPT: dict[str, tuple[int, ...]] = {}


def _buckets(word: str) -> tuple[int, ...]:
    own = crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    if len(word) <= BEGINNING:
        return (own,)
    return own, crc32(("^" + word[:BEGINNING]).encode("utf-8", "surrogatepass")) % BUCKETS


def term_buckets(text: str) -> np.ndarray:
    """The sorted buckets of a text's terms."""
    if len(_KEPT) > 200_000:
        _KEPT.clear()
    found: set[int] = set()
    for word in set(WORD.findall(text.lower())):
        b = _KEPT.get(word)
        if b is None:
            b = _KEPT[word] = _buckets(word)
        found.update(b)
    return np.sort(np.fromiter(found, np.int32, len(found)))


class Machine:
    """Bias, weights by bucket and vectors by bucket."""

    def __init__(self, bias: float, weight: np.ndarray, vector: np.ndarray):
        self.bias, self.weight, self.vector = bias, weight, vector

    def raw(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each text, whose buckets lie in ``flat`` from its start on; and the texts' vector sums."""
        n = np.diff(np.append(starts, len(flat)))
        own = np.repeat(np.arange(len(starts)), n)
        linear = np.bincount(own, self.weight[flat], len(starts))
        v = self.vector[flat]
        sums = np.stack([np.bincount(own, v[:, k], len(starts)) for k in range(v.shape[1])], axis=1)
        squares = np.bincount(own, (v * v).sum(axis=1), len(starts))
        pairs = ((sums**2).sum(axis=1) - squares) / 2
        return self.bias + linear + pairs, sums

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that a text is toxic; the bias alone for a text without terms."""
        parts = [term_buckets(t) for t in texts]
        sizes = [len(p) for p in parts]
        if not texts:
            return np.zeros(0)
        z, _ = self.raw(np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _chi_squared(toxic: np.ndarray, count: np.ndarray, share: float, texts: int) -> np.ndarray:
    """Between the label and what is in ``count`` texts, ``toxic`` of them toxic; ``share`` of all ``texts`` are."""
    expected = count * share
    return (toxic - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - count / texts), 1e-9)


def telling_pairs(samples: list[tuple[int, np.ndarray]], count: np.ndarray) -> np.ndarray:
    """The buckets that belong to a telling pair."""
    chosen = np.argsort(-count, kind="stable")[:PAIRED]
    chosen = chosen[count[chosen] >= LEAST]
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    holds = np.zeros((len(samples), len(chosen)), np.float32)
    for row, (_, buckets) in zip(holds, samples):
        at = column[buckets]
        row[at[at >= 0]] = 1
    label = np.array([s[0] for s in samples], bool)
    both, toxic = holds.T @ holds, holds[label].T @ holds[label]
    found = (both >= LEAST) & (_chi_squared(toxic, both, label.mean(), len(samples)) >= TELLING_PAIR)
    np.fill_diagonal(found, False)
    # a pair that says no more than one of its terms alone tells nothing new
    own = np.diag(_chi_squared(toxic, both, label.mean(), len(samples)))
    found &= np.maximum(own[:, None], own[None, :]) < TELLING
    return chosen[found.any(axis=0)]


def train(samples: list[tuple[int, np.ndarray]], prior: float, seed: int = 7) -> Machine:
    """A machine from (label, buckets) pairs; ``prior`` is the share of label 1 where the machine will be used."""
    label = np.array([s[0] for s in samples], np.float64)
    count = np.bincount(np.concatenate([s[1] for s in samples]), minlength=BUCKETS)
    toxic = np.bincount(np.concatenate([s[1] for s in samples if s[0] == 1]), minlength=BUCKETS)
    used = (count >= LEAST) & (_chi_squared(toxic, count, label.mean(), len(samples)) >= TELLING)
    used[telling_pairs(samples, count)] = True
    parts = [s[1][used[s[1]]] for s in samples]
    r = np.random.default_rng(seed)
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32), np.where(used[:, None], r.normal(0, 0.01, (BUCKETS, FACTORS)), 0).astype(np.float32))
    square_w, square_v, square_b = np.full(BUCKETS, 1e-2, np.float32), np.full((BUCKETS, FACTORS), 1e-2, np.float32), 1.0
    for _ in range(EPOCHS):
        order = r.permutation(len(samples))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            own = [parts[i] for i in at]
            n = np.array([len(p) for p in own])
            if not n.sum():
                continue
            flat = np.concatenate(own)
            z, sums = m.raw(flat, np.concatenate([[0], np.cumsum(n)[:-1]]))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[at]) / len(at)
            row = np.repeat(np.arange(len(at)), n)
            keys, inverse = np.unique(flat, return_inverse=True)
            gw = np.bincount(inverse, g[row]) + DECAY * m.weight[keys]
            v = m.vector[flat]
            gv = np.stack([np.bincount(inverse, g[row] * (sums[row, k] - v[:, k])) for k in range(FACTORS)], axis=1) + DECAY * m.vector[keys]
            square_w[keys] += gw**2
            square_v[keys] += gv**2
            square_b += g.sum() ** 2
            m.weight[keys] -= RATE * gw / np.sqrt(square_w[keys])
            m.vector[keys] -= RATE * 0.2 * gv / np.sqrt(square_v[keys])
            m.bias -= RATE * g.sum() / np.sqrt(square_b)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    m.bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return m


def held_out() -> Column:
    """Documents whose labels training doesn't see."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Machine | None:
    """The machine from the labelled documents that are not held out; None without any of either label."""
    sample = sample or SAMPLE
    labels = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("toxic") == 1, sample[1] / counts[1]).otherwise(sample[0] / counts[0])
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < share * (1 << 30))
    # by the sample's bound, its rows are few enough to send to all tasks
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for b in map(term_buckets, texts_of(batch, "text")):
            if len(b) > TRAINED_TERMS:
                b = b[np.argsort((b.astype(np.uint32) * np.uint32(2654435761)), kind="stable")[:TRAINED_TERMS]]
            parts.append(b.astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(parts, pa.binary())], ["doc_id", "toxic", "buckets"])

    rows = [(r.doc_id, r.toxic, bytes(r.buckets)) for r in map_texts(texts, "text", "doc_id long, toxic int, buckets binary", work).toLocalIterator()]
    pairs = [(y, np.frombuffer(b, "<i4")) for _, y, b in sorted(rows)]
    return train(pairs, counts[1] / (counts[0] + counts[1])) if {p[0] for p in pairs} == {0, 1} else None


def score_toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted; only its text is looked at.

    Null texts are empty; a text without terms gets the machine's bias; without a machine all scores are 0. All
    columns are kept but for earlier ones of these two names; repeated rows come out repeated.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "text")
        score = shared.value.score(texts) if shared.value else np.zeros(len(texts))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return map_texts(docs, "text", schema, work)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = score_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
