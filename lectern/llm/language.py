"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on stretches of bytes from a
bounded sample of labelled texts (``SAMPLE`` a language, ``STRETCHES`` a text). A text is read in stretches of ``STEPS``
bytes, both ways; every byte gets a probability for each language, and the text the mean of them. Prediction is one
pass inside the tasks that read the texts; the weights that they share are some kilobytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, texts_of

#: Bytes that the network reads in one go.
STEPS = 64
UNITS = 12
#: Labelled texts for each language in the training sample, on average; also the bound on what training sees.
SAMPLE = 400
STRETCHES = 12
EPOCHS = 6
BATCH = 256
RATE = 0.02
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def start_weights(classes: int, units: int = UNITS, seed: int = 11) -> dict[str, np.ndarray]:
    """x: what each byte adds to the update gate, reset gate and candidate; h: what the state adds; o, b: to the classes. First axis: direction."""
    r = np.random.default_rng(seed)
    return {
        "x": r.normal(0, 0.3, (2, 3 * units, 256)).astype(np.float32),
        "h": r.normal(0, 0.3, (2, 3 * units, units)).astype(np.float32),
        "o": r.normal(0, 0.3, (2, classes, units)).astype(np.float32),
        "b": np.zeros(classes, np.float32),
    }


def _gate(a: np.ndarray) -> np.ndarray:
    """A piecewise linear sigmoid."""
    a *= 0.25
    a += 0.5
    return np.clip(a, 0, 1, out=a)


def run_states(weights: dict[str, np.ndarray], data: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States (direction, step, unit, stretch) for ``data`` (step, stretch); ``mask`` is 0 behind a stretch's end."""
    steps, n = data.shape
    units = weights["h"].shape[2]
    out = np.empty((2, steps, units, n), np.float32)
    for d in range(2):
        x, u = weights["x"][d], weights["h"][d]
        state = np.zeros((units, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            given = x.take(data[t], axis=1)
            own = u @ state
            gates = _gate(given[: 2 * units] + own[: 2 * units])
            update, reset = gates[:units], gates[units:]
            candidate = np.tanh(given[2 * units :] + reset * own[2 * units :])
            new = candidate - state
            new *= update
            new += state
            if mask is not None:
                new *= mask[t]
            if keep is not None:
                keep.append((d, t, state, gates, candidate, own[2 * units :]))
            state = new
            out[d, t] = new
    return out


def position_probabilities(weights: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """Probabilities (step, class, stretch)."""
    logits = weights["o"][0] @ states[0] + weights["o"][1] @ states[1] + weights["b"][:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(weights: dict[str, np.ndarray], data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions, and its gradient by backpropagation through time."""
    kept: list = []
    states = run_states(weights, data, mask, kept)
    p = position_probabilities(weights, states)
    n, total = data.shape[1], mask.sum()
    loss = float(-(np.log(p[:, label, np.arange(n)] + 1e-9) * mask).sum() / total)
    p[:, label, np.arange(n)] -= 1
    p *= (mask / total)[:, None, :]
    grad = {k: np.zeros_like(v) for k, v in weights.items()}
    grad["b"] = p.sum(axis=(0, 2))
    units = weights["h"].shape[2]
    back = [np.zeros((units, n), np.float32) for _ in range(2)]
    for d in range(2):
        grad["o"][d] = np.einsum("tcn,tun->cu", p, states[d], optimize=True)
    for d, t, state, gates, candidate, own in reversed(kept):
        g = (back[d] + weights["o"][d].T @ p[t]) * mask[t]
        update, reset = gates[:units], gates[units:]
        inner = g * update * (1 - candidate**2)
        linear = 0.25 * ((gates > 0) & (gates < 1))
        a = np.concatenate([g * (candidate - state) * linear[:units], inner * own * linear[units:], inner])
        by_state = np.concatenate([a[: 2 * units], inner * reset])
        grad["h"][d] += by_state @ state.T
        back[d] = g * (1 - update) + weights["h"][d].T @ by_state
        onehot = np.zeros((n, 256), np.float32)
        onehot[np.arange(n), data[t]] = 1
        grad["x"][d] += a @ onehot
    return loss, grad


def stretches_of(data: bytes, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, step) bytes and each stretch's length; the last may be shorter."""
    n = -(-len(data) // steps)
    flat = np.zeros(n * steps, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    size = np.full(n, steps)
    if n:
        size[-1] = len(data) - (n - 1) * steps
    return flat.reshape(n, steps), size


def train(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = 5) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and weights from (language, stretch of bytes) pairs; always the same for the same pairs."""
    languages = sorted({lang for lang, _ in samples})
    samples = sorted(samples)
    data = np.zeros((len(samples), STEPS), np.uint8)
    mask = np.zeros((len(samples), STEPS), np.float32)
    for i, (_, s) in enumerate(samples):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
        mask[i, : len(s)] = 1
    label = np.array([languages.index(lang) for lang, _ in samples])
    weights = start_weights(len(languages))
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    rounds = epochs * -(-len(samples) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(samples))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            _, grad = gradients(weights, data[at].T, mask[at].T, label[at])
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - step / (rounds + 1))
            for k, g in grad.items():
                g = g / max(1.0, size)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                weights[k] = (weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return languages, weights


def document_probabilities(weights: dict[str, np.ndarray], texts: list[bytes], block: int = 2048) -> np.ndarray:
    """(text, class): the mean over all bytes; zeros for an empty text."""
    parts = [stretches_of(t) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(p[1]) for p in parts])
    classes = len(weights["b"])
    total = np.zeros((len(texts), classes))
    if not len(of):
        return total
    data, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    whole = np.flatnonzero(size == STEPS)
    short = np.flatnonzero(size < STEPS)
    for rows in (whole, short):
        for a in range(0, len(rows), block):
            at = rows[a : a + block]
            mask = None if rows is whole else (np.arange(STEPS)[:, None] < size[at]).astype(np.float32)
            p = position_probabilities(weights, run_states(weights, np.ascontiguousarray(data[at].T), mask))
            sums = p.sum(axis=0) if mask is None else (p * mask[:, None, :]).sum(axis=0)
            for c in range(classes):
                total[:, c] += np.bincount(of[at], sums[c], len(texts))
    return total / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def training_pairs(labelled: DataFrame, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, stretch) pairs of about ``sample`` texts for each language, chosen by a hash of doc_id; at most ``STRETCHES`` from a text, spread over it."""
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts:
        return []
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in counts.items()], "lang string, share double")
    share = F.col("share")
    # one row for each language
    chosen = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, cuts = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text")):
            data = text.encode("utf-8", "replace")
            n = -(-len(data) // STEPS)
            for i in sorted({round(k * (n - 1) / (STRETCHES - 1)) for k in range(STRETCHES)}) if n else []:
                langs.append(lang)
                cuts.append(data[i * STEPS : (i + 1) * STEPS])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cuts, pa.binary())], ["lang", "data"])

    return [(r.lang, bytes(r.data)) for r in map_texts(chosen.select("lang", "text"), "text", "lang string, data binary", work).toLocalIterator()]


def predict_language(docs: DataFrame, languages: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score (the probability of lang_pred); only its text is looked at.

    Texts that are null or have no letter are ``und`` with score 0. All columns of ``docs`` are kept but for earlier ones
    of these two names; repeated rows come out repeated, an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, batch.schema.names[text_at])
        lettered = np.array([bool(LETTER.search(t)) for t in texts])
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if languages:
            p = document_probabilities(weights, [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, lettered)])
            best = p.argmax(axis=1)
            score = np.where(lettered, np.clip(p.max(axis=1), 0, 1), 0)
        named = [languages[b] if ok and languages else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return map_texts(docs, "text", schema, work, 1 << 20)


def held_out() -> Column:
    """Documents that training doesn't see."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def train_language(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """The model from the documents that are not held out; no languages if none is labelled."""
    pairs = training_pairs(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return train(pairs) if pairs else ([], {})


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = predict_language(docs.select("doc_id", "text"), *train_language(docs))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
