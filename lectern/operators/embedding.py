"""Texts to vectors behind a seam: any model that takes a list of texts, made once in a worker, with another in its place where it can't be made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What a provider makes: texts in, one vector for each out.
Model = Callable[[list[str]], list[list[float]]]
#: Texts that a model gets at a time.
BATCH = 64
DIMENSIONS = 16
VECTORS = "embedding array<double>, provider string"


def letter_model() -> Model:
    """A model without weights: how many of a text's characters have each remainder of their code by ``DIMENSIONS``. Not normalised."""

    def vectors(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            own = [0.0] * DIMENSIONS
            for c in text:
                own[ord(c) % DIMENSIONS] += 1
            out.append(own)
        return out

    return vectors


#: Providers by name. Those with weights, or that ask a server, are passed by the caller.
PROVIDERS: dict[str, Callable[[], Model]] = {"letters": letter_model}
_made: dict[tuple[str, ...], tuple[str, Model]] = {}


def model_of(names: list[str], providers: dict[str, Callable[[], Model]]) -> tuple[str, Model]:
    """The first of the named providers that can be made, and its model; one for each worker."""
    key = tuple(names)
    if key not in _made:
        problems = []
        for name in names:
            try:
                _made[key] = name, providers[name]()
                break
            except Exception as problem:  # a library or server that isn't there: the next one's turn
                problems.append(f"{name}: {problem or type(problem).__name__}")
        else:
            raise RuntimeError("no provider can be made (" + "; ".join(problems) + ")")
    return _made[key]


def embedded(rows: DataFrame, names: list[str], text: str = "text", batch: int = BATCH, providers: dict[str, Callable[[], Model]] | None = None) -> DataFrame:
    """``rows`` with embedding and provider: the first provider of ``names`` that can be made in the worker.

    A model gets ``batch`` texts at a time, gathered over the frames that Spark hands over, so that small frames fill batches too. Null is the empty text. No rows make no model.
    """
    providers = PROVIDERS if providers is None else providers
    columns = rows.columns

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        name, model = model_of(names, providers)
        vectors = model([t if isinstance(t, str) else "" for t in frame[text]])
        if len(vectors) != len(frame):
            raise ValueError(f"{name} gave {len(vectors)} vectors for {len(frame)} texts")
        return frame.assign(embedding=[list(map(float, v)) for v in vectors], provider=name)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held = 0
        for frame in frames:
            waiting.append(frame)
            held += len(frame)
            if held >= batch:
                joined = pd.concat(waiting, ignore_index=True)
                whole = held - held % batch
                for a in range(0, whole, batch):
                    yield made(joined.iloc[a : a + batch])
                waiting, held = [joined.iloc[whole:]], held - whole
        if held:
            yield made(pd.concat(waiting, ignore_index=True))

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.select(*columns).mapInPandas(work, f"{types}, {VECTORS}")
