"""A minimal acyclic transducer: words in, runs of ids out, held in flat arrays that can be memory-mapped.

Words are added in byte order and states with the same right language are shared as soon as they can't
change any more. Each arc holds how many words lie before it among its state's arcs, so that the sum along
a path numbers the words without a table of them; that number points to the word's ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np

PARTS = ("keys", "targets", "skips", "final", "starts", "ids")


def compile_lexicon(words: dict[bytes, Sequence[int]]) -> dict[str, np.ndarray]:
    """The arrays of the automaton that maps each of ``words`` to its ids.

    keys: state * 256 + byte, ascending, one for each arc; targets and skips: the arc's target state and its count of
    earlier words; final: states in which a word ends; starts: where the ids of word number i begin in ids.
    """
    final: list[bool] = [False]
    arcs: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path = [0]  # states along the last word
    last = b""

    def freeze(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same
                if state == len(arcs) - 1:  # the newest state leaves no gap
                    arcs.pop()
                    final.pop()

    ordered = sorted(words)
    for word in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        freeze(common)
        for b in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    freeze(0)

    below: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [t for t in arcs[s].values() if t not in below]
        if todo:
            stack += todo
        else:
            below[s] = int(final[s]) + sum(below[t] for t in arcs[s].values())
            stack.pop()
    keys, targets, skips = [], [], []
    for s in sorted(below):
        before = int(final[s])
        for b, t in sorted(arcs[s].items()):
            keys.append(s * 256 + b)
            targets.append(t)
            skips.append(before)
            before += below[t]
    sizes = [len(words[w]) for w in ordered]
    return {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int32),
        "skips": np.array(skips, np.int32),
        "final": np.array(final, np.bool_),
        "starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        "ids": np.array([i for w in ordered for i in words[w]], np.uint32),
    }


def save(parts: dict[str, np.ndarray], folder: str) -> None:
    """One file for each array."""
    for name in PARTS:
        np.save(Path(folder) / f"{name}.npy", parts[name])


class Lexicon:
    """Looks up many words at once, each step of the walk for all of them together."""

    def __init__(self, folder: str):
        parts = {n: np.load(Path(folder) / f"{n}.npy", mmap_mode="r") for n in PARTS}
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = (parts[n].view(np.ndarray) for n in PARTS)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1 where the automaton doesn't hold it."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            key = state[live] * 256 + data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            number[live] += self.skips[at]
            step += 1
            live = live[size[live] > step]
        out = np.full(n, -1, np.int64)
        ended = np.flatnonzero(state >= 0)
        ended = ended[np.asarray(self.final)[state[ended]]]
        out[ended] = number[ended]
        return out

    def output(self, number: int) -> list[int]:
        """The ids of word ``number``."""
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()
