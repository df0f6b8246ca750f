"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last suffix counts as smaller."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    step[-1] = 1
    # equal neighbours take the type of what follows the run
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def _wave(sa: np.ndarray, text: np.ndarray, place: np.ndarray, source: np.ndarray, up: bool) -> None:
    """Puts ``source`` into its characters' buckets at ``place``, in order; place moves up or down."""
    chars = text[source]
    order = np.argsort(chars, kind="stable")
    ordered = chars[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(first, len(ordered)))
    within = np.arange(len(ordered)) - np.repeat(first, counts)
    keys = ordered[first]
    sa[np.repeat(place[keys], counts) + (within if up else -within)] = source[order]
    place[keys] += counts if up else -counts


def _induce_waves(text: np.ndarray, smaller: np.ndarray, heads: np.ndarray, tails: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order from sorted leftmost-smaller ones, bucket by bucket: what a stretch of a bucket induces is placed at once."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    seed_chars = text[seeds]
    seed_at = np.searchsorted(seed_chars, np.arange(len(heads) + 1))
    place = heads.copy()
    for c in range(len(heads)):
        done = heads[c]
        while done < place[c]:  # larger suffixes of this bucket may induce more of them
            part = sa[done : place[c]]
            done = place[c]
            part = part[part > 0] - 1
            part = part[~smaller[part]]
            if len(part):
                _wave(sa, text, place, part, True)
        part = seeds[seed_at[c] : seed_at[c + 1]]
        part = part[part > 0] - 1
        part = part[~smaller[part]]
        if len(part):
            _wave(sa, text, place, part, True)
    larger_end = place.copy()
    place = tails - 1
    for c in range(len(heads) - 1, -1, -1):
        done = tails[c] - 1
        while done > place[c]:
            part = sa[place[c] + 1 : done + 1][::-1]
            done = place[c]
            part = part[part > 0] - 1
            part = part[smaller[part]]
            if len(part):
                _wave(sa, text, place, part, False)
        part = sa[heads[c] : larger_end[c]][::-1]
        part = part[part > 0] - 1
        part = part[smaller[part]]
        if len(part):
            _wave(sa, text, place, part, False)
    sa[0] = n - 1
    return sa


def _stepper(text: np.ndarray, smaller: np.ndarray, heads: np.ndarray, tails: np.ndarray):
    """The same one suffix at a time, for alphabets so large that buckets hold few suffixes; a function of the seeds."""
    n = len(text)
    before = np.append(text[-1:], text[:-1])
    # by suffix: the character before it if that is of the larger (smaller) kind, else -1; the last entry is for empty places
    kind = np.append(smaller[-1:], smaller[:-1])
    kind[0] = False
    larger_before = np.append(np.where(kind | (np.arange(n) == 0), -1, before), -1).tolist()
    smaller_before = np.append(np.where(kind, before, -1), -1).tolist()
    first, last, own = heads.tolist(), tails.tolist(), text.tolist()

    def induce(seeds: np.ndarray) -> np.ndarray:
        sa, place = [n] * n, last[:]
        for s in seeds[::-1].tolist():
            c = own[s]
            place[c] -= 1
            sa[place[c]] = s
        place = first[:]
        for j in sa:
            c = larger_before[j]
            if c >= 0:
                sa[place[c]] = j - 1
                place[c] += 1
        place = last[:]
        for j in reversed(sa):
            c = smaller_before[j]
            if c >= 0:
                place[c] = p = place[c] - 1
                sa[p] = j - 1
        return np.array(sa, np.int64)

    return induce


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; its last value must be 0 and the only 0.

    Leftmost-smaller substrings are sorted by inducing from their first characters and named; where names repeat,
    the names' own suffix array (recursively) orders them, and from that order all suffixes are induced.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(text)
    sizes = np.bincount(text)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(sizes) <= 1024:
        induce = lambda seeds: _induce_waves(text, smaller, heads, tails, seeds)
    else:
        induce = _stepper(text, smaller, heads, tails)
    by_char = left[np.argsort(text[left], kind="stable")]
    if len(left) == 1:
        return induce(by_char)
    first = induce(by_char)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    ordered = first[is_left[first]]
    names = _names(text, smaller, left, ordered)
    reduced = names[left]
    if reduced.max() + 1 < len(left):
        order = suffix_array(reduced)
    else:
        order = np.argsort(reduced)
    return induce(left[order])


def _names(text: np.ndarray, smaller: np.ndarray, left: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Name of each leftmost-smaller substring by its rank; equal substrings share one. Indexed by start."""
    end = np.zeros(len(text), np.int64)
    end[left[:-1]] = left[1:]
    end[left[-1]] = left[-1]
    a, b = ordered[:-1], ordered[1:]
    length = end[a] - a
    same = length == end[b] - b
    live = np.flatnonzero(same)
    step = 0
    while len(live):  # compares all neighbours one character further
        ok = (text[a[live] + step] == text[b[live] + step]) & (smaller[a[live] + step] == smaller[b[live] + step])
        same[live[~ok]] = False
        live = live[ok]
        live = live[length[live] > step]
        step += 1
    out = np.zeros(len(text), np.int64)
    out[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return out


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, before): by text position, what its suffix shares with the suffix before it in ``sa``, and that suffix's start (-1: none).

    Nothing beyond ``room`` (characters from a position to its part's end) counts. Only irreducible values are
    compared; each other value is one less than its left neighbour's.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    prior = np.where(before > 0, before - 1, 0)
    start = np.ones(n, bool)
    start[1:] = (before[1:] <= 0) | (text[:-1] != text[prior[1:]]) | (room[:-1] == 0)
    start[0] = True
    live = np.flatnonzero(start & (before >= 0))
    limit = np.zeros(n, np.int64)
    limit[live] = np.minimum(room[live], n - np.maximum(live, before[live]))
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    shared = np.zeros(n, np.int64)
    live = live[limit[live] > 0]
    while len(live):
        at = shared[live]
        wide = np.ones(len(live), bool)
        for k in range(8):
            wide &= (at + k < limit[live]) & (padded[np.minimum(live + at + k, n)] == padded[np.minimum(before[live] + at + k, n)])
            shared[live] += wide
        live = live[wide]
    origin = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    plcp = np.maximum(shared[origin] - (np.arange(n) - origin), 0)
    plcp[before < 0] = 0
    return np.minimum(plcp, room), before
