"""Tandem repeats of word sequences in the manner of Gusfield and Stoye, and the runs that they make up.

For the texts of one slice at once, in arrays, as no text shares a symbol with another:

1. Words are numbered, and the numbers of 2, 4, 8 ... words in a row follow by doubling until every suffix has its own. They
   order the suffixes, and they answer longest-common-extension queries, forwards and backwards.
2. Each text is cut into its Lempel-Ziv blocks. The squares whose centre lies in a block and that reach over its end, or begin in it and centre on
   its own or the next block, are found with one pair of extension queries for each possible period; they cover the leftmost occurrence of every kind of square.
3. For texts that have any, the suffix tree is built from the suffixes' order. Each covering square is placed in it, and walks along suffix
   links turn it: from the place of ``aw`` to that of ``w`` and on by ``a``, until that is no place of the tree or a place that has been marked. The marks are the whole
   vocabulary of squares.
4. The leaves under a mark are where its square occurs. Occurrences of one period that begin at neighbouring words make up a run.

Only squares of primitive roots are taken, whose occurrences are O(n log n); a run of a smaller period holds the others.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

Run = tuple[int, int, int]


class _Numbers(dict):
    """Words by number, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Extensions:
    """Longest common extensions of positions in texts' symbols, by the numbers of their 1, 2, 4 ... symbols in a row; a text's end comes before all symbols.

    ``text`` has the number of each symbol's text; texts share no symbol.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray):
        self.levels = [self._padded(np.unique(symbols, return_inverse=True)[1] + 1)]
        self._of(text)

    def _of(self, text: np.ndarray) -> None:
        self.text, self.n = text, len(text)
        self.end = np.searchsorted(text, text, "right")

    def _padded(self, ranks: np.ndarray) -> np.ndarray:
        return np.append(ranks, 0)  # 0: the end

    @property
    def grams(self) -> np.ndarray:
        return self.levels[-1][: self.n]

    def double(self) -> None:
        """One more level: of twice as many symbols."""
        width, last = 1 << (len(self.levels) - 1), self.levels[-1]
        at = np.arange(width, self.n + width)
        ahead = np.where(at < self.end, last[np.minimum(at, self.n)], 0)
        self.levels.append(self._padded(np.unique(last[: self.n] * np.int64(self.n + 2) + ahead, return_inverse=True)[1] + 1))

    def only(self, keep: np.ndarray) -> None:
        """Goes on with the texts to keep."""
        self.levels = [self._padded(x[:-1][keep]) for x in self.levels]
        self._of(self.text[keep])

    def finish(self) -> None:
        """Levels until every suffix has its own number, from 1 to ``n`` in their order."""
        self.levels[-1] = self._padded(np.unique(self.grams, return_inverse=True)[1] + 1)
        while self.grams.max() < self.n:
            self.double()

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from i and j on; i and j differ."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols up to i and j, both included; none from before the first."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            fits = (a >= 0) & (b >= 0)
            step = (fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return begin - i


def previous_factors(order: list[int], common: list[int]) -> list[int]:
    """For each position the longest factor there that begins earlier too, from the suffixes' order and their common prefixes."""
    n = len(order)
    out, positions, lengths = [0] * n, [], []
    for r in range(n + 1):
        at, length = (order[r], common[r]) if r < n else (-1, 0)
        while positions:
            top, own = positions[-1], lengths[-1]
            if at < top:
                out[top] = own if own > length else length
                length = own if own < length else length
            elif length <= own:
                out[top] = own
            else:
                break
            positions.pop()
            lengths.pop()
        positions.append(at)
        lengths.append(length)
    return out


def blocks(factors: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, end of its text) of the Lempel-Ziv blocks of each text; ``starts`` has the texts' first positions and the end of all."""
    first, last = [], []
    for a, b in zip(starts, starts[1:]):
        while a < b:
            first.append(a)
            last.append(b)
            a += factors[a] or 1
    begin, text = np.array(first, np.int64), np.array(last, np.int64)
    return begin, np.minimum(np.append(begin[1:], starts[-1]), text), text


def covering(ext: Extensions, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the leftmost occurrence of every kind of square."""
    size = end - begin

    def each(most: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(of, most)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1

    def sides(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ext.forward(i, j), ext.backward(i - 1, j - 1)

    # the centre in the block, the right half over its end
    inner = np.flatnonzero(end < text)
    at, k = each(size[inner], inner)
    q = end[at] - k
    ahead, back = sides(q, end[at])
    ok = (ahead + back >= k) & (ahead > 0)
    found = [(np.maximum(q - back, q - k + 1)[ok], k[ok])]
    # the start in the block, the centre in it or the next one
    following = np.where(end < text, np.append(size[1:], 0), 0)
    most = np.minimum(size + following, text - begin - 1)
    at, k = each(most, np.arange(len(begin)))
    h = begin[at]
    ahead, back = sides(h, h + k)
    start = np.maximum(h - back, h - k + 1)
    ok = (ahead + back >= k) & (ahead > 0) & (back > 0) & (start + k <= end[at])
    found.append((start[ok], k[ok]))
    start, k = (np.concatenate(x) for x in zip(*found))
    if not len(start):
        return start, k
    both = np.unique(np.stack([start, k]), axis=1)
    return both[0], both[1]


def primitive(ext: Extensions, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the root of each square (start, period k) is no power of a shorter one."""
    least = np.arange(int(k.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own > p] = np.minimum(own[own > p], p)
    out, rest = np.ones(len(k), bool), k.copy()
    while (at := np.flatnonzero((rest > 1) & out)).size:
        p = least[rest[at]]
        shorter = k[at] // p
        out[at] = ext.forward(start[at], start[at] + shorter) < 2 * k[at] - shorter
        rest[at] //= p
    return out


class Tree:
    """The suffix tree of one text from its suffixes' ``order`` and their ``common`` prefixes.

    Inner nodes are numbered from 0, the root; the leaf of the suffix of rank r is ``inner`` + r.
    """

    def __init__(self, words: np.ndarray, order: np.ndarray, common: np.ndarray):
        self.words, self.order, self.n = words, order, len(words)
        self.rank = np.empty(self.n, np.int64)
        self.rank[order] = np.arange(self.n)
        self._nodes(common.tolist())
        self._minima(common)
        self._children()
        self._links()

    def _nodes(self, common: list[int]) -> None:
        depth, left, right, parent, stack, owner = [0], [0], [self.n - 1], [0], [0], [0] * self.n
        for r in range(1, self.n + 1):
            length, low, last = (common[r] if r < self.n else 0), r - 1, -1
            while length < depth[stack[-1]]:
                v = stack.pop()
                right[v], low = r - 1, left[v]
                if length <= depth[stack[-1]]:
                    parent[v] = stack[-1]
                else:
                    last = v
            if length > depth[stack[-1]]:
                v = len(depth)
                depth.append(length)
                left.append(low)
                right.append(0)
                parent.append(stack[-1])
                if last >= 0:
                    parent[last] = v
                stack.append(v)
            if r < self.n:
                owner[r] = stack[-1]
        self.inner = len(depth)
        ranks = np.arange(self.n)
        self.owner = np.array(owner)
        depths, after = np.array(depth), np.append(self.owner[1:], 0)
        above = np.where(depths[after] > depths[self.owner], after, self.owner)
        self.depth = np.concatenate([depths, self.n - self.order])
        self.left = np.concatenate([left, ranks])
        self.right = np.concatenate([right, ranks])
        self.parent = np.concatenate([parent, above])

    def _minima(self, common: np.ndarray) -> None:
        """Sparse table: the rank of the least common prefix in every 2^k in a row."""
        self.common, self.least = common, [np.arange(self.n)]
        while (width := 1 << len(self.least)) <= self.n:
            a, b = self.least[-1][: self.n - width + 1], self.least[-1][width // 2 : self.n - width // 2 + 1]
            self.least.append(np.where(common[b] < common[a], b, a))

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the least common prefix in a..b."""
        out = np.empty(len(a), np.int64)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            x, y = self.least[k][a[at]], self.least[k][b[at] - (1 << k) + 1]
            out[at] = np.where(self.common[y] < self.common[x], y, x)
        return out

    def _children(self) -> None:
        """Each node under its parent and the first word between them; a suffix that ends at its parent has none."""
        nodes = np.flatnonzero(self.depth > self.depth[self.parent])
        above = self.parent[nodes]
        self.width = int(self.words.max()) + 1
        keys = above * self.width + self.words[self.order[self.left[nodes]] + self.depth[above]]
        at = np.argsort(keys)
        self.child_keys, self.child_nodes = keys[at], nodes[at]

    def child(self, node: int, word: int) -> int:
        """The node that begins with ``word`` under ``node``; -1 if there is none."""
        key = node * self.width + word
        at = int(self.child_keys.searchsorted(key))
        return int(self.child_nodes[at]) if at < len(self.child_keys) and self.child_keys[at] == key else -1

    def _links(self) -> None:
        """Suffix links: two suffixes that part at a node part at its link when both lose their first word."""
        self.link = np.zeros(self.inner, np.int64)
        own = 1 + np.flatnonzero(self.depth[1 : self.inner] > 1)
        if len(own):
            parting = self._between(self.left[own] + 1, self.right[own])
            a, b = self.rank[self.order[parting - 1] + 1], self.rank[self.order[parting] + 1]
            self.link[own] = self.owner[self._between(a + 1, b)]

    def places(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The node at or right under the place of each string (start, length)."""
        low, high = self.rank[start].copy(), self.rank[start].copy()
        for k in range(len(self.least) - 1, -1, -1):
            width = 1 << k
            ok = high + width < self.n
            ok[ok] = self.common[self.least[k][high[ok] + 1]] >= length[ok]
            high[ok] += width
            ok = low - width >= 0
            ok[ok] = self.common[self.least[k][low[ok] - width + 1]] >= length[ok]
            low[ok] -= width
        out, wide = self.inner + low, high > low
        out[wide] = self.owner[self._between(low[wide] + 1, high[wide])]
        return out

    def turned(self, node: int, length: int) -> int:
        """The place of the square at ``node`` turned by a word; -1 if it doesn't occur."""
        at = int(self.order[self.left[node]])
        first, target, here = int(self.words[at]), length - 1, int(self.link[self.parent[node]])
        while (d := int(self.depth[here])) < target:
            here = self.child(here, int(self.words[at + 1 + d]))
        if d == target:
            return self.child(here, first)
        return here if self.words[self.order[self.left[here]] + target] == first else -1

    def vocabulary(self, start: np.ndarray, k: np.ndarray) -> list[tuple[int, int]]:
        """(node, period) of every square that turning those of (start, k) gives."""
        marked: set[tuple[int, int]] = set()
        for node, period in zip(self.places(start, 2 * k).tolist(), k.tolist()):
            while node >= 0 and (node, period) not in marked:
                marked.add((node, period))
                node = self.turned(node, 2 * period)
        return sorted(marked)


def merged(tree: Tree, marks: list[tuple[int, int]], least: int, exponent: int) -> list[Run]:
    """The runs that the marked squares' occurrences make up, of ``least`` words and ``exponent`` periods at least."""
    node, period = (np.array(x, np.int64) for x in zip(*marks))
    low, count = tree.left[node], tree.right[node] - tree.left[node] + 1
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    start, period = tree.order[at], np.repeat(period, count)
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    cut = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, q = start[cut], period[cut]
    length = start[np.append(cut[1:], len(start)) - 1] - first + 2 * q
    ok = length >= np.maximum(least, exponent * q)
    return sorted(zip(first[ok].tolist(), length[ok].tolist(), q[ok].tolist()), key=lambda run: (run[0], run[2]))


def shortest_copy(least: int, exponent: int) -> int:
    """Words that a run shares at least with itself, one period on."""
    return min(max((exponent - 1) * q, least - q) for q in range(1, least + 1))


def runs_of(texts: list[list[bytes]], least: int = 6, exponent: int = 4) -> list[list[Run]]:
    """For each text, a list of words, its runs (start, length, smallest period) by start and period.

    A run is a stretch with a smallest period q, of ``least`` words and ``exponent`` * q at least, that no neighbouring word extends; exponents of 2 and more are found.
    """
    if exponent < 2:
        raise ValueError("runs repeat their period twice at least")
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    number = _Numbers()
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    ext = Extensions(text * len(number) + words, text)
    # texts in which no so many words in a row come twice have no run
    for _ in range(shortest_copy(least, exponent).bit_length() - 1):
        ext.double()
    again = np.bincount(ext.grams)[ext.grams] > 1
    keep = np.isin(text, np.unique(text[again]))
    if not keep.any():
        return out
    ext.only(keep)
    words, text = words[keep], ext.text
    ext.finish()

    order = np.empty(ext.n, np.int64)
    order[ext.grams - 1] = np.arange(ext.n)
    common = np.zeros(ext.n, np.int64)
    common[1:] = ext.forward(order[:-1], order[1:])
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
    start, k = covering(ext, *blocks(previous_factors(order.tolist(), common.tolist()), starts.tolist()))
    ok = primitive(ext, start, k)
    start, k = start[ok], k[ok]
    own = np.searchsorted(starts, start, "right") - 1
    for i in np.unique(own).tolist():
        a, b = int(starts[i]), int(starts[i + 1])
        at = own == i if len(starts) == 2 else slice(*np.searchsorted(own, [i, i + 1]))
        tree = Tree(words[a:b], order[a:b] - a, common[a:b])
        out[int(text[a])] = merged(tree, tree.vocabulary(start[at] - a, k[at]), least, exponent)
    return out
