"""Texts in overlapping windows that end at the coarsest separators that will do.

A text is cut behind no separator that is finer than needed: by blank lines first; a piece that is still too long by lines, then by blanks, and at last anywhere. Each
separator stays at the head of the piece behind it, so pieces of one cut lie side by side, and a window is a stretch of the text. Windows take
pieces while they have room; the next one goes back over whole pieces of up to the overlap. A piece that had to be cut further has windows of its own.

All of it is folds over one row's arrays, of positions only: nothing is shuffled, no text is copied before the windows are cut out, and the work grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.folds import everything, folded, gathered, gathered_all, using
from lectern.functions.scalars import bound, text_of

SEPARATORS = ("\n\n", "\n", " ")
SIZE, OVERLAP = 1500, 300
SPAN = "struct<at:int,n:int>"
#: What is left out at a window's ends.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def _span(at: Column, n: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"))


def _anywhere(base: Column, length: Column, size: int, overlap: int) -> Column:
    """Windows of characters: full ones, each ``overlap`` behind the start of the next."""
    step = size - overlap
    more = F.ceil(F.greatest(length - size, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda i: _span(base + i * step, F.least(F.lit(size), length - i * step)))


def _spans(text: Column, base: Column, separators: tuple[str, ...], size: int, overlap: int) -> Column:
    """The windows (at, n: from ``base`` on) of a text by the first of the ``separators``, the others for longer pieces."""
    if not separators:
        return _anywhere(base, F.length(text), size, overlap)
    first, finer = separators[0], separators[1:]

    def windows(pieces: Column) -> Column:
        """``pieces`` of the text in order, each with its separator."""
        lengths = F.transform(pieces, lambda p: F.length(p))
        return bound(lengths, lambda ns: joined(pieces, ns))

    def joined(pieces: Column, ns: Column) -> Column:
        start = {"i": F.lit(0), "end": base, "first": F.lit(0), "total": F.lit(0)}

        def closed(s: Column) -> Column:
            """What is held with the window that is open, if it has pieces."""
            return F.when(s["i"] > s["first"], gathered(s["held"], _span(s["end"] - s["total"], s["total"]))).otherwise(s["held"])

        def state(held: Column, s: Column, n: Column, first_: Column, total: Column) -> Column:
            return F.struct(held.alias("held"), (s["i"] + 1).alias("i"), (s["end"] + n).alias("end"), first_.cast("int").alias("first"), total.cast("int").alias("total"))

        def kept(s: Column, n: Column) -> Column:
            """(first, total) of the last pieces of the open window that fit the overlap and leave room for ``n`` more."""
            own = F.slice(ns, s["first"] + 1, s["i"] - s["first"])
            fits = lambda total: (total <= overlap) & (total + n <= size)
            drop = lambda x, m: F.when(fits(x["total"]), x).otherwise(F.struct((x["first"] + 1).alias("first"), (x["total"] - m).alias("total")))
            return F.aggregate(own, F.struct(s["first"].alias("first"), s["total"].alias("total")), drop)

        def add(s: Column, piece: Column) -> Column:
            def of_length(s: Column, n: Column) -> Column:
                long = state(gathered_all(closed(s), _spans(piece, s["end"], finer, size, overlap)), s, n, s["i"] + 1, F.lit(0))
                joins = state(s["held"], s, n, s["first"], s["total"] + n)
                full = using(s, kept(s, n), lambda s, k: state(closed(s), s, n, k["first"], k["total"] + n))
                return F.when(n >= size, long).when(s["total"] + n <= size, joins).otherwise(full)

            return using(s, F.length(piece), of_length)

        return folded(pieces, SPAN, start, add, lambda s: everything(closed(s)))

    def headed(parts: Column) -> Column:
        own = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(first), p)))
        return F.filter(own, lambda p: p != "")

    return bound(headed(F.split(text, f"\\Q{first}\\E")), windows)


def recursive_spans(text: Column, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of struct (at, n): where the windows of a text lie, in characters from 0, before blanks at their ends are left out."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is less than the size")
    return bound(text_of(text), lambda t: _spans(t, F.lit(0), separators, size, overlap))


def recursive_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of the windows of a text without blanks at their ends; those of blanks alone are left out, so an empty text has none."""
    trimmed: Callable[[Column], Column] = lambda w: F.regexp_replace(w, f"^{BLANK}|{BLANK}$", "")
    cut = lambda t: F.transform(_spans(t, F.lit(0), separators, size, overlap), lambda s: trimmed(F.substring(t, s["at"] + 1, s["n"])))
    if not 0 <= overlap < size:
        raise ValueError("the overlap is less than the size")
    return F.filter(bound(text_of(text), cut), lambda w: w != "")


def split_documents(docs: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``keys``, at (number of the window in its text) and part of all windows of the texts of ``docs``."""
    return docs.select(*keys, F.posexplode(recursive_windows(F.col(text), size, overlap)).alias("at", "part")).select(*keys, F.col("at").cast("int"), "part")
