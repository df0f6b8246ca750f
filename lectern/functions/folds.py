"""Folds over a row's array that gather a list, with work that grows with the array.

``aggregate`` copies its whole state at each step, so a fold that holds all it has gathered costs the square of its length. ``folded`` takes the array in blocks of ``BLOCK``: within a block
the state holds only what that block gathered, and only once a block is that put behind the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def nothing(kind: str) -> Column:
    """The empty gathering of values of the SQL type ``kind``."""
    return F.expr(f"named_struct('parts', cast(array() as array<array<{kind}>>), 'short', cast(array() as array<{kind}>))")


def gathered(held: Column, value: Column) -> Column:
    """``held`` with ``value`` behind it."""
    return F.struct(held["parts"].alias("parts"), F.array_append(held["short"], value).alias("short"))


def gathered_all(held: Column, values: Column) -> Column:
    """``held`` with an array of values behind it."""
    return F.struct(F.concat(held["parts"], F.array(held["short"], values)).alias("parts"), F.slice(held["short"], 1, 0).alias("short"))


def everything(held: Column) -> Column:
    """The array of all that was gathered, in order."""
    return F.flatten(F.array_append(held["parts"], held["short"]))


def using(state: Column, value: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of a fold's state and a value that is worked out once: the next state."""
    return F.aggregate(F.array(value), state, body)


def folded(items: Column, kind: str, start: dict[str, Column], step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """``finish`` of the state after all ``items``. The state is a struct of held, values of ``kind`` that are gathered, and of the fields of ``start``, in this order, as ``step`` of it and an item gives it."""

    def state(of: Callable[[str], Column], held: Column) -> Column:
        return F.struct(held.alias("held"), *[of(name).alias(name) for name in start])

    def block(before: Column, own: Column) -> Column:
        inner = F.aggregate(own, state(lambda name: before[name], nothing(kind)), step)
        behind = lambda s, after: state(lambda name: after[name], F.struct(F.concat(s["held"]["parts"], after["held"]["parts"], F.array(after["held"]["short"])).alias("parts"), s["held"]["short"].alias("short")))
        return using(before, inner, behind)

    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, state(lambda name: start[name], nothing(kind)), block, finish)
