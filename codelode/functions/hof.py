"""Small helpers over Spark's array functions.

A source file is at most 1 MiB (``sources.corpus.size_cap``), so the lines of one
file always fit in one row. Everything per file is therefore written as array
expressions on that row: it runs where the file was read, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let v = value in body(v)``: ``value`` is evaluated once per row.

    Referring to a column twice inside a lambda, or once in a lambda that runs per
    element, would otherwise evaluate its whole expression again each time. ``element_at`` works out
    the type of its array once, ``get`` for every row.
    """
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def bind_as(type_: str, value: Column, body: Callable[[Column], Column]) -> Column:
    """:func:`bind` for a body of a known type. ``transform`` copies what its body returns,
    ``aggregate`` does not; this matters when the result is large and bound again and again,
    as in a fold over the lines of a file."""
    start = F.lit(None).cast(type_)
    return F.aggregate(F.array(value), start, lambda _, v: body(v).cast(type_))


def _first_found(
    tiers: Sequence[int], within: Callable[[Column], Column], at: Callable[[Column], Column]
) -> Column:
    """``at(k)`` for the first of the positions ``k = within(n)``, for growing ``n``, that is not 0; NULL
    if all are. A longer stretch is looked at only when the shorter ones have nothing. It is a fold over
    the lengths, so that ``within`` stands once in the plan, and is worked out once for each length:
    ``nullif`` in a lambda would do it twice."""
    return F.aggregate(
        F.array(*[F.lit(n) for n in tiers]), F.lit(0),
        lambda found, n: F.when(found > 0, found).otherwise(F.coalesce(within(n).cast("int"), F.lit(0))),
        lambda k: F.when(k > 0, at(k)))


def first_index(
    arr: Column, start: Column, tiers: Sequence[int], hit: Callable[[Column], Column],
    most: Column | None = None,
) -> Column:
    """Offset (0-based, from ``start``) of the first element at or after the 0-based
    position ``start`` for which ``hit`` is true, within ``tiers[-1]`` elements (and ``most``);
    NULL if there is none. The tiers are growing look-ahead lengths."""
    def within(n: Column) -> Column:
        flags = F.transform(F.slice(arr, start + 1, n if most is None else F.least(n, most)), hit)
        return F.array_position(flags, F.lit(True))

    return _first_found(tiers, within, lambda k: k - 1)


def last_index(
    arr: Column, end: Column, tiers: Sequence[int], hit: Callable[[Column], Column]
) -> Column:
    """0-based position of the last element at or before the 0-based position ``end``
    for which ``hit`` is true, within ``tiers[-1]`` elements; NULL if none."""
    def within(n: Column) -> Column:
        first = F.greatest(F.lit(0), end - (n - 1))
        flags = F.reverse(F.transform(F.slice(arr, first + 1, end - first + 1), hit))
        return F.array_position(flags, F.lit(True))

    return F.when(end >= 0, _first_found(tiers, within, lambda k: (end + 1 - k).cast("int")))


def distinct_sorted(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def null_if_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def join_present(sep: str, parts: Sequence[Column]) -> Column:
    """Join the parts that are neither NULL nor empty."""
    return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])
