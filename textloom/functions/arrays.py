"""Helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression that is used inside a lambda is evaluated again for every element, so
    anything costly (a split, a sort) is bound here first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def interleave(gaps: Column, fills: Column, fill: Callable[[Column], Column]) -> Column:
    """``gaps[0] + fill(fills[0]) + gaps[1] + ...`` for ``n + 1`` gaps and ``n`` fills."""
    return F.array_join(
        F.zip_with(
            gaps,
            fills,
            lambda g, f: F.concat(F.coalesce(g, F.lit("")), F.when(f.isNull(), F.lit("")).otherwise(fill(f))),
        ),
        "",
    )


def _run_starts(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Positions in a sorted array where a new run of equal elements starts."""
    positions = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(positions, lambda i: (i == 0) | ~same(F.get(ordered, i), F.get(ordered, i - 1)))


def run_counts(values: Column) -> Column:
    """``array<struct<item, n>>`` of the distinct values, in n log n time, sorted by item."""

    def count_runs(ordered: Column) -> Column:
        return let(
            _run_starts(ordered, lambda a, b: a.eqNullSafe(b)),
            lambda s: F.transform(
                s,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("item"),
                    (F.coalesce(F.get(s, k + 1), F.size(ordered)) - start).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(values), count_runs)


def group_positions(items: Column) -> Column:
    """``array<struct<first, item, at>>`` from ``array<struct<value, at, item>>``, in n log n time.

    One entry per distinct value with the positions it stands at and the item of the first one,
    in the order of first appearance.
    """

    def group(ordered: Column) -> Column:
        def run(starts: Column, start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(ordered))
            return F.struct(
                F.get(ordered, start)["at"].alias("first"),
                F.get(ordered, start)["item"].alias("item"),
                F.transform(F.slice(ordered, start + 1, stop - start), lambda p: p["at"]).alias("at"),
            )

        starts = _run_starts(ordered, lambda a, b: a["value"] == b["value"])
        return F.sort_array(let(starts, lambda s: F.transform(s, lambda start, k: run(s, start, k))))

    return let(F.sort_array(items), group)
