"""Exact medians whose state is bounded, whatever the values.

``F.median`` keeps a map of all distinct values in every task. Here a mergeable quantile sketch proposes two values around the
wanted rank, and one pass counts the rows below, at and between them exactly. That either names the value or leaves an
open interval with fewer rows; it is narrowed again until at most ``EXACT_ROWS`` rows are inside, and only those are counted
by value. All columns share the passes: one for the number of rows, two for each round of narrowing (which divides what is left by
about ``ACCURACY`` / 4), one for the values.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of one column that the last pass may count.
EXACT_ROWS = 100_000
#: Rank error of the sketch is 1/ACCURACY of the rows.
ACCURACY = 2_000


@dataclass
class _Target:
    """The value of one rank (from 0) of a column: it lies in the open interval (``lo``, ``hi``), None for no bound, with
    ``inside`` rows, and ``below`` rows before those; or it is known."""

    column: int
    rank: int
    inside: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    value: float | None = None

    def within(self) -> Column:
        c = F.col(f"_{self.column}")
        bounds = [c > F.lit(self.lo)] * (self.lo is not None) + [c < F.lit(self.hi)] * (self.hi is not None)
        return functools.reduce(lambda a, b: a & b, bounds, c.isNotNull())


def exact_medians(df: DataFrame, columns: dict[str, Column], exact_rows: int = EXACT_ROWS,
                  accuracy: int = ACCURACY) -> dict[str, float | None]:
    """The median of every expression over the rows where it is neither NULL nor NaN; None where there are none.

    The mean of the two middle values where their number is even.
    """
    if not columns:
        return {}
    names = list(columns)
    x = df.select(*[F.nanvl(columns[c].cast("double"), F.lit(None).cast("double")).alias(f"_{i}") for i, c in enumerate(names)])
    counts = x.agg(*[F.count(f"_{i}").alias(f"_{i}") for i in range(len(names))]).first()
    targets = [[_Target(i, r, n) for r in sorted({(n - 1) // 2, n // 2})] if n else []
               for i, n in enumerate(counts)]
    every = [t for ts in targets for t in ts]
    while wide := [t for t in every if t.value is None and t.inside > exact_rows]:
        _narrow(x, wide, accuracy)
    _count_values(x, [t for t in every if t.value is None])
    out: dict[str, float | None] = {}
    for c, ts in zip(names, targets):
        v = [t.value for t in ts]
        out[c] = None if not v else v[0] if v[0] == v[-1] else 0.5 * v[0] + 0.5 * v[1]
    return out


def _narrow(x: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """One round: two values around each rank by a sketch, then what lies below, at and between them."""
    sketches = []
    for k, t in enumerate(targets):
        slack = 2.0 / accuracy + 1.0 / t.inside
        share = (t.rank - t.below) / t.inside
        sketches.append(F.percentile_approx(F.when(t.within(), F.col(f"_{t.column}")),
                                            [max(0.0, share - slack), min(1.0, share + slack)], accuracy).alias(f"_{k}"))
    proposed = x.agg(*sketches).first()
    asked = []
    for k, t in enumerate(targets):
        c, (lo, hi) = F.col(f"_{t.column}"), proposed[k]
        asked += [F.count_if(c < F.lit(lo)).alias(f"_b{k}"), F.count_if(c == F.lit(lo)).alias(f"_l{k}"),
                  F.count_if((c > F.lit(lo)) & (c < F.lit(hi))).alias(f"_m{k}"), F.count_if(c == F.lit(hi)).alias(f"_h{k}")]
    got = x.agg(*asked).first()
    for k, t in enumerate(targets):
        lo, hi = proposed[k]
        below, at_lo, between, at_hi = (got[f"_{s}{k}"] for s in "blmh")
        up_to = below + at_lo
        if t.rank < below:  # the sketch was further off than it says: the rank is still between the old bound and lo
            t.hi, t.inside = lo, below - t.below
        elif t.rank < up_to:
            t.value = lo
        elif t.rank < up_to + between:
            t.lo, t.hi, t.below, t.inside = lo, hi, up_to, between
        elif hi > lo and t.rank < up_to + between + at_hi:
            t.value = hi
        else:
            rest = up_to + (between + at_hi if hi > lo else 0)
            t.inside -= rest - t.below
            t.lo, t.below = hi, rest


def _count_values(x: DataFrame, targets: list[_Target]) -> None:
    """Names the values that are left, from the counts of the values inside their intervals."""
    if not targets:
        return
    # the two middle ranks of a column mostly share their interval
    spans = {(t.column, t.lo, t.hi): t for t in targets}
    number = {span: k for k, span in enumerate(spans)}
    cells = F.array(*[F.when(t.within(), F.struct(F.lit(k).alias("k"), F.col(f"_{t.column}").alias("v"))) for k, t in enumerate(spans.values())])
    rows = (x.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.k", "c.v").agg(F.count("*").alias("rows"))
            .collect())
    values: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.k, r.v)):
        values.setdefault(r.k, []).append((r.v, r["rows"]))
    for t in targets:
        before = t.below
        for v, n in values[number[t.column, t.lo, t.hi]]:
            before += n
            if t.rank < before:
                t.value = v
                break
