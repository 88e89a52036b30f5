"""Connected components of an edge table, and groups that stream through a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``key``, ``root`` (smallest key reachable) of every key in ``edges`` (``a``, ``b``).

    Alternates two star operations: every key hands its larger neighbours, then its smaller ones,
    to the smallest neighbour it knows, until all edges form stars. Each step is a grouped minimum
    joined back, so a key with many neighbours is never gathered in a task; its result is written to
    the shared folder. Raises if ``rounds`` do not suffice (they do for paths of 2**rounds keys).
    """
    now = shared_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "edges")
    for _ in range(rounds):
        n = now.count()
        if n == 0 or _stars(now):
            break
        now = _star(_star(now, n, large=True), n, large=False)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("key"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("key"), F.col("a").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every key is either the centre of its edges or at the end of a single one."""
    ends = edges.select(F.col("b").alias("v"), F.lit(1).alias("end"), F.lit(0).alias("centre")).union(
        edges.select(F.col("a").alias("v"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
    return (ends.groupBy("v").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre"))
            .where("ends > 1 or ends = 1 and centre = 1").agg(F.count("*")).first()[0] == 0)


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """One star step over ``n`` edges ``a`` < ``b``."""
    one = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    # large: over all neighbours, hand on those larger than u; small: over the smaller ones
    seen = one.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else one
    least = shared_table(seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars", 2 * n)
    out = seen.join(least, "u")
    if large:  # one edge for each edge
        return shared_table(out.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b"),
                            "edges", n)
    new = out.select(F.col("m").alias("a"), F.col("v").alias("b")).union(
        least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return shared_table(new.where("a <> b").distinct(), "edges", 2 * n)


def groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of equal ``keys`` from batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = not held or any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys)
        for k in keys:
            col = pdf[k].to_numpy()
            new[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(new).tolist()
        first = starts[0] if starts else len(pdf)
        if first:
            held.append(pdf.iloc[:first])
        if not starts:
            continue
        if held:
            yield pd.concat(held, ignore_index=True)
        for a, b in zip(starts, starts[1:]):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[starts[-1]:]]
    if held:
        yield pd.concat(held, ignore_index=True)


class Forest:
    """Union–find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
