"""Operator 11 — near duplicates by SimHash, compared exactly in tiles.

A document's fingerprint has 64 bits; a bit is 1 if it is 1 in more than half of the XXH64 values of the
document's word shingles, repeats included. Documents are linked if their fingerprints differ in at most
``radius`` bits.

Equal fingerprints are one row. The rest is an exact comparison of all others, by exclusive-or and bit
counts over arrays, of which most is skipped: fingerprints that differ in r bits have population
counts that differ by at most r, in total over any parts of them. So fingerprints are laid out in cells by the
counts of their four 16-bit parts, and only cells whose counts differ by ``radius`` or less in all are compared;
each such pair of cells from one side. A cell is cut into tiles of ``tile`` fingerprints, and what meets a tile into
chunks of ``chunk``: a tile with a chunk is one group of a shuffle, so a cell that holds a third of
all fingerprints becomes many groups of bounded size. A group returns spanning links, never all pairs.

Null texts and texts without words have fingerprint zero, linked like any other. Copies and repeated rows
share a fingerprint. A null id takes part but never names a component that has an id; a component without
ids has the null id. Ties do not arise: the smallest id names a component. Empty tables give no rows. Extra
columns are not read. Texts of any length are hashed in bounded pieces.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.salting import join_stats
from .common import shared_table
from .components import Forest, connected, groups

PARTS = 4
#: Distance of neighbouring counts in a cell's number; counts are 0 to 16, so sums never carry.
BASE = 32
#: Shingles whose bits are counted at once.
PIECE = 1 << 15


def shingle_hashes(words: list[bytes], k: int, seed: int) -> list[int]:
    """XXH64 of all ``k``-word shingles; of the whole sequence, where it is shorter."""
    if len(words) < k:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(k)))]


def _ones(hashes: list[int], starts: list[int]) -> np.ndarray:
    """How many of the hashes from each start on have each bit, the highest bit first."""
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(texts: list[str | None], k: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    ones, sizes = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    held: list[int] = []
    starts: list[int] = []
    owners: list[int] = []

    def count():
        if held:
            np.add.at(ones, owners, _ones(held, starts))
        held.clear(), starts.clear(), owners.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()  # bytes: A-Z alone become lower case
        step = max(PIECE, k)
        for at in range(0, max(len(words) - k + 1, 1), step):
            new = shingle_hashes(words[at:at + step + k - 1], k, seed)
            if new:
                starts.append(len(held))
                owners.append(i)
                held += new
                sizes[i] += len(new)
            if len(held) >= PIECE:
                count()
    count()
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def drawn_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """``id``, ``fp`` (the fingerprint as a signed long) of every row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fp": fingerprints(pdf["text"].tolist(), words, seed).view(np.int64)})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def cell_of(fp):
    """Number of the cell: the population counts of the four parts, as digits."""
    cell = F.lit(0)
    for i in range(PARTS):
        part = F.shiftrightunsigned(fp, 16 * (PARTS - 1 - i)).bitwiseAND(F.lit(0xFFFF))
        cell = cell * BASE + F.bit_count(part)
    return cell.cast("int")


def cell_steps(radius: int) -> list[int]:
    """What to add to a cell's number for its neighbours on one side; the other side sees the cell."""
    out = []
    for step in product(range(-radius, radius + 1), repeat=PARTS):
        first = next((s for s in step if s), 0)
        if first > 0 and sum(map(abs, step)) <= radius:
            out.append(sum(s * BASE ** (PARTS - 1 - i) for i, s in enumerate(step)))
    return out


def near_pairs(home: np.ndarray, others: np.ndarray, radius: int, cells: int = 1 << 17):
    """Index arrays (into ``home``, into ``others``) of what is near, a block of rows at a time."""
    step = max(1, cells // max(1, len(home)))
    for at in range(0, len(others), step):
        near = np.bitwise_count(others[at:at + step, None] ^ home[None, :]) <= radius
        j, i = np.nonzero(near)
        if len(i):
            yield i, j + at


def spanning_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of indices (visitors follow the home tile) that connect what the near pairs within the home tile
    and from it to the visitors connect."""
    forest, out = Forest(len(home)), []
    label = np.arange(len(home))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        a, b = label[i], label[j]
        apart = a != b
        if apart.any():
            for x, y in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0).tolist():
                forest.join(x, y)
            label = np.array([forest.root(x) for x in label.tolist()])

    for i, j in near_pairs(home, home, radius):
        join(i, j)
    for i, j in near_pairs(home, visitors, radius):
        first = np.flatnonzero(np.diff(j, prepend=-1))  # sorted by visitor: the first of each
        out += zip(i[first].tolist(), (j[first] + len(home)).tolist())
        join(i, np.repeat(i[first], np.diff(np.append(first, len(j)))))
    out += [(r, x) for x, r in enumerate(label.tolist()) if r != x]
    return out


def tile_rows(classes: DataFrame, radius: int, tile: int, chunk: int) -> DataFrame:
    """``cell, tile, chunk, visitor, id, fp``: every group that has to be compared."""
    steps = F.array(*[F.lit(s) for s in cell_steps(radius)])
    rows = classes.select("id", "fp", cell_of(F.col("fp")).alias("cell"))
    # One row for each of at most 17**4 cells, so it may be broadcast whatever the input.
    cells = shared_table(rows.groupBy("cell").agg(F.count("*").alias("n")).coalesce(1), "simhash-cells")
    meets = (cells.withColumn("step", F.explode(steps)).select((F.col("cell") + F.col("step")).alias("cell"), "n")
             .unionByName(cells)
             .groupBy("cell").agg(F.sum("n").alias("visitors")))
    plan = shared_table(cells.join(meets, "cell").select(
        "cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles"),
        F.ceil(F.col("visitors") / chunk).cast("int").alias("chunks")).coalesce(1), "simhash-plan")

    def dealt(by: str):
        return F.pmod(F.xxhash64("fp", F.lit(1)), F.col(by)).cast("int")

    at_home = rows.join(F.broadcast(plan), "cell").withColumn("tile", dealt("tiles"))
    home = at_home.select("cell", "tile", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"),
                          F.lit(False).alias("visitor"), "id", "fp")
    # the other tiles of the cell, each pair once
    beside = at_home.where("tile > 0").select(
        "cell", F.explode(F.expr("sequence(0, tile - 1)")).alias("tile"), dealt("chunks").alias("chunk"),
        F.lit(True).alias("visitor"), "id", "fp")
    away = (rows.withColumn("step", F.explode(steps)).withColumn("cell", F.col("cell") + F.col("step"))
            .join(F.broadcast(plan), "cell")
            .select("cell", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), dealt("chunks").alias("chunk"),
                    F.lit(True).alias("visitor"), "id", "fp"))
    return home.unionByName(beside).unionByName(away)


def tile_links(classes: DataFrame, radius: int, tile: int, chunk: int) -> DataFrame:
    """``a``, ``b``: spanning links; an end is (id is null, id, fingerprint), so that the smallest end of a
    component carries its smallest id."""
    kind = classes.schema["id"].dataType.simpleString()
    keys = ["cell", "tile", "chunk"]

    def run(batches):
        for g in groups(batches, keys):
            visitor = g["visitor"].to_numpy(dtype=bool)
            order = np.argsort(visitor, kind="stable")
            n = int((~visitor).sum())
            if n == 0 or len(order) == 1:
                continue
            fp = g["fp"].to_numpy()[order]
            links = spanning_links(fp[:n].view(np.uint64), fp[n:].view(np.uint64), radius)
            if links:
                a, b = np.array(links).T
                ids = g["id"].iloc[order]
                yield pd.DataFrame({"a_id": ids.iloc[a].to_numpy(), "a_fp": fp[a], "b_id": ids.iloc[b].to_numpy(),
                                    "b_fp": fp[b]})

    found = (tile_rows(classes, radius, tile, chunk).repartition(*keys).sortWithinPartitions(*keys)
             .mapInPandas(run, f"a_id {kind}, a_fp long, b_id {kind}, b_fp long"))
    end = [F.struct(F.col(f"{s}_id").isNull().alias("none"), F.col(f"{s}_id").alias("id"),
                    F.col(f"{s}_fp").alias("fp")).alias(s) for s in "ab"]
    return found.select(*end)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2,
         seed: int = 42, tile: int = 1 << 14, chunk: int = 1 << 20) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hexadecimal digits), ``component_id``."""
    drawn = shared_table(drawn_fingerprints(docs, id_col, text_col, words, seed), "simhash")
    classes = shared_table(drawn.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "simhash-classes")
    roots = connected(tile_links(classes, radius, tile, chunk))
    linked = shared_table(roots.select(F.col("key.fp").alias("fp"), F.col("root.id").alias("component_id")), "simhash-roots")
    # documents that are alone need no look-up
    named = classes.join(linked.withColumn("linked", F.lit(True)), "fp", "left").where("linked or n > 1").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.lit(True).alias("named"))
    out = join_stats(drawn, shared_table(named, "simhash-named"), ["fp"], "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      component.alias("component_id"))
