"""Operator 5 — near duplicates by chosen-path set similarity join.

A document is the set of its word shingles; documents whose sets are equal form a class, and only
classes are compared. Every class has ``WIDTH`` minwise tokens. In each of ``trees`` independent trees a node
chooses two of the tokens; a class goes to the child named by the value it holds there. Two sets
of similarity s share a child with chance 1 - (1 - s)² at least, so a pair stays together in a tree
to any depth with chance 0.969 at s = 0.85, and 4 trees find it with 1 - 1e-6. Nodes of up to
``leaf`` classes are compared exhaustively by their tokens; larger ones branch again, to ``depth``
levels. A large node whose members share most tokens would not get smaller by branching; it is taken as
one candidate group, as is what is still large in the end.

Compared nodes give candidate groups (connected components of the pairs that may reach the
threshold), and in each group the full sets decide: every pair within it is intersected exactly. A group is
cut into blocks, each pair of blocks is a task of its own, so a group that holds a third of all
documents spreads over the cluster. Tasks return spanning links, never all pairs.

Null texts and texts without words have an empty set and are linked with nothing. Repeated rows
and copies form one class. A null id takes part but never names a component that has an id; a
component without ids has the null id. Ties do not arise: the smallest id names a component. Extra columns
are not read by ``link``; ``keep_one`` returns all columns.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, shared_table
from .components import Forest, connected, groups
from .shingles import minwise, shingle_sets

#: Minwise tokens of a class; a level of branching chooses among 16 of them.
WIDTH, LEVEL = 128, 16


def text_key(text_col: str):
    """Names a text together with its id; the texts of one id are told apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(text, F.length(text))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id``, ``text_key``, ``n_shingles``, ``digest`` (of the whole set), ``tokens``."""
    src = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at:at + 500]
                sets = shingle_sets([t or "" for t in some["text"]], words)
                yield pd.DataFrame({
                    "id": some["id"], "text_key": some["text_key"], "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                               for s in sets],
                    "tokens": list(minwise(sets, WIDTH).view(np.int32))})

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, text_key long, n_shingles long, digest binary, tokens array<int>")


def least_shared(threshold: float) -> int:
    """Tokens that a pair at the threshold shares but for five standard deviations."""
    return max(1, math.floor(WIDTH * threshold - 5 * math.sqrt(WIDTH * threshold * (1 - threshold))))


def children(rows: DataFrame, level: int) -> DataFrame:
    """``digest``, ``node`` of the next level: two chosen tokens of every node. The trees' roots
    (nodes 0, 1, ...) have tokens of their own."""
    half = LEVEL // 2
    kids = []
    for b in range(2):
        chosen = F.pmod(F.xxhash64("node", F.lit(b)), F.lit(half)).cast("int") + (level * LEVEL + b * half + 1)
        if level == 0:
            chosen = (F.col("node") * 2 + b + 1).cast("int")
        kids.append(F.xxhash64("node", chosen, F.element_at("tokens", chosen)))
    return rows.select("digest", F.explode(F.array(*kids)).alias("node"))


def candidate_links(classes: DataFrame, threshold: float, trees: int, depth: int, leaf: int) -> DataFrame:
    """``a``, ``b``: spanning links of the candidate groups."""
    tokens = classes.select("digest", "tokens")
    rows = children(tokens.withColumn("node", F.explode(F.array(*[F.lit(t).cast("long") for t in range(trees)]))), 0)
    links = []
    for level in range(depth):
        sizes = shared_table(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node-sizes")
        rows = shared_table(rows.join(sizes, "node").select("digest", "node", "n"), "nodes")
        small = rows.where(F.col("n") <= leaf).select("digest", "node").join(tokens, "digest")
        links.append(leaf_links(small, least_shared(threshold)))
        large = rows.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        if level == 0:  # only classes of large nodes go on
            tokens = shared_table(tokens.join(large.select("digest").distinct(), "digest"), "large-tokens")
        # Branching splits what is dissimilar; members that share most tokens would only be copied.
        close = shared_table(large.select("node").distinct() if level + 1 == depth
                             else dense_nodes(large, tokens), "dense-nodes")
        alike = large.join(close, "node")
        first = shared_table(alike.groupBy("node").agg(F.min("digest").alias("a")), "dense-firsts")
        links.append(alike.join(first, "node").select("a", F.col("digest").alias("b")))
        rows = children(large.join(close, "node", "left_anti").select("digest", "node").join(tokens, "digest"), level + 1)
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out.where("a <> b").distinct()


def dense_nodes(large: DataFrame, tokens: DataFrame, sample: int = 16) -> DataFrame:
    """``node`` of the nodes whose members share half of their tokens on average, by about
    ``sample`` of them. This decides only where the comparison takes place, not what is linked."""
    some = large.where(F.pmod(F.xxhash64("digest", "node"), F.col("n")) < sample).select("digest", "node").join(tokens, "digest")

    def run(batches):
        for node in groups(batches, ["node"]):
            grid = np.stack(node["tokens"].to_numpy())
            n = len(grid)
            same = (grid[:, None, :] == grid[None, :, :]).mean(axis=2).sum() - n
            if n > 1 and same >= 0.5 * n * (n - 1):
                yield node[["node"]].iloc[:1]

    return (some.select("node", "tokens").repartition("node").sortWithinPartitions("node")
            .mapInPandas(run, "node long"))


def leaf_links(members: DataFrame, least: int) -> DataFrame:
    """Exhaustive comparison of small nodes by their tokens: links to the first of each group."""
    def run(batches):
        for node in groups(batches, ["node"]):
            grid = np.stack(node["tokens"].to_numpy())
            keys, forest = node["digest"].tolist(), Forest(len(node))
            near = (grid[:, None, :] == grid[None, :, :]).sum(axis=2) >= least if len(grid) <= 8 else None
            for i in range(len(grid) - 1):
                row = near[i, i + 1:] if near is not None else (grid[i + 1:] == grid[i]).sum(axis=1) >= least
                for j in np.flatnonzero(row).tolist():
                    forest.join(i, i + 1 + j)
            out = [(keys[forest.root(i)], keys[i]) for i in range(len(keys)) if forest.root(i) != i]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return (members.select("node", "digest", "tokens").repartition("node").sortWithinPartitions("node")
            .mapInPandas(run, "a binary, b binary"))


def spanning_links(sets: list[np.ndarray], blocks: list[int], pair: tuple[int, int], share: int,
                   of: int) -> list[tuple[int, int]]:
    """Links (``of`` × intersection ≥ ``share`` × union) that connect what is connected by the
    pairs between the two blocks (all pairs, where they are one)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    by_value = owner[np.argsort(inverse, kind="stable")]
    start = np.concatenate([[0], np.cumsum(counts)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    side = np.array(blocks)
    forest, out = Forest(n), []
    for i in range(n):
        mine = inverse[first[i]:first[i + 1]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        lengths = counts[mine]
        at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(by_value[at], minlength=n)
        fits = of * shared >= share * (sizes + sizes[i] - shared)
        fits[:i + 1] = False
        if pair[0] != pair[1]:
            fits &= side != side[i]
        for j in np.flatnonzero(fits).tolist():
            if forest.join(i, j):
                out.append((i, j))
    return out


def confirmed_links(docs: DataFrame, candidates: DataFrame, id_col: str, text_col: str, words: int,
                    share: int, of: int, block_shingles: int, partitions: int) -> DataFrame:
    """``a``, ``b``: links of the full sets within candidate groups.

    ``candidates``: ``digest``, ``grp``, ``id``, ``text_key``, ``n_shingles`` of every class in a group.
    """
    sizes = candidates.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight"))
    # A small group is one block. A large one has as many as its size asks for, and enough that the
    # pairs of blocks spread evenly over all tasks.
    spread = math.ceil(math.sqrt(8 * partitions))
    n_blocks = F.greatest(F.ceil(F.col("weight") / block_shingles),
                          F.when(F.col("members") > 128, F.least(F.ceil(F.col("members") / 32), F.lit(spread)))
                          .otherwise(1)).cast("int")
    sizes = shared_table(sizes.select("grp", n_blocks.alias("n_blocks")), "group-sizes")
    wanted = shared_table(candidates.join(sizes, "grp").select(
        "digest", "grp", "n_blocks", "id", "text_key",
        F.pmod(F.xxhash64("digest"), F.col("n_blocks")).cast("int").alias("block")), "wanted-sets")
    texts = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"),
                        F.col(text_col).cast("string").alias("text"))
    # texts that are not wanted take no part in the shuffle, and the plan is the same at every size
    texts = marked(texts, F.col("text_key"), wanted.select("text_key")).where("_may")
    same = (texts["text_key"] == wanted["text_key"]) & texts["id"].eqNullSafe(wanted["id"])
    rows = texts.join(wanted.hint("merge"), same).select("digest", "grp", "n_blocks", "block", "text")

    def to_sets(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at:at + 500]
                sets = shingle_sets([t or "" for t in some["text"]], words)
                yield some.drop(columns="text").assign(set=[s.tobytes() for s in sets])

    sets = rows.mapInPandas(to_sets, "digest binary, grp binary, n_blocks int, block int, set binary")
    pairs = sets.select("digest", "grp", "block", "set", F.explode(F.expr(
        "transform(sequence(0, n_blocks - 1), o -> struct(least(o, block) as i, greatest(o, block) as j))")).alias("p"))
    pairs = pairs.select("grp", "p.i", "p.j", "digest", "block", "set")

    def run(batches):
        for g in groups(batches, ["grp", "i", "j"]):
            g = g.drop_duplicates("digest")  # a class whose row is there more than once
            if len(g) < 2:
                continue
            keys = g["digest"].tolist()
            links = spanning_links([np.frombuffer(s, dtype=np.uint64) for s in g["set"]], g["block"].tolist(),
                                   (g["i"].iloc[0], g["j"].iloc[0]), share, of)
            if links:
                yield pd.DataFrame([(keys[a], keys[b]) for a, b in links], columns=["a", "b"])

    return (pairs.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
            .mapInPandas(run, "a binary, b binary"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, share: int = 85,
         of: int = 100, trees: int = 4, depth: int = 5, leaf: int = 512,
         block_shingles: int = 2_000_000) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id``, ``kept``, ``text_key``."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = shared_table(sketches(docs, id_col, text_col, words), "sketches")
    # The row that stands for a class has its smallest id; a null one only where there is no other.
    classes = shared_table(
        drawn.where("n_shingles > 0").groupBy("digest").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("rep"),
            F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
        .select("digest", "rep.id", "rep.text_key", "n_shingles", "tokens"), "classes")
    found = shared_table(connected(candidate_links(classes, share / of, trees, depth, leaf))
                         .select(F.col("key").alias("digest"), F.col("root").alias("grp")), "candidate-groups")
    candidates = found.join(classes.drop("tokens"), "digest")
    links = confirmed_links(docs, shared_table(candidates, "candidates"), id_col, text_col, words, share, of,
                            block_shingles, partitions)
    roots = shared_table(connected(links), "components")
    named = shared_table(
        classes.select("digest", "id").join(roots.withColumnRenamed("key", "digest"), "digest", "left")
        .select("digest", "id", F.coalesce("root", "digest").alias("root")), "named-classes")
    # Few components have more than one class, so the smallest id of each is a small table.
    least = shared_table(named.where("root <> digest").select("root").distinct().join(named, "root")
                         .groupBy("root").agg(F.min("id").alias("component_id")), "component-ids")
    ids = shared_table(named.join(least, "root", "left")
                       .select("digest", F.coalesce("component_id", "id").alias("component_id")), "class-components")
    out = drawn.select("id", "text_key", "n_shingles", "digest").join(ids, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component (repeated rows of it go too), with all columns."""
    linked = shared_table(link(docs, id_col, text_col, **options)
                          .select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), "kept"), "linked")
    gone = linked.where("not kept").select("_id", "_key").distinct()
    # rows that stay need no shuffle, but for the few that the filter of keys takes for others
    rows = marked(docs.withColumn("_text_key", text_key(text_col)), F.xxhash64(id_col, "_text_key"), gone.select(F.xxhash64("_id", "_key")))
    unsure = rows.where("_may")
    same = unsure[id_col].eqNullSafe(gone["_id"]) & (unsure["_text_key"] == gone["_key"])
    rows = rows.where("not _may").unionByName(unsure.join(gone.hint("merge"), same, "left_anti"))
    if linked.where("kept").groupBy("_id", "_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows.select(*docs.columns)  # no row is there twice: nothing to deal out by id
    return rows.dropDuplicates([id_col, "_text_key"]).select(*docs.columns)
