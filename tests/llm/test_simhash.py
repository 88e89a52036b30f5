"""Operator 11 against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelspark.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, radius=2):
    """(id, fingerprint, smallest id reachable) of (id, fingerprint) rows."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fp:016x}", least.get(root(i))) for i, (d, fp) in enumerate(rows)), key=str)


def collected(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def text_rows():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdéZ") for _ in range(rng.randrange(2, 7))) for _ in range(800)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(60):  # near copies: a word or two replaced
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(w), "s", "en"))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))), "s", "en") for i in range(80)]
    rows += [(300, None, "s", "en"), (301, "", "s", "en"), (302, " \t\x0b\n", "s", "en"), (303, "ONE", "s", "en"), (304, "one", "s", "en"),
             (305, "two words", "s", "en"), (None, rows[0][1], "s", "en"), (100, rows[0][1], "s", "en"), (100, "another text", "s", "en"),
             (306, "a b c d É é", "s", "en")]
    return rows


@pytest.mark.parametrize("tile, chunk", [(1 << 14, 1 << 20), (3, 5)])
def test_links_equal_brute_force(frame, tile, chunk):
    rows = text_rows()
    want = brute_components([(d, brute_fingerprint(t)) for d, t, *_ in rows])
    got = collected(simhash.link(frame(rows), tile=tile, chunk=chunk))
    assert got == want
    assert sum(c == 100 for _, _, c in got) > 30  # the near copies, and the null id among them


def test_hash_is_the_one_of_spark(spark):
    text = "Der Ähre wegen, 漢字 and a long tail of words to pass thirty-two bytes"
    w = text.encode().lower().split()
    one = spark.createDataFrame([(b" ".join(w[:3]).decode(),)], "s string").select(F.xxhash64("s")).first()[0]
    assert simhash.shingle_hashes(w, 3, 42)[0] == one % 2**64


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)) for n in (0, 1, 2, 3, 500, 37, 11, 1000)]
    monkeypatch.setattr(simhash, "PIECE", 10)
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_cells_lose_no_pair(spark, radius):
    """Random flips of few fingerprints, dense enough that most cells have several tiles."""
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, size=4, dtype=np.uint64)
    fps = set()
    for i in range(400):
        x = int(seeds[i % 4])
        for b in rng.integers(0, 64, size=rng.integers(0, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {0, (1 << 64) - 1, 1, 3, 7, 0xFFFF, 0xFFFF << 48}
    rows = list(enumerate(sorted(fps)))
    classes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "id long, fp long")
    want = {frozenset((i, j)) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= radius}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [(r.a.id, r.b.id) for r in simhash.tile_links(classes, radius, 16, 64).collect()]
    assert all(frozenset(p) in want for p in links) or radius  # spanning links may join by way of a third
    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    mine = [root(i) for i, _ in rows]
    up = {i: i for i, _ in rows}
    for a, b in map(tuple, want):
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert mine == [root(i) for i, _ in rows]


def test_links_do_not_grow_with_the_square(spark):
    """Rows out of the comparison for balls of near fingerprints in one cell's surroundings."""
    counts = {}
    for n in (300, 1200):
        rng = np.random.default_rng(5)
        fps = set()
        while len(fps) < n:
            x = 0x0123456789ABCDEF
            for b in rng.integers(0, 63, size=2):
                x ^= 1 << int(b)
            fps.add(x)
        classes = spark.createDataFrame(list(enumerate(sorted(fps))), "id long, fp long")
        counts[n] = simhash.tile_links(classes, 2, 64, 256).count()
    assert counts[1200] < 45 * 1200 and counts[1200] < 8 * counts[300]


def test_empty(frame):
    assert collected(simhash.link(frame([]))) == []
