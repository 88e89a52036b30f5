"""Operator 10 — repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere. Every such string
(window) chooses an anchor inside itself: the start of its ``gram``-byte substring with the smallest
hash. Equal windows choose the same anchor, so only suffixes that start at anchors are sorted,
and of these only those whose anchor substring is found twice or more (a count of hashes drops
suffixes that are unique within their first ``gram`` bytes before anything is exchanged).

An anchor with all the bytes that its windows reach is a context. Contexts are grouped by their hashes first:
all windows of one that is found twice are repeated, at every place it has, and only one of its
places is sorted, and that only where its anchor substring has other contexts too. So what a third of all
documents hold is sorted once, and no two sorted suffixes are alike.

1. Each task sorts its suffixes, cut after the last byte a window of theirs can reach and headed by the hash of their
   anchor substring, and front-codes the sorted run: of every suffix only its common prefix's length with the
   suffix before it and the rest of its bytes are sent.
2. The runs are cut by the hashes, so suffixes that share their first ``gram`` bytes lie in one range, and no window
   is ever matched across ranges. Nothing is sampled, and nothing goes through the driver.
3. The task merges its pieces with a loser tree that holds, for every loser, its common prefix with the
   winner: bytes known to be equal are never compared again. Out come sorted suffixes with the
   common prefixes of neighbours.
4. Suffixes that share their first ``gram`` bytes are neighbours; their windows are compared, for a block of the
   windows' offsets at a time, and runs of repeated ones come out, never single windows.
5. An anchor substring with more than ``CROWD`` different contexts (near copies of one passage, in a large share of
   all documents) would fill a task. Its contexts are cut into blocks of ``BLOCK`` windows, and what was done for whole
   contexts is done for blocks: equal blocks are grouped, all windows of one that is found twice are repeated, and one place
   of each goes on, if there are other blocks with the same core (the bytes that all windows of a block share). Near copies
   differ in few places, so few go on; their windows are counted by hash in one more grouping.

Null texts are empty; texts under ``length`` bytes lose nothing. Rows with equal texts are one text with
copies: it loses everything, and is sorted once. Nulls in the id are an id of their own. Extra columns
are not read by ``measure``; ``remove_repeats`` returns all columns. A task holds the texts of one
batch, one run of ``RUN`` suffixes, or one range of about ``RANGE`` suffixes (``CROWD`` more at most); a text of more than
``SEGMENT`` bytes is looked at in overlapping segments.

``remove_repeats`` with ``words`` measures in words: the same steps run over a code of ``CODE`` bytes for
every word, in which only windows that start at a word's code count, and whole words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.salting import ROWS, join_stats
from .common import marked, shared_table
from .components import groups
from .shingles import _letters, _powers, mix
from .word_codes import CODE, char_spans, word_codes

LENGTH, GRAM = 400, 100
#: Suffixes in a sorted run, and in a range of the merge; bytes looked at together (a power of two).
RUN, RANGE, SEGMENT = 20_000, 8_000, 1 << 20
#: Contexts of one anchor substring that are sorted in one task.
CROWD = 10_000
#: Bytes of the anchor's hash before a sorted suffix; offsets of windows that are compared together.
HEAD, BLOCK = 8, 64
#: Suffixes of small groups that are compared in one go.
TOGETHER = 1_000
#: Words of the anchor substring, where strings are measured in words.
GRAM_WORDS = 13
_U = np.uint64


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode()


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of bytes, and what to multiply a difference with."""
    up, down = _powers(1 << max(12, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum(_letters()[raw] * up[:len(raw)], out=total[1:])
    return total, down


def rolling(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from every position."""
    total, down = prefix_sums(raw)
    return mix((total[n:] - total[:-n]) * down[:len(raw) - n + 1])


def window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(v)
    grid = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=_U)
    grid[:n] = v
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of up to about ``SEGMENT`` bytes with their parts (text, its offset there, start and end in
    the buffer); every window lies wholly in one part."""
    held: list[bytes] = []
    parts: list[tuple[int, int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, SEGMENT - length):
            piece = t[at:at + SEGMENT - 1]
            if size and size + len(piece) >= SEGMENT:
                yield np.frombuffer(b"".join(held), dtype=np.uint8), parts
                held, parts, size = [], [], 0
            held.append(piece)
            parts.append((i, at, size, size + len(piece)))
            size += len(piece)
    if size:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), parts


def anchors(texts: list[bytes], length: int, gram: int, contexts: bool = False) -> Iterator[tuple]:
    """Per part of a text: (text, anchor positions, their hashes, and for each anchor the least and
    the most bytes between the start of a window that chooses it and itself), and if asked the hashes of
    all bytes that its windows reach, with its place in them."""
    w = length - gram + 1
    bits = SEGMENT.bit_length() - 1
    for raw, parts in segments(texts, length):
        total, down = prefix_sums(raw)
        h = mix((total[gram:] - total[:-gram]) * down[:len(raw) - gram + 1])
        # the hash's high bits, then the position: the smallest hash, and its first place in ties
        order = (h >> _U(bits) << _U(bits)) | np.arange(len(h), dtype=_U)
        chosen = (window_minimum(order, w) & _U(SEGMENT - 1)).astype(np.int64)
        for i, at, start, end in parts:
            # a text's next segment starts SEGMENT - length further on; windows from there on are its own
            stop = min(end - length + 1, start + SEGMENT - length)
            mine = chosen[start:stop]
            edge = np.flatnonzero(np.diff(mine)) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge, [len(mine)]]) - 1
            a = mine[first] - start
            out = i, at + a, h[mine[first]].view(np.int64), a - last, a - first
            if contexts:
                d = (total[start + last + length] - total[start + first]) * down[start + first]
                d = mix(d ^ (a - first).astype(_U) * _U(0xD6E8FEB86659FD93))
                out = *out, mix(d ^ (last - first).astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
            yield out


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that are known to agree before ``at``."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at:at + 64], b[at:at + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return at + (m if not d else m - 1 - (d.bit_length() - 1) // 8)
        at += 64
    return n


class Run:
    """A piece of a sorted run: suffixes by (bytes from the anchor, bytes before it backwards)."""

    FIELDS = ("shared", "sizes", "tails", "before_shared", "before_sizes", "before_tails", "marks", "owners")

    @staticmethod
    def encode(entries: list[tuple]) -> dict:
        """``entries``: (right, left reversed, anchor, least, most, owner), sorted. Front-coded: a
        string's bytes follow only from its common prefix with the one before it; the bytes before an
        anchor are front-coded where the bytes from it on are the same."""
        shared, sizes, tails, bs, bz, bt = [], [], [], [], [], []
        right = left = b""
        for r, l, *_ in entries:
            k = common_prefix(right, r)
            same = k == len(r) == len(right)
            j = common_prefix(left, l) if same else 0
            shared.append(k)
            sizes.append(len(r) - k)
            tails.append(r[k:])
            bs.append(j)
            bz.append(len(l) - j)
            bt.append(l[j:])
            right, left = r, l
        short = lambda x: np.array(x, dtype="<u2").tobytes()
        return {"n": len(entries), "shared": short(shared), "sizes": short(sizes), "tails": b"".join(tails),
                "before_shared": short(bs), "before_sizes": short(bz), "before_tails": b"".join(bt),
                "marks": np.array([e[2:5] for e in entries], dtype="<i8").tobytes(),
                "owners": b"".join(e[5] for e in entries)}

    @staticmethod
    def decode(row) -> Iterator[tuple]:
        """(right, left reversed, anchor, least, most, owner, common prefix with the one before)."""
        shared, sizes, bs, bz = (np.frombuffer(getattr(row, f), dtype="<u2").tolist()
                                 for f in ("shared", "sizes", "before_shared", "before_sizes"))
        marks = np.frombuffer(row.marks, dtype="<i8").reshape(-1, 3).tolist()
        tails, before, owners = row.tails, row.before_tails, row.owners
        right = left = b""
        at = bat = 0
        for i, (k, n, j, m) in enumerate(zip(shared, sizes, bs, bz)):
            right = right[:k] + tails[at:at + n]
            left = left[:j] + before[bat:bat + m]
            at, bat = at + n, bat + m
            yield right, left, *marks[i], owners[16 * i:16 * i + 16], k


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple[tuple, int]]:
    """Merged suffixes, each with its common prefix with the one before it: a loser tree.

    A loser keeps the length of its common prefix with the winner that beat it, which is the last
    suffix put out when it is played again. Of two with different lengths the longer one is the
    smaller, without looking at a byte; with equal lengths the bytes are compared from there on.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    head: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # common prefix of each head with the last winner
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets what the loser has in common with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        n = common_prefix(x[0], y[0], ka)
        if n == len(x[0]) or n == len(y[0]):
            first = (len(x[0]), x[1], a) <= (len(y[0]), y[1], b)
        else:
            first = x[0][n] < y[0][n]
        if first:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        winner, tree[node] = play(a, b)
        return winner

    winner = build(1) if k > 1 else 0
    while head[winner] is not None:
        yield head[winner], known[winner]
        nxt = head[winner] = next(runs[winner], None)
        if nxt is not None:
            known[winner] = nxt[6]  # with its own predecessor, the suffix just put out
        node = (winner + k) >> 1
        while node:
            winner, tree[node] = play(winner, tree[node])
            node >>= 1


class Entries:
    """Sorted suffixes with what is before their anchors, as one buffer in which windows are hashed."""

    def __init__(self, entries: list[tuple], length: int):
        self.length, self.width = length, min(BLOCK, max(1, length // 2))
        texts = [e[1][::-1] + e[0][HEAD:] for e in entries]
        self.anchor, self.least, self.most = (np.array([e[k] for e in entries], dtype=np.int64) for k in (2, 3, 4))
        # where the anchors lie in the buffer
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64) + self.most
        self.total, self.down = prefix_sums(np.frombuffer(b"".join(texts), dtype=np.uint8))

    def hash(self, start: np.ndarray, end: np.ndarray, of: np.ndarray | int) -> np.ndarray:
        """Hashes of the bytes between, with what they are hashes of."""
        return mix((self.total[end] - self.total[start]) * self.down[start] ^ mix(np.asarray(of).astype(_U)))

    def block(self, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries with windows in the block of offsets (bytes from a window's start to its anchor) from ``lo`` on, and their
        largest and smallest offset there."""
        first, last = np.minimum(self.most, lo + self.width - 1), np.maximum(self.least, lo)
        who = np.flatnonzero(first >= last)
        return who, first[who], last[who]

    def windows(self, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, entry, offset) of the windows of a block, by entry and from the first to the last."""
        who, first, last = self.block(lo)
        counts = first - last + 1
        of = np.repeat(who, counts)
        offset = np.repeat(first, counts) - (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        start = self.at[of] - offset
        return self.hash(start, start + self.length, offset), of, offset

    def blocks(self) -> range:
        return range(0, int(self.most.max()) + 1, self.width)


def resolve(entries: list[tuple], length: int) -> list[tuple]:
    """(owner, first, last) runs of window starts that two of the entries, which share their anchor substring, hold."""
    parts: dict[int, list[tuple]] = {}
    for at in range(0, len(entries), TOGETHER):  # the buffers are a few hundred KB
        some = Entries(entries[at:at + TOGETHER], length)
        for lo in some.blocks():
            key, of, offset = some.windows(lo)
            parts.setdefault(lo, []).append((key, (of + at).astype(np.int32), offset.astype(np.int32)))
    found: list[tuple] = []
    for lo in sorted(parts):
        key, who, offset = (np.concatenate(x) for x in zip(*parts.pop(lo)))
        # equal windows have their anchor at the same place, so the offset is part of the hash
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        if len(at):
            # offsets fall by one along an entry's windows
            new = np.concatenate([[True], (np.diff(offset[at]) != -1) | (who[at][1:] != who[at][:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(at)]]) - 1
            found += [(entries[w][5], entries[w][2] - a, entries[w][2] - b) for w, a, b in zip(
                who[at[first]].tolist(), offset[at[first]].tolist(), offset[at[last]].tolist())]
    return found


def suffix_entries(owner: bytes, text: bytes, wanted, parts, length: int) -> Iterator[tuple]:
    """Of the anchors whose first window starts at one of ``wanted``; the anchor's hash heads the suffix."""
    for _, pos, h, least, most in parts:
        for j in np.flatnonzero(np.isin(pos - most, wanted)).tolist():
            a, lo, hi = int(pos[j]), int(least[j]), int(most[j])
            yield h[j:j + 1].byteswap().tobytes() + text[a:a + length - lo], text[a - hi:a][::-1], a, lo, hi, owner


def candidates(docs: DataFrame, length: int, gram: int, code) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wanted, starts, long). ``key``, ``firsts``, ``crowded``, ``n`` of texts that may hold repeats: the first window starts
    of their anchors that are to be sorted, or counted because their anchor is crowded. ``key``, ``first``, ``last``: runs of
    repeated window starts that need neither. ``key`` of all texts of ``length`` bytes or more, also repeatedly."""
    def count(batches):
        for pdf in batches:
            texts = [code(t) for t in pdf["text"]]
            keys = pdf["key"].tolist()
            found = []
            for i, pos, h, least, most, context in anchors(texts, length, gram, True):
                found.append((np.full(len(h), i), h, context, pos - most, pos - least))
            if found:
                who, h, context, first, last = map(np.concatenate, zip(*found))
                yield pd.DataFrame({"key": [keys[i] for i in who], "hash": h, "context": context, "first": first, "last": last})

    counted = shared_table(docs.select("key", "text").mapInPandas(
        count, "key binary, hash long, context long, first long, last long"), "anchors")
    place = F.xxhash64("key", "first")
    # ``a`` is the place that stands for its context; ``b`` differs if there is another one
    contexts = shared_table(counted.groupBy("hash", "context").agg(
        F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias(ROWS)), "contexts")
    kinds = contexts.groupBy("hash").agg(F.count("*").alias("kinds"), F.max(F.col("a") != F.col("b")).alias("again")) \
        .where("kinds > 1 or again").select("hash", "kinds", F.col("kinds").alias(ROWS))
    kept = shared_table(join_stats(contexts.withColumnRenamed(ROWS, "places"), kinds, ["hash"])
                        .withColumnRenamed("places", ROWS), "contexts-kinds")
    places = shared_table(join_stats(counted.withColumn("place", place), kept, ["hash", "context"]).select(
        "key", "first", "last", (F.col("a") != F.col("b")).alias("again"),
        F.when((F.col("kinds") > 1) & (F.col("place") == F.col("a")), F.col("kinds") > CROWD).alias("crowd"))
        .where("again or crowd is not null"), "places-kinds")
    wanted = (places.groupBy("key").agg(F.collect_set(F.when(~F.col("crowd"), F.col("first"))).alias("firsts"),
                                        F.collect_set(F.when(F.col("crowd"), F.col("first"))).alias("crowded"))
              .withColumn("n", F.size("firsts")))
    return shared_table(wanted, "wanted"), places.where("again").select("key", "first", "last"), counted.select("key")


def repeated_starts(docs: DataFrame, length: int, gram: int, code) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, starts, long): ``key``, ``text`` of texts that may hold repeats; ``key``, ``first``, ``last``: runs of
    window starts that are repeated; ``key`` of all texts of ``length`` bytes or more, also repeatedly.
    ``docs``: ``id``, ``key``, ``text``; ``code`` makes the bytes of a text."""
    wanted, again, long = candidates(docs, length, gram, code)
    # Of texts with copies only the row with the smallest id is sorted.
    first = docs.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("rep"))
    wanted = shared_table(wanted.join(first, "key").select("key", "firsts", "crowded", "n", F.col("rep.id").alias("rep_id")), "wanted-reps")
    some = marked(docs, F.xxhash64("key"), wanted.select(F.xxhash64("key"))).where("_may")
    same = (some["key"] == wanted["key"]) & some["id"].eqNullSafe(wanted["rep_id"])
    texts = shared_table(some.join(wanted.hint("merge"), same).select(wanted["key"], "text", "firsts", "crowded"), "texts")
    total, crowds = wanted.agg(F.sum("n"), F.sum(F.size("crowded"))).first()
    n_ranges = max(1, -(-(total or 0) // RANGE))
    runs = texts.where(F.size("firsts") > 0).mapInPandas(
        sorted_runs(n_ranges, length, gram, code),
        "part int, n int, shared binary, sizes binary, tails binary, before_shared binary, "
        "before_sizes binary, before_tails binary, marks binary, owners binary")

    def merge_ranges(batches):
        for g in groups(batches, ["part"]):
            for found in resolved_groups(merge([Run.decode(r) for r in g.itertuples(index=False)]), length, gram):
                yield pd.DataFrame(found, columns=["key", "first", "last"])

    sorted_out = shared_table(runs.repartition(n_ranges, "part").sortWithinPartitions("part")
                              .mapInPandas(merge_ranges, "key binary, first long, last long"), "resolved")
    starts = again.union(sorted_out)
    if crowds:
        starts = starts.union(crowded_starts(texts, length, gram, code))
    return texts.select("key", "text"), starts, long


def resolved_groups(merged: Iterator[tuple[tuple, int]], length: int, gram: int) -> Iterator[list[tuple]]:
    """Repeated runs of the neighbours that share their anchor substring. Small groups are resolved together: equal windows
    hold the same anchor substring, so none is found across groups."""
    batch: list[tuple] = []
    held: list[tuple] = []
    for entry, shared in merged:
        if held and shared < HEAD + gram:
            if len(held) > 1:
                batch += held
            held = []
            if len(batch) >= TOGETHER:
                yield resolve(batch, length)
                batch = []
        held.append(entry)
    if len(held) > 1:
        batch += held
    if batch:
        yield resolve(batch, length)


def crowded_starts(texts: DataFrame, length: int, gram: int, code) -> DataFrame:
    """``key``, ``first``, ``last`` of the repeated windows of crowded anchors."""
    def hashes(batches):
        for pdf in batches:
            codes = [code(t) for t in pdf["text"]]
            for part in anchors(codes, length, gram):
                i = part[0]
                entries = list(suffix_entries(b"", codes[i], pdf["crowded"].iloc[i], [part], length))
                if not entries:
                    continue
                all_ = Entries(entries, length)
                for lo in all_.blocks():
                    who, first, last = all_.block(lo)
                    if not len(who):
                        continue
                    key, _, _ = all_.windows(lo)
                    at = all_.at[who]
                    core = all_.hash(at - lo, at - (lo + all_.width - 1) + length, lo)
                    whole = all_.hash(at - first, at - last + length, (first << 32) + last)
                    yield pd.DataFrame({
                        "key": pdf["key"].iloc[i], "first": all_.anchor[who] - first, "last": all_.anchor[who] - last,
                        "core": core.view(np.int64), "block": whole.view(np.int64),
                        "windows": np.split(key.view(np.int64), np.cumsum(first - last + 1)[:-1])})

    rows = shared_table(texts.where(F.size("crowded") > 0).mapInPandas(
        hashes, "key binary, first long, last long, core long, block long, windows array<long>")
        .withColumn("place", F.xxhash64("key", "first")), "crowded")
    blocks = shared_table(rows.groupBy("core", "block").agg(F.min("place").alias("a"), F.count("*").alias(ROWS)), "crowded-blocks")
    found = join_stats(rows.select("key", "first", "last", "core", "block"),
                       blocks.where(F.col(ROWS) > 1).select("core", "block", ROWS), ["core", "block"]).select("key", "first", "last")
    kinds = blocks.groupBy("core").agg(F.count("*").alias(ROWS)).where(F.col(ROWS) > 1)
    alone = join_stats(rows, blocks, ["core", "block"]).where(F.col("place") == F.col("a"))
    single = shared_table(join_stats(alone.select("key", "first", "core", "windows"), kinds, ["core"])
                          .select("key", "first", F.posexplode("windows").alias("step", "hash"))
                          .select("key", (F.col("first") + F.col("step")).alias("first"), "hash"), "crowded-windows")
    twice = single.groupBy("hash").agg(F.count("*").alias(ROWS)).where(F.col(ROWS) > 1)
    return found.union(join_stats(single, twice, ["hash"]).select("key", "first", F.col("first").alias("last")))


def sorted_runs(n_ranges: int, length: int, gram: int, code):
    """Maps texts to pieces of sorted, front-coded runs, one row for each range a run reaches."""
    def part_of(entry: tuple) -> int:
        return int.from_bytes(entry[0][:HEAD], "big") % n_ranges

    def pieces(entries: list[tuple]) -> pd.DataFrame:
        entries.sort(key=lambda e: (part_of(e), *e[:2]))
        return pd.DataFrame([{"part": part, **Run.encode(list(some))} for part, some in groupby(entries, part_of)])[["part", "n", *Run.FIELDS]]

    def run(batches):
        held: list[tuple] = []
        for pdf in batches:
            texts = [code(t) for t in pdf["text"]]
            keys, firsts = pdf["key"].tolist(), pdf["firsts"].tolist()
            for part in anchors(texts, length, gram):
                i = part[0]
                held += suffix_entries(keys[i], texts[i], firsts[i], [part], length)
                if len(held) >= RUN:
                    yield pieces(held)
                    held = []
        if held:
            yield pieces(held)

    return run


def cut(raw: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, removed runs) for runs of repeated window starts."""
    kept, end, removed, spans = [], 0, 0, 0  # bytes before ``end`` are decided
    for first, last in sorted(starts):
        a, b = first, last + length
        if not spans or a > end:
            kept.append(raw[end:a])
            spans += 1
            end = a
        if b > end:
            removed += b - end
            end = b
    kept.append(raw[end:])
    return b"".join(kept), removed, spans


def cut_words(text: str, starts: list[tuple[int, int]], words: int) -> tuple[str, int, int]:
    """As ``cut``, for window starts in the text's word codes: whole words and what is between them go."""
    spans: list[list[int]] = []
    for first, last in sorted((-(-a // CODE), b // CODE) for a, b in starts):
        if first > last:
            continue  # no window of these starts at a word
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + words)
        else:
            spans.append([first, last + words])
    begin, end = char_spans(text)
    kept, at, removed = [], 0, 0
    for first, stop in spans:
        a, b = int(begin[first]), int(end[stop - 1])
        kept.append(text[at:a])
        removed += len(text[a:b].encode())
        at = b
    kept.append(text[at:])
    return "".join(kept), removed, len(spans)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def outcomes(docs: DataFrame, length: int, gram: int, with_text: bool, words: int | None = None) -> DataFrame:
    """``key``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked, ``kept`` (text; parts of
    characters go) of every text that loses bytes. ``docs``: ``id``, ``key``, ``text``. With ``words``, strings
    of so many words count, whatever their bytes."""
    if words:
        length, gram = words * CODE, max(1, min(GRAM_WORDS, words // 2)) * CODE
    texts, starts, long = repeated_starts(docs, length, gram, word_codes if words else text_bytes)
    found = texts.join(starts.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("starts")), "key")

    def run(batches):
        for pdf in batches:
            out = []
            for key, text, starts_ in zip(pdf["key"], pdf["text"], pdf["starts"]):
                found_ = [(s["first"], s["last"]) for s in starts_]
                if words:
                    kept, removed, spans = cut_words(text, found_, words)
                    raw = kept.encode()
                    if not spans:
                        continue
                else:
                    raw, removed, spans = cut(text.encode(), found_, length)
                    kept = raw.decode("utf-8", "ignore") if with_text else None
                out.append((key, removed, spans, hashlib.sha256(raw).hexdigest(), kept if with_text else None))
            yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "kept_sha256", "kept"]).drop_duplicates("key")

    single = found.mapInPandas(run, "key binary, n_removed long, n_spans long, kept_sha256 string, kept string")
    copies = (docs.select("key", F.octet_length("text").cast("long").alias("n"))
              .where(F.col("n") >= (words or length)).groupBy("key", "n").agg(F.count("*").alias("rows")).where("rows > 1")
              .select("key", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                      F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept")))
    if words:
        copies = copies.join(long, "key", "left_semi")
    copies = shared_table(copies, "copied-texts")
    return shared_table(single.join(copies.select("key"), "key", "left_anti").union(copies), "outcomes")


def with_lost(rows: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``lost`` on ``key``; texts that lose nothing take no part in the shuffle."""
    rows = marked(rows, F.xxhash64(key), lost.select(F.xxhash64(key)))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in lost.dtypes if c != key]
    untouched = rows.where("not _may").drop("_may").select("*", *nothing)
    return untouched.unionByName(rows.where("_may").drop("_may").join(lost.hint("merge"), key, "left"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            gram: int = GRAM) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (of the remaining bytes),
    ``kept_text`` (what remains, without parts of characters)."""
    rows = keyed(docs, id_col, text_col)
    lost = outcomes(rows, length, gram, True).withColumnRenamed("kept_sha256", "sha")
    plain = rows.select("id", "key", "text", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return with_lost(plain, lost, "key").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
        F.when(F.col("n_removed").isNotNull(), F.col("kept")).otherwise(F.col("text")).alias("kept_text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text, or with ``words`` the repeated strings of so many
    words; same columns and rows."""
    lost = outcomes(keyed(docs, id_col, text_col), length, gram, True, words).select(
        F.col("key").alias("_key"), F.col("kept").alias("_kept"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = with_lost(docs.withColumn("_key", F.unhex(F.md5(text.cast("binary")))), lost, "_key")
    clean = F.when(F.col("_kept").isNotNull(), F.col("_kept")).otherwise(F.col(text_col))
    return out.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
