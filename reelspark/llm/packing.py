"""Operator 6 — cost-balanced packing of token ids into training sequences.

Each task tokenizes its documents, appends the end id and works on groups of at most
``group_tokens`` ids. In a group the number of sequences is the least that can hold the ids.
Pieces of a full sequence's length are cut off first; the remainders are taken by descending
estimated cost — linear plus quadratic in their length, as attention costs — and each goes to
the sequence of the lowest cost so far that still has room for it. What fits nowhere whole is cut
over the roomiest sequences. So all sequences of a group but the last bits are full: padding is
under one sequence a group.

No rows are shuffled: a group never leaves its task, and its numbers follow from the partition
number and the order of rows in it, so a lost task gives the same sequences when run again.

Null and empty texts are one end id. Repeated rows are packed each on its own. Ties go to the
sequence with the smaller number. Extra columns are not read. A text longer than a group makes a
group of its own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PRETOKEN, vocabulary

#: Sequence numbers: partition, group in it, sequence in the group.
_GROUP_BITS, _SEQUENCE_BITS = 20, 18


@lru_cache(maxsize=4)
def id_encoder(path: str):
    """text → list of ids, as the ``tokenizers`` file at ``path`` gives them.

    The ids come from the same vocabulary through ``tiktoken``, five times as fast; that needs
    ids in merge order, and is checked.
    """
    import tiktoken

    v = vocabulary(path)
    if not v.ordered:
        raise ValueError(f"{path}: token ids are not in merge order")
    coder = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=v.ids, special_tokens={})

    def ids(text: str) -> list[int]:
        out: list[int] = []
        for segment, special in v.segments(text):
            out += coder.encode_ordinary(segment)
            if special is not None:
                out.append(special)
        return out

    return ids


def cost(length: int, seq_len: int) -> float:
    """Linear plus quadratic cost of a piece, the two equal at a full sequence."""
    return length + length * length / seq_len


def pack_lengths(lengths: Iterable[int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; see the module's text."""
    lengths = list(lengths)
    total = sum(lengths)
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start
    seq = 0
    for d, n in enumerate(lengths):
        full = n // seq_len
        for k in range(full):
            out.append((d, k * seq_len, seq_len, seq, 0))
            seq += 1
        if n % seq_len:
            rest.append((n % seq_len, d, full * seq_len))
    first, count = seq, -(-total // seq_len) - seq
    used = [0] * count
    # Lowest cost first; a sequence too full for the piece at hand waits for shorter ones.
    heap = [(0.0, s) for s in range(count)]
    waiting: list[tuple[int, float, int]] = []  # -room, cost, sequence
    spill: list[tuple[int, int, int]] = []
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rest:
        while waiting and -waiting[0][0] >= n:
            _, c, s = heapq.heappop(waiting)
            heapq.heappush(heap, (c, s))
        placed = False
        while heap:
            c, s = heapq.heappop(heap)
            room = seq_len - used[s]
            if room >= n:
                out.append((d, start, n, first + s, used[s]))
                used[s] += n
                heapq.heappush(heap, (c + cost(n, seq_len), s))
                placed = True
                break
            if room:
                heapq.heappush(waiting, (-room, c, s))
        if not placed:
            spill.append((n, d, start))
    # What found no room whole is cut, roomiest sequence first.
    room = sorted(((seq_len - u, s) for s, u in enumerate(used) if u < seq_len),
                  key=lambda x: (-x[0], x[1]))
    k = 0
    for n, d, start in spill:
        while n:
            free, s = room[k]
            take = min(free, n)
            out.append((d, start, take, first + s, used[s]))
            used[s] += take
            n, start = n - take, start + take
            room[k] = (free - take, s)
            k += free == take
    return out


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
         seq_len: int = 1024, end_id: int = 0, group_tokens: int = 4_000_000,
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, with ``keep_ids``, the piece's ``ids``."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long" + ", ids array<int>" * keep_ids)

    def rows(keys: list, ids: list[np.ndarray], part: int, group: int) -> pd.DataFrame:
        pieces = pack_lengths(map(len, ids), seq_len)
        base = (part << (_GROUP_BITS + _SEQUENCE_BITS)) + (group << _SEQUENCE_BITS)
        out = {
            id_col: pd.Series([keys[d] for d, *_ in pieces], dtype=object),
            "start": [p[1] for p in pieces],
            "length": [p[2] for p in pieces],
            "ids_crc32": [zlib.crc32(ids[d][s:s + n].tobytes()) for d, s, n, _, _ in pieces],
            "doc_tokens": [len(ids[p[0]]) for p in pieces],
            "sequence_id": [base + p[3] for p in pieces],
            "offset": [p[4] for p in pieces],
        }
        if keep_ids:
            out["ids"] = [ids[d][s:s + n].tolist() for d, s, n, _, _ in pieces]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = id_encoder(vocab_path)
        part, group, size = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ids: list[np.ndarray] = []
        for pdf in batches:
            for key, text in zip(pdf[id_col].astype(object), pdf["text"]):
                x = np.array([*encode(text or ""), end_id], dtype="<u4")
                if size and size + len(x) > group_tokens:
                    yield rows(keys, ids, part, group)
                    keys, ids, size, group = [], [], 0, group + 1
                keys.append(None if pd.isna(key) else key)
                ids.append(x)
                size += len(x)
        if ids:
            yield rows(keys, ids, part, group)

    return src.mapInPandas(run, schema)
