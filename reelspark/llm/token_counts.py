"""Operator 1 — token counts with overlap resynchronisation.

A text of up to ``chunk_bytes`` bytes is encoded whole. A longer one is encoded in
overlapping chunks with the offsets of their tokens, and the counts are spliced.

Why a splice is proven right: in byte-pair encoding a sequence of tokens is the encoding of its
text exactly if every two neighbours are the encoding of their own text — whether a merge
crosses the border between two tokens depends on these two alone. Where both chunks hold the same two
tokens [s, b) and [b, e) side by side, the left chunk's tokens up to ``b`` and the right chunk's from
``b`` on form a sequence whose neighbours all stood side by side in one of the two encodings. So
the splice equals the encoding of the whole. When the overlap holds no such pair, it is widened
(doubled) and the right chunk encoded again, in the end from the left chunk's start.

Null and empty texts have 0 tokens. Repeated rows give one row each. Extra columns are not read. The memory
needed is that of one batch of texts plus the pieces of one chunk.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_trie import by_chars


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Encoded:
    """A chunk's tokens with their byte offsets in the whole text."""

    def __init__(self, model, text: bytes, start: int, end: int):
        self.start, self.end = start, end
        self.pieces = model.encode(text[start:end].decode(), return_type="proto").pieces
        self.n = len(self.pieces)

    def at(self, i: int) -> tuple[int, int, int]:
        """(first byte, end, id) of token ``i``."""
        p = self.pieces[i]
        return self.start + p.begin, self.start + p.end, p.id


def common_border(left: Encoded, right: Encoded) -> tuple[int, int] | None:
    """(tokens of ``left`` before the splice, tokens of ``right`` before it), or None.

    Looks for two neighbouring tokens that both chunks share, from the middle of the overlap on
    to both sides. Tokens without characters of their own (parts of a character written as
    bytes, the blank put before a chunk) never border a splice.
    """
    seen: dict[tuple, int] = {}
    after = None
    for i in range(left.n - 1, -1, -1):
        t = left.at(i)
        if after is not None and t[0] < t[1] and after[0] < after[1]:
            seen[(t, after)] = i + 1
        if t[1] < right.start:
            break
        after = t
    # The last token of a chunk may have been cut off, and the first one holds the blank that
    # the model puts before a text.
    before = None
    for j in range(right.n):
        t = right.at(j)
        if t[0] > left.end:
            break
        if before is not None and before[0] > right.start and t[1] < left.end:
            i = seen.get((before, t))
            if i is not None:
                return i, j
        before = t
    return None


def character_start(text: bytes, at: int) -> int:
    """The nearest place at or before ``at`` where a character starts."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_long(model, text: bytes, chunk: int, overlap: int) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of a UTF-8 text longer than a chunk; sizes in bytes."""
    left = Encoded(model, text, 0, character_start(text, chunk))
    total, skipped, chunks, widened = 0, 0, 1, 0
    while left.end < len(text):
        end = character_start(text, left.end + chunk) if left.end + chunk < len(text) else len(text)
        wide = overlap
        while True:
            start = character_start(text, max(0, left.end - wide))
            # An overlap that reaches the start of the text leaves nothing to splice.
            right = Encoded(model, text, start, end)
            if start == 0:
                total = skipped = 0
                break
            border = common_border(left, right) if start > left.start else None
            if border is not None and border[0] > skipped:
                total += border[0] - skipped
                skipped = border[1]
                break
            if start <= left.start:
                # Not even the whole left chunk has a border: start over, as one chunk.
                start, total, skipped = 0, 0, 0
                right = Encoded(model, text, 0, end)
                break
            wide *= 2
            widened += 1
        left = right
        chunks += 1
    return total + left.n - skipped, chunks, widened


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk_bytes: int = 32_768, overlap_bytes: int = 256, limit: int = 4096,
                 batch_chars: int = 4_000_000) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (more than ``limit`` tokens), ``n_chunks``, ``n_widened``."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = piece_model(model_path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for s in by_chars(texts, batch_chars):
                some, sizes = texts[s], [len(t.encode()) for t in texts[s]]
                short = [i for i, n in enumerate(sizes) if n <= chunk_bytes]
                found = {i: (len(x), 1, 0) for i, x in zip(
                    short, model.encode([some[i] for i in short], num_threads=1))}
                for i, t in enumerate(some):
                    if i not in found:
                        found[i] = count_long(model, t.encode(), chunk_bytes, overlap_bytes)
                n, chunks, widened = zip(*(found[i] for i in range(len(some))))
                yield pd.DataFrame({
                    id_col: pdf[id_col].iloc[s], "n_bytes": sizes, "n_tokens": n,
                    "over_limit": [x > limit for x in n], "n_chunks": chunks,
                    "n_widened": widened})

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInPandas(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, "
                                "over_limit boolean, n_chunks int, n_widened int")
