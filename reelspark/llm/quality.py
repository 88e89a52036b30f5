"""Operator 4 — quality rules with compression bands.

Base counts of every text, and a verdict from zstandard ratios (compressed over plain bytes): the
whole text's ratio must lie in the band of its length, and of its fixed chunks at most
``bad_chunks`` may lie outside the chunk band. A low ratio means repetition, a high one noise.
Noise is also looked for in smaller pieces, as it fills a chunk only in part at its ends. What is left
behind the last chunk or piece is judged as the last full one from the text's end.
Short texts have no band: their ratio says little.

Null and empty texts have no words; they fail the base rules. Repeated rows give one row each.
Extra columns are not read by ``rate``; ``keep_clean`` returns all columns as they came. A text is
held once with its words; nothing else grows with its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (bytes from, lowest ratio, highest ratio) of whole texts; below the first no band holds.
BANDS = ((200, 0.25, 0.95), (1_000, 0.20, 0.80), (5_000, 0.15, 0.75))
#: Size of the fixed chunks, and their band.
CHUNK_BYTES, CHUNK_BAND = 4_096, (0.12, 0.70)
#: Size of the pieces, the highest ratio of a clean one, and the share of noisy ones that a text may hold.
#: Of the documents at hand clean text has at most 0.603 for 1 KiB and 0.484 for 4 KiB; random base64 has
#: 0.797 and 0.761, random printable ASCII 0.871 and 0.836. Hex (0.541, 0.522) is too near to text.
NOISE = (1_024, 0.70, 0.20)

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list) -> int:
    """Words covered by windows of eight words that the text holds twice or more."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(_WINDOW):
        key = (key ^ (key >> np.uint64(29))) * _MIX + one[k:k + n]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + _WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def outside(raw: bytes, compress, size: int, low: float, high: float) -> float:
    """Share of the text's parts of ``size`` bytes whose ratio is not in the band; 0 for a shorter text."""
    if len(raw) < size:
        return 0.0
    starts = list(range(0, len(raw) - size + 1, size))
    if len(raw) % size:
        starts.append(len(raw) - size)
    return sum(not low <= len(compress(raw[k:k + size])) / size <= high for k in starts) / len(starts)


def in_bands(raw: bytes, compress, bands, chunk_bytes: int, chunk_band, bad_chunks: float, noise=NOISE) -> bool:
    """The verdict on one text."""
    n = len(raw)
    band = next((b for b in reversed(bands) if n >= b[0]), None)
    if band is None:
        return True
    if not band[1] <= len(compress(raw)) / n <= band[2]:
        return False
    size, high, share = noise
    return (outside(raw, compress, chunk_bytes, *chunk_band) <= bad_chunks
            and outside(raw, compress, size, 0.0, high) <= share)


def rater(bands=BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND, bad_chunks=0.3, noise=NOISE):
    """text → (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress

    def rate(text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.split()
        repeated = repeated_words(words)
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        return (len(words), len(text or "") - (len(raw) - len(raw.translate(None, _SPACE))),
                len(raw) - len(raw.translate(None, _SYMBOLS)), duplicate_lines(raw), repeated, failed,
                not failed and in_bands(raw, compress, bands, chunk_bytes, chunk_band, bad_chunks, noise))

    return rate


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "kept"]


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: ``id_col``, the five counts, ``base_failed``, ``kept``."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        one = rater(**limits)
        for pdf in batches:
            out = pd.DataFrame([one(t) for t in pdf["text"]], columns=_COLUMNS)
            out.insert(0, id_col, pdf[id_col].to_numpy())
            yield out

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInPandas(run, f"`{id_col}` {kind}, " + ", ".join(
        f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in _COLUMNS))


def keep_clean(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    def verdict(texts: pd.Series) -> pd.Series:
        one = rater(**limits)
        return pd.Series([one(t)[-1] for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(verdict, "boolean")(F.col(text_col).cast("string")))
