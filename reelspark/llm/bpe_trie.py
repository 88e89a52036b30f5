"""Operator 8 — BPE encoding and decoding by prefix-sharing trie traversal.

Each task takes the distinct words of a batch of texts, walks them in sorted order — which is the
depth-first order of their trie — and keeps, for every byte on the current path, the *last
token* of the encoding of that prefix. A word that shares a prefix with the word before it
starts from the shared states, so the encoding of a common prefix is worked out once, and only
where a word asks for it. The last token of a prefix is the one vocabulary string that ends it
and may follow the last token of what stands before; a word's ids are read back along these
states.

Empty and null texts encode to no ids. Repeated rows and ties give one row each. Extra columns
are not read. Very long texts are split at word boundaries that no pre-token spans, so the
distinct words held at a time are bounded by ``batch_chars``, except for one text's own words.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteVocabulary, byte_alphabet, vocabulary

_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
# Units a text is cut into: a word with the blank before it (and what an apostrophe joins to it);
# what stands up to the next word; or both in one, where the pre-tokens of one depend on the
# other (an apostrophe, or white space of which only the last character goes with the word).
_UNITS = re.compile(rf" ?[{_L}]+(?:'[{_L}']*)?"
                    rf"|[^{_L}]+?(?:(?= [{_L}])|\Z|(?<!\s[^\S ])(?<!['])(?=[{_L}]))"
                    rf"|[^{_L}]+[{_L}]+(?:'[{_L}']*)?")
# Letters beyond Latin-1 may continue a word; such texts are cut before a blank and a letter only.
_WIDE = re.compile(r"[^\x00-\xff]")
_WIDE_UNIT = re.compile(r"(?= [A-Za-z])")
_PLAIN = re.compile(rf" ?[{_L}]+|[,.;:!?#*$%&|)]+")
_INF = float("inf")


class TrieEncoder:
    """Encodes many words at once; keeps learned pair decisions between calls."""

    #: Pair decisions kept between calls; above it the table is emptied.
    MAX_PAIRS = 1_000_000
    #: Words kept for the next batch; above it only those of the last batch stay.
    MAX_WORDS = 300_000
    #: Words longer than this have all their states filled from the front, so that looking
    #: back from the end never nests deep.
    DEEP = 200

    def __init__(self, v: ByteVocabulary, path: str):
        from tokenizers import Tokenizer

        self.v = v
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.alphabet = byte_alphabet()
        self.pairs: dict[int, bool] = {}
        self.kept: dict[bytes, bytes] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        # Length of the longest token with given last four bytes; others have three at most.
        self.longest: dict[bytes, int] = {}
        for b in v.ids:
            if len(b) > 3:
                self.longest[b[-4:]] = max(self.longest.get(b[-4:], 0), len(b))

    def _chain(self, t: int, side: int) -> list[tuple[int, float]]:
        """What stands at one edge while ``t`` is built: (token, rank at which it is merged)."""
        out: list[tuple[int, float]] = []
        until = _INF
        while True:
            out.append((t, until))
            pair = self.v.parts.get(t)
            if pair is None:
                return out[::-1]
            until, t = self.v.rank[pair], pair[side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``b`` stays a token of its own when it follows ``a``: while both are built
        merge by merge, no merge across their border comes first."""
        ra = self.right.get(a) or self.right.setdefault(a, self._chain(a, 1))
        lb = self.left.get(b) or self.left.setdefault(b, self._chain(b, 0))
        i = j = 0
        rank = self.v.rank
        while True:
            (x, until_x), (y, until_y) = ra[i], lb[j]
            c = rank.get((x, y))
            if c is not None and c < until_x and c <= until_y:
                return False
            if until_x <= until_y:
                if until_x == _INF:
                    return True
                i += 1
            else:
                j += 1

    def words(self, distinct: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct word, by one depth-first walk over their trie."""
        if len(self.pairs) > self.MAX_PAIRS:
            self.pairs.clear()
        last: list[int] = [-1]
        pieces, deep, state, out = self.v.pieces, self.DEEP, self._state, {}
        distinct.sort()
        for w, shared in zip(distinct, shared_prefixes(distinct)):
            n = len(w)
            del last[shared + 1:]
            last += [-1] * (n - shared)
            if n > deep:
                for i in range(shared + 1, n):
                    state(w, i, last)
            t = last[n] if last[n] >= 0 else state(w, n, last)
            i = n - len(pieces[t])
            if not i:
                out[w] = t.to_bytes(4, "little")
                continue
            back = [t]
            while i:
                t = last[i]
                back.append(t)
                i -= len(pieces[t])
            out[w] = little(back[::-1])
        return out

    def _state(self, w: bytes, i: int, last: list[int]) -> int:
        """Last token of the encoding of ``w[:i]``, set in ``last`` (-1: not known yet)."""
        ids, pairs = self.v.ids, self.pairs
        for p in range(max(0, i - self.longest.get(w[i - 4:i], 3)) if i > 3 else 0, i):
            t = ids.get(w[p:i])
            if t is None:
                continue
            if p:
                a = last[p]
                if a < 0:
                    a = self._state(w, p, last)
                key = a << 20 | t
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self.may_follow(a, t)
                if not ok:
                    continue
            last[i] = t
            return t
        raise ValueError("a byte is missing in the vocabulary")

    def pretokens(self, unit: str) -> list[bytes]:
        alphabet = self.alphabet
        return [bytes(map(alphabet.__getitem__, s))
                for s, _ in self.splitter.pre_tokenize_str(unit)]

    def units(self, segment: str) -> list[str]:
        """``segment`` cut at places where a pre-token always ends."""
        if not segment:
            return []
        if not _WIDE.search(segment):
            units = _UNITS.findall(segment)
            if sum(map(len, units)) == len(segment):
                return units
        return _WIDE_UNIT.split(segment)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        split = [[(self.units(segment), special) for segment, special in self.v.segments(text)]
                 for text in texts]
        distinct: set[str] = set()
        for parts in split:
            for units, _ in parts:
                distinct.update(units)
        distinct.discard("")
        plain = {u: u.encode() for u in distinct if _PLAIN.fullmatch(u)}
        cut = {u: self.pretokens(u) for u in distinct if u not in plain}
        asked = {*plain.values(), *chain.from_iterable(cut.values())}
        known = self.kept
        new = self.words([w for w in asked if w not in known])
        if len(known) + len(new) > self.MAX_WORDS:
            known = self.kept = {w: known[w] for w in asked if w in known}
        known |= new
        table = {u: known[w] for u, w in plain.items()}
        table |= {u: b"".join(map(known.__getitem__, ws)) for u, ws in cut.items()}
        table[""] = b""
        return [b"".join(chain.from_iterable(
            (*map(table.__getitem__, units), b"" if special is None else little([special]))
            for units, special in parts)) for parts in split]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.v.pieces.__getitem__, ids)).decode("utf-8", "replace")


def little(ids: list[int]) -> bytes:
    """``ids`` as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def integers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


def shared_prefixes(words: list[bytes], width: int = 32) -> list[int]:
    """For sorted words, how many first bytes each shares with the one before it.

    Compared ``width`` bytes wide at once; the few longer matches go on byte by byte.
    """
    if not words:
        return []
    grid = np.zeros((len(words), width), dtype=np.uint8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    cut = np.minimum(lengths, width)
    flat = np.frombuffer(b"".join(w[:width] for w in words), dtype=np.uint8)
    grid[np.arange(width) < cut[:, None]] = flat
    differs = grid[1:] != grid[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    shared = np.concatenate([[0], np.minimum(first, np.minimum(cut[1:], cut[:-1]))])
    out = shared.tolist()
    for k in np.flatnonzero((shared == width)).tolist():
        a, b, n = words[k - 1], words[k], width
        top = min(len(a), len(b))
        while n < top and a[n] == b[n]:
            n += 1
        out[k] = n
    return out


_ENCODERS: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(vocabulary(path), path)
    return _ENCODERS[path]


def by_chars(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of ``texts`` of at most ``most`` characters (one text at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
           batch_chars: int = 12_000_000) -> DataFrame:
    """``id_col``, ``ids`` (array of int) of every text."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = trie_encoder(vocab_path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for s in by_chars(texts, batch_chars):
                yield pd.DataFrame({id_col: pdf[id_col].iloc[s],
                                    "ids": [integers(x) for x in enc.encode_batch(texts[s])]})

    return src.mapInPandas(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``text`` decoded from ``ids`` (null ids: empty)."""
    src = encoded.select(F.col(id_col), "ids")

    def run(batches):
        enc = trie_encoder(vocab_path)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col],
                                "text": [enc.decode([] if x is None else x) for x in pdf["ids"]]})

    return src.mapInPandas(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
               batch_chars: int = 12_000_000) -> DataFrame:
    """Encode and decode every text in one pass; digests of both directions.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers), ``decoded_sha256`` (decoded text in UTF-8).
    """
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = trie_encoder(vocab_path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for s in by_chars(texts, batch_chars):
                ids = enc.encode_batch(texts[s])
                yield pd.DataFrame({
                    id_col: pdf[id_col].iloc[s],
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(enc.decode(integers(x)).encode()).hexdigest()
                                       for x in ids]})

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInPandas(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, "
                                "decoded_sha256 string")
