"""Word-shingle sets of many texts at once, with the same 64-bit hashes on every machine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_SPACES = b" \t\n\r\x0b\x0c"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _BASE) | _U(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, dtype=_U), np.full(n, inverse, dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in a buffer; words are separated by ASCII white space."""
    raw = np.frombuffer(buffer, dtype=np.uint8)
    inside = np.ones(256, dtype=bool)
    inside[list(_SPACES)] = False
    flag = np.zeros(len(raw) + 2, dtype=np.int8)
    flag[1:-1] = inside[raw]
    edge = np.diff(flag)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(12, int(len(raw)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum(_letters()[raw] * up[:len(raw)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93))), start, end


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, A-Z in lower case; a text of
    fewer words has the whole sequence as one, a text without words none."""
    raws = [(t or "").encode().lower() for t in texts]
    out: list[np.ndarray] = []
    for part in _parts(raws, 1 << 20):
        buffer = b"\n".join(part)
        if not buffer.strip(_SPACES):
            out += [np.empty(0, dtype=_U)] * len(part)
            continue
        h, start, _ = word_hashes(buffer)
        ends = np.cumsum([len(r) + 1 for r in part])
        cut = np.searchsorted(start, ends)
        n = max(len(h) - k + 1, 0)
        rolled = np.zeros(n, dtype=_U)
        for i in range(k):
            rolled = mix(rolled + _U(i + 1)) + h[i:i + n]
        rolled = mix(rolled)
        a = 0
        for b in cut.tolist():
            if b - a >= k:
                out.append(np.unique(rolled[a:b - k + 1]))
            elif b > a:
                one = np.array([b - a], dtype=_U) * _BASE
                for x in h[a:b]:
                    one = mix(one) ^ x
                out.append(mix(one))
            else:
                out.append(np.empty(0, dtype=_U))
            a = b
    return out


def _parts(raws: list[bytes], most: int) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for r in raws:
        if part and size + len(r) > most:
            yield part
            part, size = [], 0
        part.append(r)
        size += len(r) + 1
    if part:
        yield part


def minwise(sets: list[np.ndarray], t: int, seed: int = 7) -> np.ndarray:
    """``t`` minwise values (32 bits) of each set; zeros for an empty set."""
    out = np.zeros((len(sets), t), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    x = (flat >> _U(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 1 << 31, size=t, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, size=t, dtype=np.uint64).astype(np.uint32)
    for j in range(t):
        v = (x ^ flip[j]) * odd[j]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[full, j] = np.minimum.reduceat(v, starts)
    return out
