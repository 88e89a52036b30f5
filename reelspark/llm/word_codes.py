"""Texts as codes of equal size, one for each word, so that words can be compared as bytes are.

Words are separated by white space. In scripts that set none between words (Han, Kana, Thai, Lao, Khmer,
Burmese) every character is a word, and a word of more than ``LONGEST`` characters counts as pieces of
``PIECE`` characters, so that unbroken text has words too. Words are equal if all their characters are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import _powers, mix

#: Bytes of a word's code. Only the first byte has its high bit set, so that equal codes start together.
CODE = 6
LONGEST, PIECE = 64, 8
#: Characters looked at together (a multiple of ``PIECE``).
BLOCK = 1 << 20
_U = np.uint64
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_LETTERS = mix(np.arange(1, 0x3002, dtype=_U)) | _U(1)
_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
          (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _blocks(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, characters, starts, ends) of words, a block of the text at a time."""
    at = 0
    while at < len(text):
        c = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le"), dtype="<u4")
        n = len(c)
        flag = np.zeros(n + 2, dtype=bool)
        flag[1:-1] = ~_SPACE[c] if n and c.max() <= 0x3000 else ~((c <= 0x3000) & _SPACE[np.minimum(c, 0x3000)])
        inside, before, after = flag[1:-1], flag[:-2], flag[2:]
        first, last = inside & ~before, inside & ~after
        if n and c.max() >= _ALONE[0][0]:
            alone = np.zeros(n, dtype=bool)
            for low, high in _ALONE:
                alone |= (c >= low) & (c <= high)
            first |= alone
            first[1:] |= alone[:-1] & inside[1:]
            last |= alone
            last[:-1] |= alone[1:] & inside[:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        step = n
        if at + n < len(text) and len(start) > 1 and end[-1] == n:
            step = int(start[-1])  # the last word may go on: it is looked at again
            start, end = start[:-1], end[:-1]
        size = end - start
        if len(size) and size.max() > LONGEST:
            pieces = np.where(size > LONGEST, -(-size // PIECE), 1)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            many, stop = np.repeat(pieces > 1, pieces), np.repeat(end, pieces)
            start = np.repeat(start, pieces) + k * PIECE
            end = np.where(many, np.minimum(start + PIECE, stop), stop)
        yield at, c, start, end
        at += step


def char_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word, in characters."""
    found = [(start + at, end + at) for at, _, start, end in _blocks(text)]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def word_codes(text: str | None) -> bytes:
    """The codes of all words, one after the other; the same on every machine."""
    up, down = _powers(BLOCK)
    out = []
    for _, c, start, end in _blocks(text or ""):
        total = np.zeros(len(c) + 1, dtype=_U)
        letters = _LETTERS[c] if len(c) and c.max() <= 0x3000 else mix(c.astype(_U) + _U(1)) | _U(1)
        np.cumsum(letters * up[:len(c)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h = mix(h ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93)))
        code = np.empty((len(h), CODE), dtype=np.uint8)
        for k in range(CODE):
            code[:, k] = (h >> _U(7 * k)) & _U(127)
        code[:, 0] |= 128
        out.append(code.tobytes())
    return b"".join(out)
