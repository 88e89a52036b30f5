"""The byte-level BPE vocabulary and its pre-tokens, shared by encoding and packing."""

from __future__ import annotations

import json
from functools import lru_cache

# Fixed pattern of the byte-level pre-tokenizer.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
            r"|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """Character → byte of the printable alphabet that byte-level vocabularies are written in.

    Printable Latin-1 bytes stand for themselves; the others take, in order, the characters
    from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteVocabulary:
    """Token bytes, merge ranks and special strings of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()
                    if s not in self.special}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.pieces: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.pieces[i] = b
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = r
            self.parts[self.ids[a + b]] = pair
        # A token formed by the r-th merge must be the r-th after the bytes: only then are
        # ranks by id (as used for packing) and ranks by merge the same order.
        self.ordered = all(self.ids[self.pieces[a] + self.pieces[b]] == 256 + r
                           for (a, b), r in self.rank.items())

    def segments(self, text: str):
        """Split ``text`` at special strings: yields (segment, id of the special after it)."""
        if not any(s in text for s in self.special):
            yield text, None
            return
        at = 0
        while True:
            hits = [(p, -len(s), s) for s in self.special if (p := text.find(s, at)) >= 0]
            if not hits:
                yield text[at:], None
                return
            p, _, s = min(hits)
            yield text[at:p], self.special[s]
            at = p + len(s)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteVocabulary:
    """The vocabulary at ``path`` (it must exist at this path on every executor)."""
    return ByteVocabulary(path)
