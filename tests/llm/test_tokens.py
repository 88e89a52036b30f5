"""Operators 1, 6 and 8 against the tokenizer libraries."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from reelspark.llm import bpe_trie, packing, token_counts  # noqa: E402

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def texts():
    rng = random.Random(5)
    words = ["the", "of", "Über", "naïve", "don't", "I'll", "x1", "2024", "###", "a'b", "être,", "é", "бa", "你好", "🙂"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n ", " ", "\x1c", "\x85", ""]
    out = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return [None, "", " ", "\n\n\n", "a<|endoftext|>b <|endoftext|> c", "  <|endoftext|>", "aaaaaaaa" * 60, " " * 70 + "q",
            "ab" * 5000, "The end.\n\nNew  line\n x", *out]


def test_trie_ids_are_the_librarys(library):
    enc = bpe_trie.trie_encoder(BYTE)
    some = [t or "" for t in texts()]
    for t, got in zip(some, enc.encode_batch(some)):
        want = library.encode(t, add_special_tokens=False).ids
        assert bpe_trie.integers(got) == want, t[:80]
        assert enc.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("ab éß\n\t'.,1"))), max_size=60))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    library = test_ids_of_any_text.__dict__.setdefault("library", Tokenizer.from_file(BYTE))
    want = library.encode(text, add_special_tokens=False).ids
    assert bpe_trie.integers(bpe_trie.trie_encoder(BYTE).encode_batch([text])[0]) == want
    assert packing.id_encoder(BYTE)(text) == want


def test_shared_prefixes():
    words = sorted({b"", b"a", b"ab", b"abc", b"abd", b"b" * 40, b"b" * 41, b"b" * 39 + b"c"})
    got = bpe_trie.shared_prefixes(words)
    for k in range(1, len(words)):
        n = 0
        while n < min(len(words[k]), len(words[k - 1])) and words[k][n] == words[k - 1][n]:
            n += 1
        assert got[k] == n


def test_round_trip_query(frame, library):
    rows = [(i, t, "s", "en") for i, t in enumerate(texts())] + [(None, "null id", "s", "en"), (1, "", "s", "en")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe_trie.round_trip(frame(rows), BYTE).collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_trie.round_trip(frame([]), BYTE).collect() == []


def test_encode_then_decode(frame):
    rows = [(i, t, "s", "en") for i, t in enumerate(texts())]
    back = bpe_trie.decode(bpe_trie.encode(frame(rows), BYTE), BYTE).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t, *_ in rows}


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (500, 16), (4096, 64)])
def test_spliced_counts(chunk, overlap):
    model = token_counts.piece_model(PIECE)
    rng = random.Random(3)
    long = ["a" * 900, "é 你好" * 300, "ab " * 700, " " * 999 + "x", "\n" * 500, "🙂" * 300,
            *("".join(rng.choice(["the ", "ing", "ß", "x\n", "  ", "你", "qu", "1", "."]) for _ in range(900)) for _ in range(6))]
    widened = 0
    for t in long:
        raw = t.encode()
        n, _, w = token_counts.count_long(model, raw, chunk, overlap) if len(raw) > chunk else (len(model.encode(t)), 1, 0)
        assert n == len(model.encode(t)), t[:30]
        widened += w
    assert widened or chunk > 64  # the widening is used


def test_token_counts(frame):
    model = token_counts.piece_model(PIECE)
    rows = [(i, t, "s", "en") for i, t in enumerate([*texts(), "word and more " * 3000])] + [(1, "", "s", "en")]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_counts.count_tokens(frame(rows), PIECE, chunk_bytes=2000).collect())
    assert got == sorted((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in rows)
    assert token_counts.count_tokens(frame([]), PIECE).collect() == []


def packed(rows, seq_len):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= seq_len
    return by_doc, {s: sum(n for _, n in p) for s, p in by_seq.items()}


def test_packing(frame, library):
    rows = [(i, t, "s", "en") for i, t in enumerate([*texts(), "some words here " * 2000])]
    got = packing.pack(frame(rows).repartition(2), BYTE, seq_len=128, keep_ids=True).collect()
    by_doc, fill = packed(got, 128)
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(ids)
        for r in got:
            if r.doc_id == i:
                piece = ids[r.start:r.start + r.length]
                assert r.ids == piece and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
    assert sum(128 - n for n in fill.values()) < 2 * 128  # under one sequence for each task
    assert packing.pack(frame([]), BYTE).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_pack_lengths(lengths):
    pieces = packing.pack_lengths(lengths, 16)
    seen, seqs = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        seen[d].append((s, n))
        seqs[q].append((o, n))
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == dict(enumerate(lengths))
    for p in [*seen.values(), *seqs.values()]:
        at = 0
        for s, n in sorted(p):
            assert s == at
            at += n
    assert len(seqs) == -(-sum(lengths) // 16)
    assert all(sum(n for _, n in p) <= 16 for p in seqs.values())


def test_packing_balances_cost():
    """Two long and four short pieces in two sequences: each gets one long and two short ones."""
    pieces = packing.pack_lengths([10, 10, 3, 3, 3, 3], 16)
    per = defaultdict(list)
    for _, _, n, q, _ in pieces:
        per[q].append(n)
    assert sorted(map(sorted, per.values())) == [[3, 3, 10], [3, 3, 10]]
