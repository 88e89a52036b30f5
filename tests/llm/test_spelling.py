"""Operator 13 against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from reelspark.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, noise=199, least=6, count=5, ratio=5):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    near = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    form = {w: x[0][1] if x and -x[0][0] >= ratio * words[w] else None for w, x in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words)


def collected(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def corpus(seed, documents=60):
    rng = random.Random(seed)
    letters = "abcdeéÉßxZ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(40)]
    words = []
    for w in base:
        words += [w] * 200
        for _ in range(12):  # variants of one edit, some of them rare, some common
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            v = w[:at] + (rng.choice(letters) if kind else "") + w[at + (kind < 2):]
            words += [v] * rng.choice([3, 5, 9, 40, 41])
            words += [v + rng.choice(letters)] * rng.choice([0, 0, 5, 8])  # a variant of the variant
    rng.shuffle(words)
    step = -(-len(words) // documents)
    return [(i, rng.choice([" ", "-", "1"]).join(words[i * step:(i + 1) * step]), "s", "en") for i in range(documents)]


@pytest.mark.parametrize("parts, noise", [(4, 199), (7, 7), (3, 199)])
def test_variants_equal_brute_force(frame, parts, noise):
    rows = corpus(parts)
    rows += [(None, "Letters letters LETTERS letters letters lettres", "s", "en"), (900, None, "s", "en"), (901, "", "s", "en"),
             rows[0], (902, "ÀÉÎÕÜ× ÷ßÿàéî " * 5, "s", "en")]
    got = collected(spelling.variants(frame(rows), parts=parts, noise=noise))
    want = brute(rows, noise)
    assert got == want
    assert any(r[2] > 3 for r in want) and any(r[3] and r[5] != r[3] for r in want)  # chains of forms


def test_signatures_of_near_words_meet():
    """Every edit of a word shares a signature with it for the length of the longer one."""
    rng = random.Random(3)
    for _ in range(300):
        w = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14)))
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        v = w[:at] + (rng.choice("abcdef") if kind else "") + w[at + (kind < 2):]
        if not one_edit(w, v):
            continue
        s = spelling.signatures([w, v], 7)
        half = s.shape[1] // 2
        own = {len(w): s[0, :half], len(w) + 1: s[0, half:]}
        other = {len(v): s[1, :half], len(v) + 1: s[1, half:]}
        longer = max(len(w), len(v))
        assert set(own[longer].tolist()) & set(other[longer].tolist()), (w, v)


def test_signatures_part_other_words():
    words = ["".join(random.Random(i).choices("abcdefghijklmnop", k=9)) for i in range(200)]
    s = spelling.signatures(words, 7)
    pairs = sum(bool(set(s[i].tolist()) & set(s[j].tolist())) for i in range(200) for j in range(i))
    assert pairs < 0.02 * 200 * 199 / 2


def test_long_text_and_empty(frame):
    text = "variant " * 200_000 + "varyant " * 7
    got = collected(spelling.variants(frame([(1, text, "s", "en")]), noise=10**9 + 7))
    assert got == [("variant", 200_000, 1, None, None, "variant"), ("varyant", 7, 1, "variant", 200_000, "variant")]
    assert collected(spelling.variants(frame([]))) == []
