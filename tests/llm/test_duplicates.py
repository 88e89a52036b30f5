"""Operators 5 and 10 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from reelspark.llm import components, near_dup, shingles, suffix_dedup


def sets(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_links(rows, k, share, of):
    s = [sets(t, k) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(s[i] & s[j])
            if s[i] and s[j] and of * n >= share * (len(s[i]) + len(s[j]) - n):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(s[i]), d if not s[i] else least.get(root(i))) for i, (d, *_) in enumerate(rows)]


def near_rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out, i = [], 0

    def add(t, source="s"):
        nonlocal i
        out.append((i, t, source, "en"))
        i += 1

    base = words(120)
    for _ in range(150):  # a large group around the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        add(" ".join(w))
    passage = words(40)
    for _ in range(80):  # a passage many documents share
        add(" ".join(words(rng.randrange(20, 90)) + passage + words(20)))
    for _ in range(40):
        w = words(rng.randrange(1, 60))
        add(" ".join(w))
        add(" \n".join(w).upper() if rng.random() < 0.5 else " ".join(w[:-1]))
    for t in (None, "", "  \n", "one", "ONE", "one two", "É x", "é x", "a b c"):
        add(t)
    out += [out[3], out[3], (None, " ".join(base), "s", "en"), (None, "alone and without id here", "s", "en"),
            (None, "alone and without id here", "s", "en"), (5000, "shared id first text of two", "s", "en"), (5000, "shared id second and other", "s", "en")]
    add(" ".join(words(20_000)))
    return out


@pytest.mark.parametrize("words,share", [(3, 85), (5, 80)])
def test_near_duplicates(frame, words, share):
    rows = near_rows()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in
           near_dup.link(frame(rows).repartition(3), words=words, share=share, leaf=16, depth=3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_links(rows, words, share, 100)))


def test_one_of_each_group_stays(frame):
    rows = near_rows()
    docs = frame(rows)
    out = near_dup.keep_one(docs, words=3, share=85)
    assert out.columns == docs.columns
    got = out.collect()
    want = {d for (d, n, c) in brute_links(rows, 3, 85, 100) if d is not None and d == c}
    assert {r.doc_id for r in got if r.doc_id is not None} == want
    assert sum(r.doc_id is None for r in got) == 1  # the copied text without ids
    assert sum(r.doc_id == 5000 for r in got) == 2  # two texts of one id


def test_near_duplicates_of_nothing(frame):
    assert near_dup.link(frame([])).collect() == []
    got = near_dup.link(frame([(1, None, "s", "en"), (2, "", "s", "en")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_blocks_find_the_same_links():
    rng = np.random.default_rng(0)
    base = np.sort(rng.choice(10**6, 200, replace=False)).astype(np.uint64)
    some = [np.unique(np.concatenate([base[rng.random(200) < 0.95], rng.integers(0, 10**6, 8).astype(np.uint64)])) for _ in range(60)]

    def parts(links):
        f = components.Forest(60)
        for a, b in links:
            f.join(a, b)
        return [f.root(i) for i in range(60)]

    whole = parts(near_dup.spanning_links(some, [0] * 60, (0, 0), 85, 100))
    block = [i % 3 for i in range(60)]
    links = []
    for i in range(3):
        for j in range(i, 3):
            mine = [m for m in range(60) if block[m] in (i, j)]
            links += [(mine[a], mine[b]) for a, b in near_dup.spanning_links(
                [some[m] for m in mine], [block[m] for m in mine], (i, j), 85, 100)]
    assert parts(links) == whole and len(set(whole)) > 1


def test_shingle_hashes_do_not_depend_on_neighbours():
    a, b = "The quick  brown\tfox", "x " * 50
    alone = shingles.shingle_sets([a], 3)[0]
    assert np.array_equal(alone, shingles.shingle_sets([b, a.upper(), None, ""], 3)[1])
    assert len(shingles.shingle_sets([b], 3)[0]) == 1
    assert [len(x) for x in shingles.shingle_sets([None, "", "one", "one two"], 3)] == [0, 0, 1, 1]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 199), (7, 7)]
    got = {r.key: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}


def test_groups_stream_over_batches():
    k = [1, 1, 2, 2, 2, 3, 4, 4]
    for cuts in ([3], [2, 4], [1, 2, 3, 4, 5, 6, 7], []):
        edges = [0, *cuts, len(k)]
        batches = [pd.DataFrame({"k": k[a:b], "v": range(a, b)}) for a, b in zip(edges, edges[1:])]
        assert [g["v"].tolist() for g in components.groups([*batches, pd.DataFrame({"k": [], "v": []})], ["k"])] == [[0, 1], [2, 3, 4], [5], [6, 7]]


def brute_repeats(rows, length):
    raws = [(t or "").encode() for _, t, *_ in rows]
    c = Counter(r[p:p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (d, *_), r in zip(rows, raws):
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if c[r[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest(),
                    kept.decode("utf-8", "ignore")))
    return out


def repeat_rows():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, edge = text(130), text(100)
    rows = [(i, text(rng.randrange(0, 300)) + passage[:rng.randrange(60, 130)] + text(rng.randrange(0, 100)), "s", "en") for i in range(60)]
    rows += [(100 + i, text(50) + edge + text(50), "s", "en") for i in range(40)]
    rows += [(200, None, "s", "en"), (201, "", "s", "en"), (202, "ab" * 400, "s", "en"), (203, "q" * 39, "s", "en"), (204, (x := text(500)), "s", "en"),
             (205, x, "s", "en"), (205, x, "s", "en"), (None, x + "tail", "s", "en"), (206, x[100:180], "s", "en"), (207, "short copy", "s", "en"),
             (208, "short copy", "s", "en"), (209, text(200) + (y := text(90)) + text(30) + y, "s", "en"), (210, "z" * 2000, "s", "en")]
    return rows


@pytest.mark.parametrize("per_range, crowd, block", [(8_000, 10_000, 64), (20, 10_000, 7), (8_000, 1, 64), (20, 3, 5)])
def test_repeats(frame, monkeypatch, per_range, crowd, block):
    rows = repeat_rows()
    for name, value in (("RANGE", per_range), ("CROWD", crowd), ("BLOCK", block)):
        monkeypatch.setattr(suffix_dedup, name, value)
    got = [tuple(r) for r in suffix_dedup.measure(frame(rows).repartition(3), length=40, gram=10).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 40)))


def test_long_texts_go_in_segments(monkeypatch):
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(5000))

    def chosen():
        out = set()
        for _, pos, h, least, most in suffix_dedup.anchors([raw, raw[:30], raw[7:]], 40, 10):
            for p, lo, hi in zip(pos.tolist(), least.tolist(), most.tolist()):
                out |= {(p, p - o) for o in range(lo, hi + 1)}
        return out

    whole = chosen()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1024)
    # other segments keep fewer bits of a hash's order, so only the windows are compared
    assert {p for _, p in chosen()} == {p for _, p in whole} == set(range(5000 - 39))


def near_copies(n, rng=None):
    """Copies of one passage with a word replaced, in texts of their own."""
    rng = rng or random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        w = list(passage)
        w[rng.randrange(60)] = word()
        out.append((i, " ".join([word() for _ in range(3)] + w), "s", "en"))
    return out


@pytest.mark.parametrize("crowd", [10_000, 50])
def test_near_copies_equal_brute_force(frame, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "RANGE", 100)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
    rows = near_copies(150)
    got = [tuple(r) for r in suffix_dedup.measure(frame(rows).repartition(3), length=60, gram=15).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 60)))


def test_what_near_copies_give_grows_with_their_number(frame, monkeypatch):
    """Rows of the merge, and of the crowded anchors, for 250, 1,000 and 2,000 near copies over several ranges."""
    made = {}
    keep = suffix_dedup.shared_table

    def counting(df, name, *args):
        out = keep(df, name, *args)
        made[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "shared_table", counting)
    monkeypatch.setattr(suffix_dedup, "RANGE", 500)
    for crowd in (10_000, 100):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        seen = {}
        for n in (250, 1_000, 2_000) if crowd == 10_000 else (1_000, 2_000):
            made.clear()
            texts, starts, _ = suffix_dedup.repeated_starts(
                suffix_dedup.keyed(frame(near_copies(n, random.Random(3))), "doc_id", "text"), 200, 50, suffix_dedup.text_bytes)
            seen[n] = made.get("resolved", 0), made.get("crowded", 0), made.get("crowded-windows", 0), starts.count()
        for few, many in zip(seen, list(seen)[1:]):  # of each: rows made by the merge, by the crowd's two steps, and runs of starts
            assert all(b <= 1.5 * many / few * max(a, few) for a, b in zip(seen[few], seen[many])), seen


def test_loser_tree_merges_with_common_prefixes():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    entries = [(w, bytes([i % 5]), i, 0, 0, b"%016d" % i) for i, w in enumerate(words)]
    runs = [sorted(entries[k::7], key=lambda e: e[:2]) for k in range(7)]
    rows = [pd.DataFrame([suffix_dedup.Run.encode(r)]).itertuples(index=False).__next__() for r in runs]
    got = list(suffix_dedup.merge([suffix_dedup.Run.decode(r) for r in rows]))
    assert [e[:2] for e, _ in got] == sorted(e[:2] for e in entries)
    assert sorted(e[2] for e, _ in got) == list(range(300))
    for (a, _), (b, k) in zip(got, got[1:]):
        assert k == suffix_dedup.common_prefix(a[0], b[0])


def test_remove_repeats_keeps_columns(frame):
    docs = frame(repeat_rows())
    out = suffix_dedup.remove_repeats(docs, length=40, gram=10)
    assert out.columns == docs.columns
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[204] == "" and by[200] is None and by[207] == "short copy"
    assert suffix_dedup.measure(frame([])).collect() == []


def test_remove_repeats_by_words(frame, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: [word() for _ in range(n)]
    planted = {n: prose(n) for n in (50, 51, 55, 66)}
    short = [rng.choice("abcdefghij") for _ in range(51)]
    assert all(len(" ".join(x).encode()) < 400 for x in [*planted.values(), short])
    monkeypatch.setattr(suffix_dedup, "RANGE", 20)
    rows, kept = [], {}
    for k, passage in enumerate([*planted.values(), short]):
        for i in range(3):
            a, b = [*prose(rng.randrange(20, 80)), f"end{k}{i}"], [f"next{k}{i}", *prose(rng.randrange(20, 80))]
            glue = "\n  " if i == 2 else " "  # other white space, same words
            rows.append((10 * k + i, " ".join(a) + " " + glue.join(passage) + " " + " ".join(b), "s", "en"))
            kept[10 * k + i] = rows[-1][1] if len(passage) < 51 else " ".join(a) + "  " + " ".join(b)
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60))
    rows += [(100 + i, " ".join(prose(30)) + f" end{i} " + han, "s", "en") for i in range(2)]
    whole = " ".join(prose(60))
    rows += [(200, whole, "s", "en"), (201, whole, "s", "en"), (202, None, "s", "en"), (203, "two words", "s", "en"), (204, "two words", "s", "en")]
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame(rows).repartition(3), words=51).collect()}
    assert len(got) == len(rows)
    for i, text in kept.items():
        assert got[i] == text, i
    assert all(han[:3] not in got[100 + i] and len(got[100 + i]) > 30 for i in range(2))
    assert got[200] == got[201] == "" and got[202] is None and got[203] == got[204] == "two words"


def test_word_codes_in_blocks(monkeypatch):
    from reelspark.llm import word_codes

    text = "one  two\tthree\u3000four " + "x" * 100 + " \u4e00\u4e8ca end" * 30
    whole, spans = word_codes.word_codes(text), word_codes.char_spans(text)
    assert [text[a:b] for a, b in zip(*spans)][:4] == ["one", "two", "three", "four"]
    assert [text[a:b] for a, b in zip(*spans)][-4:] == ["\u4e00", "\u4e8c", "a", "end"]
    assert len(whole) == word_codes.CODE * len(spans[0]) and word_codes.word_codes(None) == b""
    monkeypatch.setattr(word_codes, "BLOCK", 128)
    assert word_codes.word_codes(text) == whole
    assert [x.tolist() for x in word_codes.char_spans(text)] == [x.tolist() for x in spans]


def test_hot_passage_is_sorted_once(frame, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    licence = text(600)
    rows = [(i, text(rng.randrange(30, 90)) + licence + text(rng.randrange(30, 90)), "s", "en") for i in range(90)]
    rows += [(200 + i, text(300), "s", "en") for i in range(20)] + [(300, licence[100:400] + text(50), "s", "en")]
    docs = suffix_dedup.keyed(frame(rows), "doc_id", "text")
    wanted, again, _ = suffix_dedup.candidates(docs, 40, 10, suffix_dedup.text_bytes)
    texts, sent = {bytes(r.key): r.text.encode() for r in docs.collect()}, Counter()
    for r in wanted.collect():
        raw = texts[bytes(r.key)]
        parts = suffix_dedup.anchors([raw], 40, 10)
        sent.update(e[:2] for e in suffix_dedup.suffix_entries(b"", raw, r.firsts, parts, 40))
    # the licence's inner anchors stand in 90 documents each, and one of them stands for all
    assert sent and max(sent.values()) == 1
    assert again.count() > 90 * 10 > sum(sent.values())
    monkeypatch.setattr(suffix_dedup, "RANGE", 20)
    got = [tuple(r) for r in suffix_dedup.measure(frame(rows).repartition(3), length=40, gram=10).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 40)))
