"""Operators 3 and 4 against plain Python."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest

from reelspark.llm import quality, secrets

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(t):
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(t) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def brute(rows):
    owners, repos = {}, {}
    for _, t, src, lang in rows:
        for *_, v in base_spans(t or ""):
            owners.setdefault(v, set()).add(src or "")
            repos.setdefault(v, set()).add((src or "", lang or ""))
    live = {v for v in owners if len(owners[v]) <= 1 and len(repos[v]) <= 2 and re.search("[A-Za-z]", v)
            and re.search("[0-9]", v) and not re.search(secrets._EXAMPLE_WORDS[4:], v, re.I)}
    out = []
    for i, t, *_ in rows:
        b = base_spans(t or "")
        more = {(e - len(v), 3, e) for _, _, e, v in b if v in live}
        plain = [x[:3] for x in b]
        out.append((i, sum(x[1] == 0 for x in b), sum(x[1] == 1 for x in b), sum(x[1] == 2 for x in b),
                    hashlib.sha256(joined(plain).encode()).hexdigest(), joined(sorted([*plain, *more]))))
    return out, live


def secret_rows():
    rng = random.Random(1)
    bits = ["password = hunter2abc", 'TOKEN: "x"', "secret=token = abcdefgh1", "api_key:'k9/+_.=-zz'", "AKIA" + "Q7" * 9, "AKIAAKIA" + "Z" * 3,
            "0123456789abcdef0123456789abcdef", "deadbeef", "é🙂", "word", "API_KEY=5f" + "a1" * 14, "passwd", "="]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12))), f"s{i % 3}", "en") for i in range(60)]
    rows += [(100, None, "s0", "en"), (101, "", None, None), (None, "token=abc123def", None, "en"), (700, "token=abc123def9", "s9", "en"),
             (700, "token=abc123def9", "s9", "en"), (102, "🙂 password=only1owner x only1owner", "s5", "de"), (103, "secret=y7 " * 3000, "s1", "en"),
             (104, "f" * 5000 + "Ä token=zz9zz9zz", "s1", "en")]
    return rows


def test_scan(frame):
    rows = secret_rows()
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.scan(frame(rows)).collect()]
    want, live = brute(rows)
    assert live and sorted(map(str, got)) == sorted(map(str, want))
    assert secrets.scan(frame([])).collect() == []


def test_redact_masks_live_values_only(frame):
    rows = secret_rows()
    _, live = brute(rows)
    out = secrets.redact(frame(rows))
    got = out.collect()
    assert len(got) == len(rows) and out.columns == frame([]).columns
    by = {r.doc_id: r.text for r in got}
    assert by[102] == "🙂 password=[SECRET] x only1owner"
    assert by[100] is None and by[101] == ""
    assert by[700] == "token=[SECRET]"
    assert not any(v in live for r in got for *_, v in base_spans(r.text or ""))
    shared = {t for _, t, *_ in rows if t and not any(v in live for *_, v in base_spans(t))}
    assert shared <= {r.text for r in got}


def brute_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            len(words) < 20 or 100 * len(hit) > 30 * len(words))


def quality_rows():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    noise = "".join(chr(rng.randrange(33, 127)) + " " * (i % 40 == 0) for i in range(9000))
    return [(1, prose(400), "s", "en"), (2, "In. " * 900, "s", "en"), (3, None, "s", "en"), (4, "", "s", "en"), (5, prose(30), "s", "en"),
            (6, prose(60) + "\n" + prose(9) + "\n\n  \n" + prose(60), "s", "en"), (7, noise, "s", "en"), (8, "a\n" * 50, "s", "en"),
            (9, prose(3000), "s", "en"), (10, (p := prose(12)) + " x " + p + " " + prose(60) + "\n#*$%&|<>é   b\x0bc\x1cd", "s", "en"),
            (1, prose(400), "s", "en"), (None, prose(100), "s", "en"), (11, prose(2000) + " " + "zq " * 6000, "s", "en")]


def test_quality_rates(frame):
    rows = quality_rows()
    got = [tuple(r) for r in quality.rate(frame(rows)).collect()]
    assert sorted(map(str, (g[:7] for g in got))) == sorted(str((i, *brute_quality(t))) for i, t, *_ in rows)
    kept = {g[0] for g in got if g[-1]}
    assert {1, 5, 6, 9, None} <= kept  # clean documents stay
    assert not kept & {2, 3, 4, 7, 8, 11}
    assert quality.rate(frame([])).collect() == []


def test_keep_clean_keeps_rows_whole(frame):
    docs = frame(quality_rows())
    out = quality.keep_clean(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) == 2 and 2 not in ids


def test_bands_depend_on_length():
    import zstandard

    c = zstandard.ZstdCompressor(level=3).compress
    verdict = lambda raw, bands: quality.in_bands(raw, c, bands, 4096, (0.12, 0.9), 0.3)
    raw = b"abcd" * 100
    assert verdict(raw, ((10_000, 0.5, 0.9),)) and not verdict(raw, ((100, 0.5, 0.9),))


@pytest.mark.parametrize("n_bytes", [4_600, 8_000, 20_456])
@pytest.mark.parametrize("part", [0.3, 0.5, 0.7])
def test_noise_parts_of_clean_texts(n_bytes, part):
    rng = random.Random(n_bytes)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(n_bytes // 2))[:n_bytes]
    kept = quality.rater()
    assert kept(prose)[-1]
    size = int(part * n_bytes)
    for letters in (string.ascii_letters + string.digits + "+/", "".join(map(chr, range(33, 127)))):
        noise = "".join(rng.choice(letters) for _ in range(size))
        for at in (0, (n_bytes - size) // 2, n_bytes - size):  # at the start, inside, at the end
            assert not kept(prose[:at] + " " + noise + " " + prose[at + size:])[-1], (letters, at)
