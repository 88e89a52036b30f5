"""Operator 13 — groups of spelling variants by PartEnum signatures.

The words of a corpus are runs of Latin letters; one in ``noise`` (by the checksum of document id and
word) loses a letter, as a model of misspelling. Words of ``min_length`` letters with ``min_count``
occurrences are compared: two are near if one inserted, deleted or replaced letter turns one into the other.

A word is taken as the multiset of its letters, a binary vector over (letter, how many of it came before). One edit
changes at most two of its components, so near words have Hamming distance two or less. PartEnum finds all
such pairs by equality: the components are dealt over ``parts`` parts, at least ``parts`` - 2 of which agree, so a
word has one signature for every two parts left out. The signature also holds the length of the pair's longer
word, as in PartEnum's intervals of sizes: a word gives signatures for its own length and, as the shorter word of a pair, for the
next. Multisets know no order, and common letters meet often; so a signature is enumerated twice, with the first and with the
last half of the word: one edit leaves one of the halves as it is. Signatures are joined on equality, and the edit distance decides.
Many words share one only if they share a half and most of their letters.

A word's form is its near word with the most occurrences, where that has ``ratio`` times as many; its root is found by
following forms, whose counts grow by that ratio, so 2**``jumps`` steps always suffice.

Null texts have no words. In rows with a null id no word loses a letter. Repeated rows count again. Ties go to the
smaller word by code points. Empty tables give no rows. Extra columns are not read. Texts of any length are
read as a stream of matches.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def text_words(doc_id, text: str, noise: int, min_length: int) -> Counter:
    """Words of one text with their occurrences."""
    runs = Counter(m.group() for m in RUN.finditer(text)) if len(text) > 1 << 20 else Counter(RUN.findall(text))
    before = zlib.crc32(f"{doc_id}:".encode()) if doc_id is not None else None
    out: Counter = Counter()
    for run, n in runs.items():
        if len(run) < min_length:
            continue
        word = run.translate(LOWER)
        if before is not None:
            h = zlib.crc32(word.encode(), before)
            if h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < min_length:
                    continue
        out[word] += n
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str, noise: int, min_length: int, min_count: int) -> DataFrame:
    """``word``, ``n``: words are counted in the tasks first, then over all."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where(F.col("text").isNotNull())

    def run(batches):
        for pdf in batches:
            found: Counter = Counter()
            for doc_id, text in zip(pdf["id"].tolist(), pdf["text"].tolist()):
                found.update(text_words(doc_id, text, noise, min_length))
            yield pd.DataFrame({"word": list(found), "n": list(found.values())}, columns=["word", "n"]).astype({"n": "int64"})

    return (src.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def part_hashes(word: str, parts: int) -> np.ndarray:
    """A hash of what the word has in each part of the components (letter, number of it before)."""
    held: list[list[str]] = [[] for _ in range(parts)]
    seen: Counter = Counter()
    for letter in sorted(word):
        component = f"{letter}{seen[letter]}"
        seen[letter] += 1
        held[zlib.crc32(component.encode()) % parts].append(component)
    return np.array([xxhash.xxh64_intdigest(" ".join(h), i) for i, h in enumerate(held)], dtype=np.uint64)


def signatures(words: list[str], parts: int) -> np.ndarray:
    """One row per word: signatures for the word as the longer of a pair, then for it as the shorter or equal one
    of a pair whose longer word has one letter more."""
    left_out = list(combinations(range(parts), 2))
    held = np.stack([part_hashes(w, parts) for w in words])
    length = np.array([len(w) for w in words], dtype=np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    rest = held.sum(axis=1, dtype=np.uint64)[:, None] - np.stack([held[:, i] + held[:, j] for i, j in left_out], axis=1)
    which = np.arange(1, len(left_out) + 1, dtype=np.uint64) * np.uint64(1 << 40)
    out = [(rest ^ ((which + longer[:, None]) * odd)) * odd for longer in (length, length + np.uint64(1))]
    return np.concatenate(out, axis=1).view(np.int64)


def near_words(words: DataFrame, parts: int) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: each pair of near words once; ``a`` is the longer one, or the first of equal length."""
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                some = pdf.iloc[at:at + 2000]
                sig = signatures(some["word"].tolist(), parts)
                own = sig.shape[1] // 2
                yield some.assign(sigs=list(sig[:, :own]), next_sigs=list(sig[:, own:]))

    signed = words.mapInPandas(run, "word string, n long, sigs array<long>, next_sigs array<long>")
    word = F.col("word")

    def keys(sigs: str, longer):
        # the shorter word of a pair has one letter less than the longer one at most
        half = F.floor((longer - 1) / 2).cast("int")
        first, last = F.substr(word, F.lit(1), half), F.substr(word, F.length(word) - half + 1, half)
        return F.concat(F.transform(sigs, lambda s: F.xxhash64(s, F.lit("first"), first)),
                        F.transform(sigs, lambda s: F.xxhash64(s, F.lit("last"), last)))

    cells = F.concat(F.transform(keys("sigs", F.length(word)), lambda k: F.struct(k.alias("key"), F.lit(False).alias("shorter"))),
                     F.transform(keys("next_sigs", F.length(word) + 1), lambda k: F.struct(k.alias("key"), F.lit(True).alias("shorter"))))
    keyed = shared_table(signed.select("word", "n", F.explode(cells).alias("c")).select("c.*", "word", "n"), "signatures")
    a = keyed.where("not shorter").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select("key", "shorter", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (F.col("shorter") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "key").where(near).select("a", "a_n", "b", "b_n").distinct()


def roots(links: DataFrame, jumps: int) -> DataFrame:
    """``word``, ``root`` of the links ``word`` → ``root``: each jump doubles how far a word has followed them."""
    now = links
    for _ in range(jumps):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = shared_table(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 199, min_length: int = 6,
             min_count: int = 5, ratio: int = 5, parts: int = 4, jumps: int = 5) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word."""
    words = shared_table(word_counts(docs, id_col, text_col, noise, min_length, min_count), "words")
    near = shared_table(near_words(words, parts), "near-words")
    sides = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionAll(
        near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"),
                                     F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    known = shared_table(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
        .alias("to")), "word-forms")
    links = known.where("to is not null").select("word", F.col("to.form").alias("root"))
    return known.join(roots(links, jumps), "word", "left").select(
        "word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.form_n").alias("form_n"),
        F.coalesce("root", "word").alias("root"))
