"""The corpus pipeline, stage by stage, on documents planted here."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(90)
    rows = [(i, prose(200), "en", f"src{i % 7}") for i in range(30)]
    rows += [(30, rows[0][1], "en", "src1"), (31, rows[1][1].replace(" ", "  ", 3) + " tail", "en", "src2")]
    rows += [(32 + i, prose(150) + " " + passage + " " + prose(150), "en", f"src{i}") for i in range(4)]
    rows += [(40, "same " * 500, "en", "src0"), (41, None, None, None), (42, "", "en", "src0"),
             (43, prose(100) + " password = qX7sole0wner9 " + prose(50), "en", "src5"),
             (44, prose(100) + " token=qwerty123456 " + prose(50), "en", "src1"), (45, prose(100) + " token=qwerty123456 " + prose(50), "en", "src2")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, rows, passage


def test_stages(spark, corpus, tmp_path):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns and out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    clean = {i for i, *_ in rows} - {40, 41, 42}
    assert set(ids("quality")) == clean
    assert set(ids("near_duplicates")) == clean - {30, 31}
    assert ids("repeats") == ids("secrets") == ids("near_duplicates")
    text = {r.doc_id: r for r in seen["repeats"]}
    for i in range(32, 36):
        assert passage[5:-5] not in text[i].text and len(text[i].text) > 500
        assert text[i].n_chars == len(text[i].text)
    assert all(text[i].text == rows[i][1] for i in range(2, 30))
    text = {r.doc_id: r for r in seen["secrets"]}
    assert "qX7sole0wner9" not in text[43].text and "[SECRET]" in text[43].text
    assert "qwerty123456" in text[44].text
    assert {r.doc_id for r in seen["packing"]} == clean - {30, 31}
    got = {(r.doc_id, r.length, r.ids_crc32) for r in pipeline.run(spark, folder).collect()}
    assert sum(n for _, n, _ in got) == sum(r.length for r in seen["packing"])


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("words", [51, 55, 66])
def test_short_passages_of_over_50_words_go(spark, words):
    rng = random.Random(words)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    passage = prose(words)
    assert len(passage) < 400
    rows = [(i, f"{prose(60)} end{i} {passage} next{i} {prose(60)}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pipeline.repeated_passages(spark, docs, "").collect():
        assert r.text == rows[r.doc_id][1].replace(passage, "")
