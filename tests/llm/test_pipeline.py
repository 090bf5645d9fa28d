"""The pipeline against what its stages should keep, on a small fixture."""

import re
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as cpl
from surveyloom.llm.registry import tokenizer_path
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_jaccard_join import brute as brute_groups
from tests.llm.test_jaccard_join import edited, vocabulary

ENGLISH = "the cat and the dog went home to see what was left of the day and there they were"
GERMAN = "der hund und die katze gehen nach hause um zu sehen was vom tage noch da ist und dort waren sie"


def fixture():
    long = [*ENGLISH.split(), *vocabulary(3, 80)]
    item = " ".join(vocabulary(9, 25))
    texts = [
        *[(f"{ENGLISH} {' '.join(vocabulary(20 + i, 12))}", "en") for i in range(12)],
        *[(f"{GERMAN} {' '.join(vocabulary(40 + i, 12))}", "de") for i in range(12)],
        (" ".join(long), "en"), (" ".join(long), "en"), (" ".join(edited(long, 4, 1)), "en"), (" ".join(edited(long, 5, 12)), "en"),
        ("123 %%% 456", "en"), ("", "de"), (None, None),
        (f"{ENGLISH} {item.upper()}", "en"), (f"{GERMAN} mail me: jo@mail.example.com or +1 212 555 0100", "de"),
    ]
    return [(i, t, lang, "src", len(t) if t else None) for i, (t, lang) in enumerate(texts)], [(0, item)]


@pytest.fixture
def tables(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_every_stage_on_its_own_input(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    text = {d[0]: d[1] for d in docs}
    seen = {}
    for name, stage in cpl.STAGES:
        out = stage(spark, frame, folder)
        if name != "packing":
            assert out.columns == frame.columns and out.dtypes == frame.dtypes
            path = f"{folder}/{name}"
            out.write.parquet(path)
            frame = spark.read.parquet(path)
            seen[name] = {r.doc_id: r for r in frame.collect()}
    assert set(seen["language"]) == {i for i, t in text.items() if re.search("[a-z]", t or "")}
    groups = brute_groups([(i, text[i]) for i in sorted(seen["language"])])
    assert set(seen["near_duplicates"]) == {d for d, _, c in groups if d == c}
    leaks = {d for d, _ in brute_leaks([(i, text[i]) for i in seen["near_duplicates"]], items)}
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - leaks and leaks == {31}
    final = seen["personal_data"]
    assert set(final) == set(seen["decontamination"])
    assert final[32].text.endswith("mail me: [EMAIL] or [PHONE]") and all(r.n_chars == len(r.text) for r in final.values())
    assert all(final[i].text == text[i] for i in final if i != 32)
    packed = out.collect()
    assert {r.doc_id for r in packed} == set(final)
    assert [tuple(r) for r in cpl.run(spark, folder).orderBy("doc_id", "piece").select("doc_id", "piece", "ids_crc32").collect()] == sorted(
        (r.doc_id, r.piece, r.ids_crc32) for r in packed
    )


def test_nothing_to_do(spark, tables):
    folder, _, _ = tables
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cpl.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert cpl.keep_languages(spark, docs, folder).count() == docs.filter("text rlike '[A-Za-z]'").count()
    assert tokenizer_path().endswith(".json")


def test_null_and_repeated_ids_are_rows_of_their_own(spark, tmp_path):
    text = [" ".join(vocabulary(60 + i, 40)) for i in range(7)]
    item = " ".join(text[5].split()[:30])
    rows = [
        (None, text[0]), (None, text[0]), (3, text[1]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[3]), (7, text[4]),
        (5, text[4]), (7, text[5]), (None, text[5]), (None, text[6]), (8, ""), (8, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    kept = cpl.keep_one_of_each_group(spark, docs.repartition(3), str(tmp_path))
    assert kept.dtypes == docs.dtypes
    assert count(kept) == Counter([
        (None, text[0]), (3, text[1]), (None, text[2]), (7, text[3]), (5, text[4]), (7, text[5]), (None, text[6]), (8, ""), (8, ""), (None, None),
    ])
    clean = cpl.drop_leaks(spark, docs.repartition(3), str(tmp_path))
    assert clean.dtypes == docs.dtypes
    assert count(clean) == Counter((i, t) for i, t in rows if t != text[5])
