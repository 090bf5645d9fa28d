"""Fingerprints against exact shingle sets."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import sketches as sk
from surveyloom.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def exact(text, width=sk.WIDTH):
    return {text[i : i + width] for i in range(max(1, len(text) - width + 1))} if text else set()


def sketch(text, k=sk.K):
    return sk.bottom_k(sk.shingle_hashes(sk.code_points(text)), k)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def test_small_texts_are_exact():
    for text in ["", "a", "é日", "short text", "a" * 100, "abc " * 30]:
        assert sk.distinct_of(sketch(text)) == len(exact(text))
    assert sk.resemblance_of(sketch(""), sketch("")) == 1.0
    assert sk.resemblance_of(sketch(""), sketch("a")) == 0.0
    assert sk.resemblance_of(sketch("hello there world"), sketch("hello there world")) == 1.0


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_estimates_are_near(share):
    a = words(1, 4000)
    b = a[: int(len(a) * share)] + words(2, int(4000 * (1 - share)))
    x, y = exact(a), exact(b)
    assert abs(sk.resemblance_of(sketch(a), sketch(b)) - len(x & y) / len(x | y)) < 0.15
    assert abs(sk.containment_of(sketch(a), sketch(b)) - len(x & y) / len(x)) < 0.2
    assert abs(sk.distinct_of(sketch(a)) / len(x) - 1) < 0.3


def test_round_trip_of_strings():
    for text in ["", "abc", words(3, 300)]:
        assert np.array_equal(sk.decode_sketch(sk.encode_sketch(sketch(text))), sketch(text))
    assert len(sk.decode_sketch(None)) == 0


def test_many_repeats_still_fill_the_sketch():
    text = "ab" * 50_000 + words(4, 40)
    whole = np.unique(sk.shingle_hashes(sk.code_points(text)))[: sk.K]
    assert np.array_equal(sketch(text), whole)


def test_parts_merge_to_the_whole(spark):
    parts = [("x", words(i, 200)) for i in range(6)] + [("y", ""), (None, "abc"), (None, None)]
    df = sk.fingerprints(spark.createDataFrame(parts, "key string, text string").repartition(3), "text")
    got = {r.key: r.fingerprint for r in sk.merge_fingerprints(df, "key").collect()}
    every = np.unique(np.concatenate([sketch(t) for k, t in parts if k == "x"]))[: sk.K]
    assert got["x"] == sk.encode_sketch(every)
    assert got["y"] == "" and got[None] == sk.encode_sketch(sketch("abc"))
    assert sk.merge_fingerprints(df.limit(0), "key").count() == 0


def test_measures_as_columns(spark):
    df = spark.createDataFrame([("hello there world", "hello there words"), (None, "a")], "a string, b string")
    df = sk.fingerprints(sk.fingerprints(df, "a", "fa"), "b", "fb")
    rows = df.select(
        sk.compare("resemblance", "fa", "fb").alias("r"), sk.compare("containment", "fa", "fb").alias("c"),
        sk.distinct_shingles("fa").alias("n"),
    ).collect()
    a, b = exact("hello there world"), exact("hello there words")
    assert rows[0].r == len(a & b) / len(a | b) and rows[0].c == len(a & b) / len(a) and rows[0].n == len(a)
    assert (rows[1].r, rows[1].c, rows[1].n) == (0.0, 1.0, 0.0)


def expected(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sk.encode_sketch(sketch(text)),
                    sk.encode_sketch(sketch(edited)), sk.resemblance_of(sketch(text), sketch(edited)),
                    sk.resemblance_of(sketch(text), sketch(after))))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.mark.parametrize("buckets", [1, 3, None])
def test_edits_follow_the_order_of_ids(spark, buckets):
    docs = [(i * 3, words(i, i % 40)) for i in range(60)] + [(9, "tie"), (9, "tie"), (None, None), (None, "n"), (2**60 + 1, "é")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, fingerprint string")
    assert by_id(sk.compare_with_edits(df, buckets=buckets).collect()) == by_id(expected(docs))
    assert sk.compare_with_edits(df.limit(0)).count() == 0
    one = spark.createDataFrame([(5, "some text here")], "doc_id long, text string")
    assert by_id(sk.compare_with_edits(one).collect()) == by_id(expected([(5, "some text here")]))


def test_query_on_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert by_id(QUERIES["op3_fingerprints"](spark, FOLDER).collect()) == by_id(expected(docs))


@pytest.mark.parametrize("buckets", [None, 20])
def test_null_and_repeated_ids_are_spread(spark, buckets):
    """A third of the rows without an id, a third with one id, and many of them alike."""
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{words(i % 97, 5)} {i % 50}") for i in range(900)]
    docs += [(7, None)] * 40 + [(None, "")] * 40 + [(-(2**63), "a"), (2**63 - 1, "b"), (7, "long " * 1000), (7, "long " * 1000 + "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = sk.compare_with_edits(df, buckets=buckets)
    sizes = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected(docs), key=repr)
    if buckets:
        assert len(sizes) > 3 and sizes.max() < 2.5 * len(docs) / len(sizes)
