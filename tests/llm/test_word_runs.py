"""Runs of periodic words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm.registry import QUERIES
from surveyloom.llm.word_runs import find_runs, periodic_runs

FOLDER = "/root/testdata/sf0.001"


def plain_runs(w):
    """Every lag's streaks; of those over the same words the smallest lag counts."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, exponent, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def test_random_sequences():
    random.seed(5)
    count = 0
    for _ in range(400):
        texts = []
        for _ in range(random.randint(1, 4)):
            w = []
            for _ in range(random.randint(0, 5)):
                base = [random.randint(0, random.choice([1, 2, 3])) for _ in range(random.randint(1, random.choice([2, 5, 20, 70])))]
                w += (base * random.randint(1, 8))[: random.randint(1, 300)]
            texts.append(w)
        flat = np.array([x for w in texts for x in w], np.int64)
        own = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        got = list(zip(*(x.tolist() for x in find_runs(flat, own))))
        want, start = [], 0
        for w in texts:
            want += [(start + s, n, q) for s, n, q in plain_runs(w)]
            start += len(w)
        assert sorted(got) == sorted(want)
        count += len(got)
    assert count > 300


@pytest.mark.parametrize("text, runs", [
    ("a " * 24, [(0, 24, 1)]),
    ("a " * 23, []),
    ("a b c d e f g h " * 3, [(0, 24, 8)]),
    ("a b c d e f g h i " * 2 + "a b c d e f g h", []),
    ("x " + "a b " * 12 + "a y", [(1, 25, 2)]),
    ("a " * 30 + "b " * 30, [(0, 30, 1), (30, 30, 1)]),
])
def test_edges_of_runs(spark, text, runs):
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == runs


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_word_runs"](spark, FOLDER).collect()}
    assert sum(r[1] > 0 for r in got.values()) > 5
    for doc_id, text in docs:
        assert got[doc_id] == plain_row(doc_id, text)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a " * 40, 7), (1, None, 8), (1, "", 9), (1, " \t\n", 9), (2, "é è " * 20, 1), (2, "é è " * 20, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = periodic_runs(docs).collect()
    assert [(r["doc_id"], r["start"], r["n_words"], len(r["runs"]), r["collapsed"]) for r in got] == [
        (None, 7, 40, 1, "a"), (1, 8, 0, 0, ""), (1, 9, 0, 0, ""), (1, 9, 0, 0, ""), (2, 1, 40, 1, "é è"), (2, 1, 40, 1, "é è"),
    ]
    assert periodic_runs(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs.withColumn("runs", F.lit(1)))


def test_very_long_text_of_few_words(spark):
    docs = spark.createDataFrame([(1, "a " * 300_000), (2, "a b c " * 100_000 + "d")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 300_000, 1)] and got[1]["collapsed"] == "a"
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 300_000, 3)] and got[2]["collapsed"] == "a b c d"
