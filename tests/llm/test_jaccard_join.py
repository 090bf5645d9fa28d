"""Exact links and components against brute force."""

import itertools
import re

import numpy as np
import pytest

from surveyloom.llm import components as cp
from surveyloom.llm import jaccard_join as jj
from surveyloom.llm import shingle_sets as ss
from surveyloom.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(w) < 5:
        return frozenset({tuple(w)} if w else ())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, percent=80):
    sets = [plain(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {p for own in where.values() for p in itertools.combinations(own, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), smallest.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def vocabulary(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklm"), 5)) for _ in range(n)]


def edited(words, seed, n):
    rng, out = np.random.default_rng(seed), list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{seed}x{i}"
    return out


def many():
    docs = []
    for g in range(6):  # near copies: chains of edits, from hardly to too much changed
        words = vocabulary(g, 120 + 40 * g)
        for i in range(25):
            docs.append(" ".join(edited(words, 1000 * g + i, 1 + i % 4)))
            if i % 5 == 0:
                words = edited(words, 77 + i, 1)
    passage = vocabulary(50, 60)
    docs += [" ".join([*vocabulary(200 + i, 60), *passage, *vocabulary(300 + i, 30)]) for i in range(40)]
    docs += [" ".join(vocabulary(60, 30))] * 30 + ["", None, " \t\n", "one", "ONE", "one two", "a b c d", "A  b\tc\nd", "é É a b c", "É é a b c"]
    docs += [" ".join(vocabulary(70, 20_000)), " ".join(edited(vocabulary(70, 20_000), 5, 300))]
    order = np.random.default_rng(1).permutation(len(docs)).tolist()
    return [(int(k), docs[i]) for k, i in enumerate(order)]


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_sets_equal_plain_ones():
    import pyarrow as pa

    texts = [t or "" for _, t in many()]
    names = {}
    for text, own in zip(texts, ss.shingle_sets(pa.array(texts))):
        assert len(own) == len(plain(text))
        assert names.setdefault(plain(text), own.tobytes()) == own.tobytes()
    assert len(set(names.values())) == len(names)
    sliced = pa.array(["x y z", *texts[:50]]).slice(1)
    assert [a.tobytes() for a in ss.shingle_sets(sliced)] == [a.tobytes() for a in ss.shingle_sets(pa.array(texts[:50]))]


@pytest.mark.parametrize("chunk", [4, 256])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jj, "CHUNK", chunk)
    docs = many()
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_shingles string").repartition(4)
    assert result(jj.near_duplicates(df)) == brute(docs)


def test_repeated_and_null_ids(spark):
    a, b = " ".join(vocabulary(1, 40)), " ".join(edited(vocabulary(1, 40), 2, 1))
    docs = [(5, a), (5, b), (5, "other text here"), (None, a), (None, "alone"), (3, "alone too"), (7, "alone too"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(jj.near_duplicates(df)) == brute(docs)
    assert jj.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_other_thresholds(spark, percent):
    docs = many()[::3]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(jj.near_duplicates(df, percent=percent)) == brute(docs, percent)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r.node: r.component for r in cp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert cp.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(QUERIES["op8_jaccard_join"](spark, FOLDER)) == brute(docs)


def test_profiles_never_lose_a_link():
    rng = np.random.default_rng(4)
    told = 0
    for _ in range(600):
        n = int(rng.choice([1, 3, 20, 130, 700, 9000]))
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = rng.random(len(own)) < rng.choice([0.2, 0.7, 0.85, 0.95])
        more = rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 3) + 1)), dtype=np.uint64)
        other = np.unique(np.concatenate([own[keep], more]))
        if not len(other):
            continue
        may = jj.may_be_linked(jj.profile(own), len(own), jj.profile(other), len(other))
        assert may or not jj.linked(own, other)
        told += not may
    assert told > 150
    many = np.arange(1 << 20, dtype=np.uint64) << np.uint64(14)  # all in one bucket
    assert jj.may_be_linked(jj.profile(many), len(many), jj.profile(many), len(many))
