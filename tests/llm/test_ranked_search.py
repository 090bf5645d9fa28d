"""Ranked search against plain scoring of all documents (the query is also held against SQL)."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from surveyloom.llm import ranked_search as rs


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=10):
    split = [Counter(terms(t)) for _, t in docs]
    n = sum(bool(c) for c in split)
    length = sum(map(sum, (c.values() for c in split)))
    df = Counter(t for c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, split):
            m = 25 + 75 * sum(c.values()) * n // max(length, 1)
            score = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items, parts=3):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(parts),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def found(spark, docs, items, **more):
    return sorted((tuple(r) for r in rs.search(*frames(spark, docs, items), **more).collect()), key=str)


def corpus(seed, n, words=300):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    share = 1 / np.arange(1, words + 1)
    draw = lambda size: " ".join(rng.choice(vocabulary, size, p=share / share.sum()))
    return [(i, draw(rng.integers(1, 80))) for i in range(n)], draw


def test_terms():
    text = "A-b c_D é'É x1\x7fy ÀB"
    assert [t.decode() for t in rs.terms_of(text.encode())] == terms(text)


def test_many_shards_and_blocks(spark, monkeypatch):
    """Small shards, so that lists are clustered, floors are probed and blocks are skipped."""
    docs, draw = corpus(1, 1500)
    docs += [(5000 + i, docs[7][1]) for i in range(200)]  # a group of copies: ties everywhere
    items = [(i, draw(30)) for i in range(25)] + [(99, docs[7][1])]
    assert found(spark, docs, items) == plain(docs, items)


def test_skipping_is_exact_in_one_shard():
    docs, draw = corpus(2, 900)
    known = {f"w{i}".encode(): i for i in range(300)}
    counts = [Counter(rs.terms_of(t.encode())) for _, t in docs]
    where = np.concatenate([np.full(len(c), i) for i, c in enumerate(counts)])
    cols = np.array([known[t] for c in counts for t in c])
    statistics = rs.Statistics(len(docs), sum(sum(c.values()) for c in counts), np.arange(300))
    damping = statistics.dampings(np.array([sum(c.values()) for c in counts]))
    values = rs.impacts(np.array([x for c in counts for x in c.values()]), damping[where])
    matrix = np.zeros((len(docs), 300), np.uint8)
    matrix[where, cols] = -(-values // rs.STEP)
    assert values.max() <= 255 * rs.STEP
    blocks = rs._blocks(matrix, where, cols)
    # every posting is in one block of its term, and summaries bound their members
    ends = np.cumsum(blocks["block_sizes"])
    postings, row = set(), 0
    exact = np.zeros((len(docs), 300), np.int64)
    exact[where, cols] = values
    for t, size, end in zip(blocks["block_terms"], blocks["block_sizes"], ends):
        members = blocks["members"][end - size : end]
        postings |= {(int(t), int(d)) for d in members}
        if size > rs.FEW:
            assert (exact[members].max(axis=0) <= blocks["summaries"][row].astype(np.int64) * rs.STEP).all()
            row += 1
    assert postings == set(zip(cols.tolist(), where.tolist())) and row == len(blocks["summaries"]) > 50


def test_nulls_ties_repeats_and_empty_tables(spark):
    docs = [(3, "a b"), (1, "a b"), (None, "a b"), (1, "a b"), (2, None), (4, ""), (5, "?!"), (6, "c " * 50_000), (None, None)]
    items = [(1, "A b"), (1, "A b"), (None, "c"), (2, None), (3, ""), (4, "nowhere"), (5, "a a ?")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, k=2) == plain(docs, items, 2)
    assert found(spark, docs, []) == [] and found(spark, [], items) == []


def test_items_in_several_blocks_and_extra_columns(spark, monkeypatch):
    docs, draw = corpus(3, 60)
    items = [(i, draw(10)) for i in range(40)]
    monkeypatch.setattr(rs, "QUERIES_AT_ONCE", 16)
    a, b = frames(spark, docs, items)
    got = rs.search(a.selectExpr("*", "'x' AS score", "1 AS rank"), b.selectExpr("*", "'y' AS doc_id", "0 AS said"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items)
