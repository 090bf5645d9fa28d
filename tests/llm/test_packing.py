"""Packing: round trips, bounds, and the subset sum against brute force."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from surveyloom.llm import packing as pk
from surveyloom.llm import token_ids as ti
from surveyloom.llm.registry import QUERIES, tokenizer_path
from tests.llm.test_token_counts import TRICKY

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, pk.END]


def test_fast_ids_equal_the_library(library, spark):
    reader = ti.TokenIds(*ti.proofs(tokenizer_path()))
    assert reader.ranks is not None
    texts = [t for t in TRICKY if t] + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for text in texts:
        assert np.frombuffer(reader.encode(text), "<u4").tolist() == ids(library, text)[:-1], repr(text[:60])


@pytest.mark.parametrize("seed", range(8))
def test_fullest_combination_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 30, 9).tolist()
    slack = int(rng.integers(1, 60))
    best = max(s for n in range(10) for c in itertools.combinations(items, n) if (s := sum(c)) <= slack)
    chosen = pk.fullest_combination(Counter(items), slack)
    assert sum(x * n for x, n in chosen.items()) == best
    assert all(n <= items.count(x) for x, n in chosen.items())


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 1025, 20_000).tolist())
    keys, bins, offsets, n = pk.plan_bins(counts)
    used = defaultdict(list)
    for length, count in counts.items():
        at = length * pk._RANKS + np.arange(count)
        run = np.searchsorted(keys, at, "right") - 1
        for b, o in zip(bins[run] + at - keys[run], offsets[run]):
            used[int(b)].append((int(o), length))
    assert len(used) == n
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= pk.CAPACITY
    total = sum(x * c for x, c in counts.items())
    assert n <= total / pk.CAPACITY * 1.01 + 1


def check(rows, docs, library):
    bins, got = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= pk.CAPACITY
    for doc_id, text in docs:
        want, start = ids(library, text), 0
        for i, (piece, at, length, crc) in enumerate(sorted(got[doc_id])):
            assert (piece, at) == (i, start)
            assert crc == zlib.crc32(np.array(want[at : at + length], "<u4").tobytes())
            assert length == pk.CAPACITY or i == 0
            start += length
        assert start == len(want)
    return len(bins)


def test_query_is_a_round_trip(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    n = check(QUERIES["op7_packing"](spark, FOLDER).collect(), docs, library)
    assert n <= sum(len(ids(library, t)) for _, t in docs) / pk.CAPACITY * 1.02 + 1


def test_edge_cases(spark, library):
    from pyspark.sql import functions as F

    docs = [(i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, ids int").repartition(4)
    packed = pk.pack(df, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))
    check(packed.collect(), docs, library)
    assert pk.pack(df.limit(0), tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    rows = pk.pack(twice, tokenizer_path()).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
