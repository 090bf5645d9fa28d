"""Training order: permutations, and shards read back."""

import glob

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from surveyloom.llm import training_order as to
from surveyloom.llm.registry import ORDER_KEY, tokenizer_path


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = to.feistel(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert np.array_equal(slots, to.feistel(np.arange(n), n, 7))
    if n > 500:
        assert not np.array_equal(slots, to.feistel(np.arange(n), n, 8))
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.3


def test_shards_read_back(spark, tmp_path):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    docs = [(i * 7, "word " * (i * 13 % 90) + str(i)) for i in range(80)] + [(3, None), (5, ""), (6, "x y z " * 3000), (7, "same"), (7, "same"), (None, "n")]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, slot int").repartition(5)
    folder = tmp_path.as_uri() + "/a"
    rows = to.materialise(df, tokenizer_path(), folder, ORDER_KEY, length=32, shard_text=5000).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n))
    bases = {}
    for r in rows:
        bases[r.shard] = min(bases.get(r.shard, n), r.slot)
        assert r.byte_offset % r.stride == 0 and r.stride == 64
    assert len(bases) > 3 and len(glob.glob(f"{tmp_path}/a/shard-*.bin")) == len(bases)
    all_slots = to.read_slots(folder, bases, 0, n + 5, length=32)
    assert len(all_slots) == n
    assert np.array_equal(to.read_slots(folder, bases, 17, 50, length=32), all_slots[17:67])
    want = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, to.END]
        want += [(doc_id, p, tuple(ids[s : s + 32])) for p, s in enumerate(range(0, len(ids), 32))]
    got = [(r.doc_id, r.piece, tuple(all_slots[r.slot][: r.n_tokens].tolist())) for r in rows]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1:])) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1:]))
    assert all(all_slots[r.slot][r.n_tokens :].sum() == 0 for r in rows)
    again = to.materialise(df.repartition(2), tokenizer_path(), tmp_path.as_uri() + "/b", ORDER_KEY, length=32, shard_text=5000)
    assert {(r.doc_id, r.piece, r.slot, r.ids_crc32) for r in again.collect()} == {(r.doc_id, r.piece, r.slot, r.ids_crc32) for r in rows}
    assert to.materialise(df.limit(0), tokenizer_path(), tmp_path.as_uri() + "/c", ORDER_KEY).count() == 0


def test_wide_null_and_repeated_ids_are_spread(spark, tmp_path):
    """Ids at both ends of their type, a third of them null and a third one id, over shards of like size."""
    wide = [4 * 10**18, -4 * 10**18, 2**63 - 1, -(2**63)]
    docs = [(None if i % 3 == 0 else 5 if i % 3 == 1 else wide[i % 4] + (-i if wide[i % 4] > 0 else i), f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = to.materialise(df, tokenizer_path(), tmp_path.as_uri() + "/w", ORDER_KEY, length=32, shard_text=2000).collect()
    assert sorted(r.slot for r in rows) == list(range(3000))
    assert sum(r.doc_id is None for r in rows) == 1000
    sizes = np.bincount([r.shard for r in rows])
    assert len(sizes) > 10 and sizes.max() <= 2 * sizes.mean()
