"""Token counts against the library itself."""

import os

import pytest

tokenizers = pytest.importorskip("tokenizers")

from surveyloom.llm import token_counts as tc
from surveyloom.llm.registry import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.01"
TRICKY = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a \nb", "\n\n", "it's we'll  I'M",
    "<|endoftext|>", "a<|endoftext|> b", "x <|endoftext|><|endoftext|>", "<|endoftext", "\x1c a \x85 b\xa0c   d",
    "é ñ 日本語 テスト 🎉🎉 👩‍👩‍👧", "12 345,67 %%% a_b", "\t x\ty", "ÀÉ ́a", "a" * 5000, "ab " * 3000, "x  y " * 500,
    "퟿ \U0010ffff", "word, word.word", "a \x1cb c\x1d d",
]


@pytest.fixture(scope="module")
def reader():
    path = tokenizer_path()
    return tc.WordTokens(path, tc.proved_whole_tokens(path))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_and_ids_equal_the_library(reader, library):
    import numpy as np

    for text in TRICKY[1:]:
        want = ids(library, text)
        assert reader.count(text) == len(want), repr(text[:40])
        assert np.frombuffer(reader.encode(text), "<u4").tolist() == want, repr(text[:40])


def test_slices_do_not_change_results(library, monkeypatch):
    path = tokenizer_path()
    reader = tc.WordTokens(path, tc.proved_whole_tokens(path))
    text = "one  two three <|endoftext|> four\n five  six " * 20
    monkeypatch.setattr(tc, "SLICE", 7)
    assert reader.count(text) == len(ids(library, text))
    assert len(reader.encode(text)) == 4 * len(ids(library, text))


def test_a_full_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tc, "MEMO_WORDS", 3)
    path = tokenizer_path()
    reader = tc.WordTokens(path, tc.proved_whole_tokens(path))
    text = "the and of in that it was for on are"
    assert reader.count(text) == len(ids(library, text))
    assert len(reader.counts) <= 3


def test_proved_table_holds_only_single_tokens(library):
    proved = tc.proved_whole_tokens(tokenizer_path())
    assert 40_000 < len(proved) <= library.get_vocab_size()
    assert proved["Ġthe"] == ids(library, " the")[0]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.proved_whole_tokens(tokenizer_path("word_bpe_49k.json"))


def test_rows_and_extra_columns_stay(spark, library):
    rows = [(i % 7, t, "x") for i, t in enumerate(TRICKY)] + [(None, None, None), (1, "a b", "x"), (1, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = tc.count_tokens(docs, tokenizer_path()).collect()
    assert sorted((r.text or "", r.n_tokens) for r in got) == sorted((t or "", len(ids(library, t))) for _, t, _ in rows)
    assert got[0].n_bytes == "x"
    assert tc.count_tokens(docs.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        tc.count_tokens(docs, tokenizer_path(), output="text")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_the_library_on_every_document(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op1_token_counts"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(ids(library, texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
