"""Language identification by held-out accuracy."""

import numpy as np
import pytest

from surveyloom.llm import language as lg
from surveyloom.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30, 120])
def test_codewords_are_apart(n):
    code = lg.codewords(n).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert apart[np.triu_indices(n, 1)].min() >= max(1, code.shape[1] // 5 if n > 2 else 1)
    assert (np.abs(code.sum(axis=0)) < n).all()
    assert np.array_equal(lg.codewords(n), code)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = [r for r in QUERIES["op6_language"](spark, FOLDER).collect()]
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 300
    right = [r.lang_pred == truth[r.doc_id].lang for r in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the cat and the dog went home", "en") for i in range(20)]
    rows += [(i, "der hund und die katze gehen nach hause", "de") for i in range(20, 40)]
    rows += [(i, "el perro y el gato fueron a casa", "es") for i in range(40, 60)]
    rows += [(60, None, "en"), (61, "123", "de"), (62, "foo", None)]
    return lg.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_edge_cases(spark, model):
    assert model.languages == ("de", "en", "es")
    texts = [None, "", "123 %%%", "the dog", "die Katze", "the dog", "EL GATO", "the cat " * 50_000]
    docs = spark.createDataFrame([(1, t, "x") for t in texts], "doc_id long, text string, lang string")
    got = lg.identify_languages(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und"] * 3 + ["en", "de", "en", "es", "en"]
    assert [r.score for r in got[:3]] == [0.0] * 3 and got[3].score == got[5].score
    assert got[0].lang == "x"
    assert lg.identify_languages(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        lg.identify_languages(docs.withColumnRenamed("lang", "score"), model)


def test_mixture_is_flagged(model):
    counts = lg.ngram_counts("the cat and the dog der hund und die katze")
    assert lg.decode(model, lg.margins(counts, model.weights) * 0.0)[2]
    assert not lg.decode(model, lg.margins(lg.ngram_counts("the cat and the dog"), model.weights))[2]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = lg.fit_languages(empty)
    docs = spark.createDataFrame([(1, "the dog")], "doc_id long, text string")
    assert lg.identify_languages(docs, model).first().lang_pred == "und"
    one = lg.fit_languages(spark.createDataFrame([(1, "the dog", "en")], "doc_id long, text string, lang string"))
    assert lg.identify_languages(docs, one).first().lang_pred == "en"


def test_sample_bound_is_kept(spark):
    rows = [(i, "the cat", "en") for i in range(4000)] + [(i, "die katze", "de") for i in range(4000, 4040)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lg.fit_languages(df, training_documents=100)
    assert model.languages == ("de", "en")


def test_more_tasks_than_training_texts(spark):
    """Some tasks of the sample have no text at all."""
    rows = [(i, f"{'the of and' if i % 2 else 'der die das'} {i}", "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(32)
    model = lg.fit_languages(docs, training_documents=3)
    assert set(model.languages) <= {"de", "en"}
    five = lg.fit_languages(docs.limit(5).repartition(32), training_documents=5)
    assert set(five.languages) <= {"de", "en"} and five.languages
