"""Language identification by error-correcting output codes.

Every learned language gets a codeword of signs. For each position of the codewords a binary
classifier over hashed letter n-grams (of one to three code points, in lower case) tells the
languages with +1 from those with -1. A text gets the language whose codeword has the smallest
sum of losses over the positions; a position weighs as much as it was right for that language
on the training sample. A text whose best two languages are close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import object_strings, whole_text, worker_store
from surveyloom.llm.sketches import code_points, mix

UNKNOWN = "und"
FEATURES = 1 << 14
#: Training documents per language that are expected at most; chosen by a hash of the id.
TRAINING_DOCUMENTS = 10_000
#: Evidence stops growing at this many n-grams, and a language is clear from this score on.
ENOUGH, CLEAR = 100, 0.6
_GRAMS = (1, 2, 3)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x positions, -1 or 1
    weights: np.ndarray  # features x positions: log odds of a feature
    trust: np.ndarray  # languages x positions: share of training texts that were right


def codewords(n: int, rng_seed: int = 7) -> np.ndarray:
    """Codewords for n languages that are far from each other; all different columns if n is small."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        # every way to split the languages into two parts
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1
        return np.where(bits, -1, 1).astype(np.int8)
    length, rng, best, most = int(np.ceil(15 * np.log2(n))), np.random.default_rng(rng_seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, -1, 1)[:, None].astype(np.int8)
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2
        closest = int(apart[np.triu_indices(n, 1)].min())
        if closest > most:
            best, most = code, closest
    return best


def _letters() -> np.ndarray:
    """Which code points are letters."""
    store = worker_store("letters")
    if "letters" not in store:
        store["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return store["letters"]


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams of letters, with one space between words; None without a letter."""
    points = code_points(text.lower())
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter stands for the space
    spelled = np.concatenate([[1], np.where(letter, points, 1)[keep], [1]]).astype(np.uint64)
    total = np.zeros(FEATURES, np.int64)
    seeds = mix((spelled + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    block = seeds
    for n in _GRAMS:
        if n > 1:
            if len(seeds) < n:
                break
            block = block[: len(seeds) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + seeds[n - 1 :]
        found = (mix(block + np.uint64(n)) >> np.uint64(50)).astype(np.int64)
        total += np.bincount(found, minlength=FEATURES)
    return total


def margins(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds for each position; the evidence of long texts is scaled down."""
    n = counts.sum()
    return (counts @ weights) * (min(n, ENOUGH) / n)


def decode(model: LanguageModel, margin: np.ndarray) -> tuple[str, float, bool]:
    """The language of least loss, its share against all others, and whether it is ambiguous."""
    loss = (model.trust * np.logaddexp(0, -model.codes * margin)).sum(axis=1)
    share = np.exp(loss.min() - loss)
    score = float(1 / share.sum())
    return model.languages[int(loss.argmin())], score, score < CLEAR


def _with_sample_key(docs: DataFrame, text: str, label: str, id_column: str) -> DataFrame:
    return docs.filter(F.col(label).isNotNull()).select(
        whole_text(text).alias("__text"),
        F.col(label).cast("string").alias("__label"),
        F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 30)).alias("__draw"),
    )


def fit_languages(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    id_column: str = "doc_id",
    training_documents: int = TRAINING_DOCUMENTS,
) -> LanguageModel:
    """Learn from the texts and labels of ``docs``.

    About ``training_documents`` texts per language are read, chosen by a hash of their id (all,
    where there are fewer). Tasks add up n-gram counts per language; the driver gets one vector
    of fixed size per language. Rows without a label and texts without a letter teach nothing;
    without any others the model knows no language.
    """
    rows = _with_sample_key(docs, text, label, id_column)
    sizes = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    limits = {x: int((1 << 30) * min(1.0, training_documents / n)) for x, n in sizes.items()}
    if not limits:
        return LanguageModel((), np.ones((0, 1), np.int8), np.zeros((FEATURES, 1)), np.ones((0, 1)))
    chosen = F.create_map(*[v for x, n in limits.items() for v in (F.lit(x), F.lit(n))])
    sample = rows.filter(F.col("__draw") < F.element_at(chosen, F.col("__label"))).select("__label", "__text")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, content in zip(batch["__label"], batch["__text"]):
                counts = ngram_counts(content)
                if counts is not None:
                    held[language] = held.get(language, 0) + counts
        if held:  # a task may have no text at all
            yield pd.DataFrame({"label": list(held), "counts": [v.astype("<i8").tobytes() for v in held.values()]})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(x, "<i8") for x in group["counts"])
        return pd.DataFrame({"label": [group["label"].iloc[0]], "counts": [counts.tobytes()]})

    schema = "label string, counts binary"
    vectors = {
        r["label"]: np.frombuffer(r["counts"], "<i8")
        for r in sample.mapInPandas(add_up, schema).groupBy("label").applyInPandas(total, schema).collect()
    }
    languages = tuple(sorted(vectors))
    codes = codewords(len(languages))
    # each language counts the same, whatever its share of the sample
    shares = np.array([vectors[x] / vectors[x].sum() for x in languages]).reshape(len(languages), FEATURES)
    smooth = 1e-6
    sides = [np.where(codes == s, 1.0, 0.0) for s in (1, -1)]
    means = [(shares.T @ side) / np.maximum(side.sum(axis=0), 1) for side in sides]
    weights = np.log(means[0] + smooth) - np.log(means[1] + smooth)
    if len(languages) < 2:
        weights = np.zeros_like(weights)
    model = LanguageModel(languages, codes, weights, np.ones(codes.shape))
    n_positions, index = codes.shape[1], {x: i for i, x in enumerate(languages)}

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, n = np.zeros(codes.shape), np.zeros(len(languages))
        for batch in batches:
            for language, content in zip(batch["__label"], batch["__text"]):
                counts = ngram_counts(content)
                if counts is not None and language in index:
                    i = index[language]
                    right[i] += margins(counts, weights) * codes[i] > 0
                    n[i] += 1
        yield pd.DataFrame({"n": [n.tolist()], "right": [right.ravel().tolist()]})

    # sums by place of the vectors: one row per language and position
    told = sample.mapInPandas(judged, "n array<double>, right array<double>")
    by_place = told.select("n", F.posexplode("right").alias("at", "right")).groupBy("at").agg(
        F.sum("right").alias("right"), F.sum(F.element_at("n", (F.col("at") / n_positions).cast("int") + 1)).alias("n")
    )
    trust = np.ones(codes.size)
    for r in by_place.collect():
        trust[r["at"]] = (r["right"] + 1) / (r["n"] + 2)
    return LanguageModel(languages, codes, model.weights, trust.reshape(codes.shape))


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if the
    model knows no language. Ties go to the language that comes first in sorted order. Rows are
    kept one by one with their other columns; no row moves between tasks.
    """
    clash = {"lang_pred", "score", "ambiguous"} & set(docs.columns)
    if clash:
        raise ValueError(f"Columns exist: {', '.join(sorted(clash))}")

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for content in batch:
                counts = ngram_counts(content) if model.languages else None
                out.append((UNKNOWN, 0.0, False) if counts is None else decode(model, margins(counts, model.weights)))
            yield object_strings(pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"]))

    found = docs.withColumn("__found", predicted(whole_text(text)))
    return found.select(*docs.columns, "__found.lang_pred", "__found.score", "__found.ambiguous")
