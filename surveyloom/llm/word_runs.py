"""Runs of periodic words, found by match lengths on diagonals.

Word i and an earlier equal word j lie on the diagonal of their lag i - j. A stretch of words with
period q is a streak on diagonal q, q words shorter than the stretch. Words are read in order;
each one counts up the streaks of the diagonals on which it matches, and a diagonal that does not
go on is judged at once: long enough, it is a run.

Only diagonals that can still matter are kept. A run of period q is a streak of at least twice q
(and of sixteen), so on one of the levels G = 16, 32, 64, ... with G / 2 < q <= G (the first level
has all q up to 16) the G words at a position agree with those q earlier, and inside a run of
smallest period q no nearer occurrence of those G words exists. So every position has one active
diagonal per level at most, to the latest earlier occurrence of its G words, and a run costs
O(log n) a word instead of one step per earlier occurrence. Multiples of a smallest period never
become active, so every run is found with its smallest period and only once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import whole_text
from surveyloom.llm.sketches import mix

#: A run has at least this many words and this many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words of the first level; shorter streaks are no runs.
FIRST = LEAST_WORDS - LEAST_WORDS // LEAST_TIMES
#: Bytes of text whose words are numbered in one go (a longer text is one go by itself).
GO = 4 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _latest(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions ``at`` whose name occurs earlier in ``at``, ascending, and the distance to the latest one."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    here, before = order[1:][same], order[:-1][same]
    back = np.argsort(here)
    return at[here[back]], (at[here] - at[before])[back]


def find_runs(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in a sequence of word numbers.

    ``texts`` has the ordinal of each word's text, so that no run reaches over the end of a text.
    """
    found: list[np.ndarray] = []
    final = len(words) - 1
    with np.errstate(over="ignore"):
        names, size, level = mix(words.astype(np.uint64) * _STEP + np.uint64(1)), 1, FIRST
        at = np.arange(len(words))  # first words of stretches of ``size`` words that may still repeat
        place = np.arange(len(words))  # where a position stands in ``at``, if it does
        while len(at):
            while size < level and len(at):
                # a stretch of twice the size needs both halves, and must end in the same text
                half = np.minimum(at + size, final)
                second = np.minimum(place[half], len(at) - 1)
                whole = (at + 2 * size - 1 <= final) & (at[second] == half)
                whole &= texts[np.minimum(at + 2 * size - 1, final)] == texts[at]
                names = mix(names[whole] * _STEP + names[second[whole]])
                at, size = at[whole], 2 * size
                place[at] = np.arange(len(at))
            if not len(at):
                break
            # the same words in another text are another stretch
            own = mix(names + texts[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            here, lag = _latest(own, at)
            low = 0 if level == FIRST else level // 2
            active = (lag > low) & (lag <= level)
            i, q = here[active], lag[active]
            if len(i):
                # a diagonal goes on from one position to the next, or ends and is judged
                fresh = np.ones(len(i), bool)
                fresh[1:] = (i[1:] != i[:-1] + 1) | (q[1:] != q[:-1]) | (texts[i[1:]] != texts[i[:-1]])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(i)) - 1
                q = q[first]
                streak = i[last] - i[first] + level
                enough = streak + q >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
                found.append(np.stack([i[first][enough] - q[enough], (streak + q)[enough], q[enough]]))
            # longer stretches repeat only where these do, as an earlier or as a later one
            again = np.zeros(len(words), bool)
            again[here], again[here - lag] = True, True
            stay = again[at]
            at, names = at[stay], names[stay]
            place[at] = np.arange(len(at))
            level *= 2
    starts, lengths, periods = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((periods, starts))
    return starts[order], lengths[order], periods[order]


def _kept(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words are in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) == 0


def _of_texts(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    split = [t.split() for t in texts]  # at the ASCII white space of bytes
    sizes = np.array([len(w) for w in split], np.int64)
    numbers: dict[bytes, int] = {}
    words = np.fromiter(map(numbers.setdefault, chain.from_iterable(split), count()), np.int64, int(sizes.sum()))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    starts, lengths, periods = find_runs(words, np.repeat(np.arange(len(texts)), sizes))
    cuts = np.searchsorted(starts, begins)
    for k, own in enumerate(split):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            yield len(own), [], b" ".join(own)
            continue
        s, n, q = starts[a:b] - begins[k], lengths[a:b], periods[a:b]
        kept = _kept(len(own), s, n, q)
        yield len(own), list(zip(s.tolist(), n.tolist(), q.tolist())), b" ".join(w for w, k in zip(own, kept) if k)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed`` of each text.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a longest stretch
    with smallest period q of at least 24 words and three periods; ``collapsed`` has the words
    that are in no run after its first period, with single spaces. Null and empty texts, and texts
    of white space, have no words, no runs and an empty collapsed text. Rows are kept one by one
    with their other columns (``collapsed`` stands for the text), so repeated rows stay and an empty
    table gives no rows; nothing moves between tasks. Clashing column names are refused. The whole of a text is read; one text is the
    largest thing a task holds, and several share a go of 4 MB.

    Words are compared exactly, longer stretches by 64-bit hashes inside a text.
    """
    others = [c for c in docs.columns if c != text]
    clash = {"n_words", "runs", "collapsed"} & set(others)
    if clash:
        raise ValueError(f"Columns exist: {', '.join(sorted(clash))}")

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + GO, "right")))
                out = list(_of_texts(texts.slice(at, stop - at).to_pylist()))
                rows = batch.slice(at, stop - at).drop_columns(["__text"])
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array([n for n, _, _ in out], pa.int64()),
                        pa.array(runs, runs_type),
                        pa.array([c.decode() for _, _, c in out], pa.string()),
                    ],
                    names=[*rows.schema.names, "n_words", "runs", "collapsed"],
                )
                at = stop

    rows = docs.select(*others, whole_text(text).alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    added = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(found, f"{kinds}, {added}")


def strongest(runs: Column) -> Column:
    """The run with most periods; ties go to the smallest start, then period. Null without runs."""
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(
        runs,
        F.lit(None).cast(kind),
        # by start and period, so a later one must have strictly more periods
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )


def listed(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed, in one string."""
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""
    )


def with_planted_periods(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The texts, a tenth of them (by a checksum of the id) made periodic from some word on.

    With h the checksum, g = h div 10 and n words, words from a = g mod n on are replaced by the
    p = 1 + (n - a) div (3 + g mod 8) words that begin there, again and again. Rows with a null id
    and texts without words stay as they are.
    """
    h = F.crc32(F.col(id_column).cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(whole_text(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    parts = docs.withColumn("__words", F.when(h % 10 == 0, words))
    n = F.size("__words").cast("long")
    parts = parts.withColumn("__a", F.when(n > 0, g % n).cast("int"))
    p = (1 + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int")
    parts = parts.withColumn("__p", p)
    periodic = F.expr(
        "array_join(transform(__words, (w, i) -> if(i < __a, w, __words[__a + (i - __a) % __p])), ' ')"
    )
    edited = F.when(F.col("__a").isNotNull(), periodic).otherwise(F.col(text))
    return parts.withColumn(text, edited).drop("__words", "__a", "__p")
