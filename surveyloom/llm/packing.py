"""Best-fit packing by minimum bin slack.

A document's tokens (with an end token) are cut only when they are longer than a sequence.
What is packed are lengths, and there are at most ``capacity`` different ones: the driver gets
their counts, no rows. It takes the longest length left, finds by a bitset subset-sum the
fullest combination of other lengths that fits beside it, and removes that combination as
often as the counts allow. Tasks then give each piece its place: its rank among the pieces of
its length says which copy of which combination it belongs to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from surveyloom.llm.common import whole_text
from surveyloom.llm.token_ids import proofs, token_ids
from surveyloom.operators.lookup import attach, settle

CAPACITY, END = 1024, 2
_RANKS = 1 << 44


def fullest_combination(counts: Mapping[int, int], slack: int) -> Counter:
    """Lengths (with repeats) whose sum is the largest one not above ``slack``.

    Bit ``i`` of the set says that some combination of the lengths seen so far sums to ``i``.
    Long lengths are taken first, and the search ends once the slack is filled.
    """
    reached, steps = 1, []
    mask = (1 << (slack + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= slack), reverse=True):
        left, size = min(counts[length], slack // length), 1
        while left:
            size = min(size, left)
            steps.append((length, size, reached))
            reached |= (reached << (length * size)) & mask
            left -= size
            size *= 2
        if reached >> slack & 1:
            break
    total, chosen = reached.bit_length() - 1, Counter()
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += size
            total -= length * size
    return chosen


def plan_bins(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places for all pieces, from the number of pieces of each length.

    Returns sorted keys (length and first rank of a run of pieces), the first bin of each run
    and the offset in its bins, and the number of bins. A run puts one piece into each of
    consecutive bins. The number of runs depends on the capacity, not on the number of pieces.
    """
    left = {x: n for x, n in counts.items() if n}
    taken: Counter = Counter()
    keys, bins, offsets, bin_id = [], [], [], 0
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        chosen = fullest_combination(rest, capacity - seed)
        chosen[seed] += 1
        times = min(left[x] // n for x, n in chosen.items())
        offset = 0
        for x in sorted(chosen, reverse=True):
            for _ in range(chosen[x]):
                keys.append(x * _RANKS + taken[x])
                bins.append(bin_id)
                offsets.append(offset)
                taken[x] += times
                offset += x
            left[x] -= chosen[x] * times
            if not left[x]:
                del left[x]
        bin_id += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(a, np.int64)[order] for a in (keys, bins, offsets)) + (bin_id,)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token ids of each document and its end token, cut where longer than ``capacity``.

    The first of several pieces takes the remainder, all others are full. ``part`` and ``nth``
    number the pieces of a length within a task.
    """
    proved = proofs(path)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids binary, part int, nth long"

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        reader, part, seen = token_ids(proved), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for at, content in zip(range(len(batch)), batch.column(1)):
                ids = reader.encode(content.as_py()) + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1)
                    seen[stop - start] += 1
                    row = (at, piece, start, stop - start, ids[4 * start : 4 * stop], part, seen[stop - start] - 1)
                    for c, v in zip(cols, row):
                        c.append(v)
                    start, piece = stop, piece + 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]],
                names=[id_column, "piece", "start", "length", "ids", "part", "nth"],
            )

    return docs.select(F.col(id_column), whole_text(text).alias("__text")).mapInArrow(cut, schema)


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: its id column, ``piece``, ``start``, ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``sequence_id`` and ``offset``. A null or empty text is its end token.
    Repeated rows and ids are packed one by one, null ids too; other columns are left out; an
    empty table gives no rows. The token ids are written once to the shared folder.
    """
    pieces = settle(token_pieces(docs, path, capacity, end_id, id_column, text))
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, bins, offsets, _ = plan_bins(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = attach(pieces, settle(bases), ["part", "length"], how="inner")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = length.to_numpy(np.int64) * _RANKS + rank.to_numpy(np.int64)
        run = np.searchsorted(keys, at, "right") - 1
        return pd.DataFrame({"sequence_id": bins[run] + at - keys[run], "offset": offsets[run]})

    return ranked.withColumn("place", place("length", F.col("base") + F.col("nth"))).select(
        id_column, "piece", "start", "length", "ids", "place.sequence_id", "place.offset"
    )
