"""Ranked lexical search over posting lists that are blocked by document similarity.

Documents are cut into shards of bounded size. In each shard every term has a posting list; a long
list is clustered into blocks of documents that are alike (by a random projection of their terms),
and each block stores the largest impact of every term among its documents, rounded up. For a
query, the lists of its rarest and strongest terms are read until no document outside of them can
reach the score that the best documents have so far; of these lists a block is skipped only if the
bound from its summary stays below that score. Documents of opened blocks are scored in full.
So results are exact, whatever the blocks are.

The index holds the terms that are asked for. Scores, bounds and ties are integers.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from surveyloom.llm.common import whole_text
from surveyloom.operators.lookup import attach_aggregate, one_row, scratch_folder, settle, settle_measured

#: Documents of a shard, and cells of its matrix of documents and terms at most.
SHARD, CELLS = 512, 1 << 23
#: Shards of a row group and of a file of the index.
GROUP, FILE = 8, 64
#: Documents of a block as intended; lists of so few are their own summary.
BLOCK, FEW = 32, 16
#: Dimensions of the projection by which documents are alike.
DIMENSIONS = 16
#: Summaries are bytes of so many impacts (rounded up).
STEP = 4096
#: One shard in so many is searched first, for a score that results must reach.
PROBE = 16
#: Different queries and their bytes that are searched in one go.
QUERIES_AT_ONCE, BYTES_AT_ONCE = 512, 1 << 17
#: ASCII letters and digits in lower case; all other ASCII characters separate terms.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Statistics:
    documents: int  # with at least one term
    length: int  # terms of all documents
    weights: np.ndarray  # of each known term

    def dampings(self, lengths: np.ndarray) -> np.ndarray:
        """What the length of a document takes from its impacts, exact for any number of documents."""
        return np.array([25 + 75 * int(n) * self.documents // self.length for n in lengths], np.int64)


def impacts(counts: np.ndarray, dampings: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * dampings)


def spans(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - begins
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def count_terms(docs: DataFrame, text: str, known: dict[bytes, int]) -> DataFrame:
    """Per document its number of terms ``n``, the known ``terms`` in it and their ``counts``."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        asked = known.keys()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            n, ends, held, times = [], [0], [], []
            for value in texts:
                words = terms_of(value.as_py())
                n.append(len(words))
                found = Counter(words)
                for w in found.keys() & asked:
                    held.append(known[w])
                    times.append(found[w])
                ends.append(len(held))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(held, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text(text).alias("__text"))
    return rows.mapInArrow(counted, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def _blocks(matrix: np.ndarray, rows: np.ndarray, cols: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Blocks of the posting lists of one shard, by term, with the summaries of those that are long.

    ``matrix`` has impacts as rounded up bytes, by document and term; ``rows`` and ``cols`` are its cells.
    """
    axes = np.random.default_rng(seed).standard_normal((matrix.shape[1], DIMENSIONS), np.float32)
    place = np.zeros((len(matrix), DIMENSIONS), np.float32)
    np.add.at(place, rows, axes[cols] * matrix[rows, cols, None])
    order = np.lexsort((rows, cols))
    rows, cols = rows[order], cols[order]
    terms, first = np.unique(cols, return_index=True)
    last = np.append(first[1:], len(cols))
    of_term, size, members, summaries = [], [], [], []
    for t, a, b in zip(terms.tolist(), first.tolist(), last.tolist()):
        docs = rows[a:b]
        if len(docs) <= FEW:
            groups = [docs]
        else:
            # members that stand evenly along the list lead the clusters
            leads = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(int)]
            near = (place[docs] @ place[leads].T).argmax(axis=1)
            sort = np.argsort(near, kind="stable")
            groups = np.split(docs[sort], np.flatnonzero(np.diff(near[sort])) + 1)
        for g in groups:
            of_term.append(t)
            size.append(len(g))
            members.append(g)
            if len(g) > FEW:
                summaries.append(matrix[g].max(axis=0))
    return {
        "block_terms": np.array(of_term, np.int32),
        "block_sizes": np.array(size, np.int32),
        "members": np.concatenate(members).astype(np.int32) if members else np.empty(0, np.int32),
        "summaries": np.array(summaries, np.uint8).reshape(len(summaries), matrix.shape[1]),
    }


_PARTS = {"offsets": np.int32, "terms": np.int32, "impacts": np.int32, "block_terms": np.int32, "block_sizes": np.int32,
          "members": np.int32, "summaries": np.uint8}


def build_index(counted: DataFrame, statistics: Statistics) -> DataFrame:
    """One row per shard: its documents' ids, their impacts by term, and the blocks of its posting lists.

    ``probe`` marks a sixteenth of the shards. The index is written to shared storage.
    """
    width = len(statistics.weights)
    shard = max(16, min(SHARD, CELLS // max(width, 1)))

    def indexed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        held, size, made = [], 0, TaskContext.get().partitionId()

        def row(parts: list):
            nonlocal made
            rows = pa.Table.from_batches(parts).combine_chunks()
            terms, counts = rows["terms"].chunk(0), rows["counts"].chunk(0)
            offsets = terms.offsets.to_numpy().astype(np.int64)
            cols = terms.flatten().to_numpy().astype(np.int64)
            where = np.repeat(np.arange(len(rows)), np.diff(offsets))
            damping = statistics.dampings(rows["n"].to_numpy())
            values = impacts(counts.flatten().to_numpy(), damping[where])
            matrix = np.zeros((len(rows), width), np.uint8)
            matrix[where, cols] = -(-values // STEP)
            data = {"offsets": offsets - offsets[0], "terms": cols, "impacts": values} | _blocks(matrix, where, cols)
            made += 1
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows["doc_id"].combine_chunks())
            packed = [pa.array([pa.compress(data[k].astype(d).tobytes(), "zstd", asbytes=True)], pa.binary()) for k, d in _PARTS.items()]
            lengths = pa.array([[data[k].size * np.dtype(d).itemsize for k, d in _PARTS.items()]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([made * 0x9E3779B1 % (1 << 32) % PROBE == 0]), ids, lengths, *packed],
                names=["probe", "ids", "lengths", *_PARTS],
            )

        for batch in batches:
            while len(batch):
                piece = batch.slice(0, shard - size)
                batch = batch.slice(len(piece))
                held.append(piece)
                size += len(piece)
                if size == shard:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    kind = counted.schema["doc_id"].dataType.simpleString()
    schema = f"probe boolean, ids array<{kind}>, lengths array<long>, " + ", ".join(f"{k} binary" for k in _PARTS)
    # documents without a known term are in no list; they counted for the statistics
    rows = counted.filter(F.size("terms") > 0).mapInArrow(indexed, schema)
    path = f"{scratch_folder(counted.sparkSession)}/{uuid.uuid4().hex}"
    # a reader holds a row group, and rows are large
    by_size = {"parquet.block.row.count.limit": GROUP, "maxRecordsPerFile": FILE}
    rows.write.partitionBy("probe").options(**by_size).parquet(path)
    return counted.sparkSession.read.schema(rows.schema).parquet(path)


class _Best:
    """The best documents of one query so far, and the score that others must reach."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor, self.held = k, floor, []

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.held += [(-s, i is None, i) for s, i in zip(scores.tolist(), ids)]
        if len(self.held) > self.k:
            # without ids that are null, which do not compare
            self.held.sort(key=lambda x: x[:2] + ((x[2],) if not x[1] else ()))
            del self.held[self.k :]
            self.floor = max(self.floor, -self.held[-1][0])
        elif len(self.held) == self.k:
            self.floor = max(self.floor, -max(x[0] for x in self.held))


def _search_shard(ids, data: dict[str, np.ndarray], width: int, queries: list, best: list[_Best]) -> None:
    """Add the documents of one shard that reach the floor of their query."""
    offsets = data["offsets"]
    matrix = np.zeros((len(offsets) - 1, width), np.int32)
    matrix[np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), data["terms"]] = data["impacts"]
    largest = matrix.max(axis=0).astype(np.int64)
    of_term, sizes, members = data["block_terms"], data["block_sizes"], data["members"]
    ends = np.cumsum(sizes, dtype=np.int64)
    summary_of = np.where(sizes > FEW, np.cumsum(sizes > FEW) - 1, -1)
    summaries = data["summaries"].reshape(-1, width)
    first, last = np.searchsorted(of_term, np.arange(width), "left"), np.searchsorted(of_term, np.arange(width), "right")
    for (terms, weights), own in zip(queries, best):
        # lists in the order of what they can add; the others cannot lift a document to the floor
        reach = weights * largest[terms]
        order = np.argsort(-reach, kind="stable")
        left = reach.sum() - np.cumsum(reach[order]) + reach[order]
        needed = order[(left >= own.floor) & (reach[order] > 0)]
        if not len(needed):
            continue
        blocks = spans(first[terms[needed]], last[terms[needed]])
        with_summary = summary_of[blocks] >= 0
        opened = ~with_summary
        rows = summary_of[blocks[with_summary]]
        opened[with_summary] = (summaries[rows[:, None], terms[None, :]].astype(np.int64) * STEP) @ weights >= own.floor
        blocks = blocks[opened]
        docs = np.unique(members[spans(ends[blocks] - sizes[blocks], ends[blocks])])
        scores = matrix[docs[:, None], terms[None, :]].astype(np.int64) @ weights
        good = scores >= own.floor
        if good.any():
            own.add(scores[good], [ids[i].as_py() for i in docs[good].tolist()])


def search_index(index: DataFrame, queries: list, width: int, k: int, floors: list[int]) -> DataFrame:
    """``query``, ``doc_id`` and ``score`` of the k best documents of each task for each query."""

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = [_Best(k, f) for f in floors]
        kind = None
        for batch in batches:
            for i in range(len(batch)):
                at = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                kind = at["ids"].values.type
                data = {
                    c: np.frombuffer(pa.decompress(at[c].as_py(), n, "zstd", asbytes=True) if n else b"", d)
                    for (c, d), n in zip(_PARTS.items(), at["lengths"].as_py())
                }
                _search_shard(at["ids"].values, data, width, queries, best)
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, b in enumerate(best) for _ in b.held], pa.int32()),
                    pa.array([x[2] for b in best for x in b.held], kind),
                    pa.array([-x[0] for b in best for x in b.held], pa.int64()),
                ],
                names=["query", "doc_id", "score"],
            )

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.drop("probe").mapInArrow(searched, f"query int, doc_id {kind}, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """Adds ``rank``; Spark keeps k rows of a query per task before rows move."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(docs: DataFrame, asked: list[str], text: str, k: int) -> DataFrame:
    """``said`` (the query), ``rank``, ``doc_id`` and ``score`` for a bounded number of queries."""
    counts = [Counter(terms_of(q.encode())) for q in asked]
    known = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(counts))))}
    counted, seen = settle_measured(
        count_terms(docs, text, known),
        [F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("length")],
    )
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    frequency = np.zeros(len(known), np.int64)
    for r in held:
        frequency[r["term"]] = r["n"]
    n, length = seen["n"] or 0, seen["length"] or 0
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in frequency]
    statistics = Statistics(n, max(length, 1), np.array(weights, np.int64))
    queries = []
    for c in counts:
        terms = np.array(sorted(known[t] for t in c), np.int64)
        times = {known[t]: x for t, x in c.items()}
        queries.append((terms, np.array([times[t] * weights[t] for t in terms.tolist()], np.int64)))
    index = build_index(counted, statistics)
    # scores of some documents are a floor for all
    floors = [1] * len(asked)
    probed = _ranked(search_index(index.filter("probe"), queries, len(known), k, floors), k)
    for r in probed.filter(F.col("rank") == k).select("query", "score").collect():
        floors[r["query"]] = max(1, r["score"])
    hits = _ranked(search_index(index, queries, len(known), k, floors), k)
    names = docs.sparkSession.createDataFrame(list(enumerate(asked)), "query int, said string")
    return hits.join(F.broadcast(names), "query").select("said", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, text: str = "text", k: int = 10) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the k best documents for each row of ``items``.

    Only scores above 0 count; equal scores are ranked by ascending ``doc_id``, null ids last. A
    null or empty text has no terms: such documents are never found, and such items find nothing.
    Rows that share an id are documents, or items, of their own. Columns other than ``doc_id`` and
    ``text``, or ``item_id`` and ``text``, are not read; empty tables give no rows. Texts are read
    whole. Different queries go in blocks of 512 against all documents; a block's queries and their
    terms are the only thing that the driver and all tasks hold.
    """
    docs = docs.select("doc_id", text)
    items = settle(items.select("item_id", F.col("text").alias("said")).filter("said IS NOT NULL"))
    texts = settle(items.select("said").distinct())
    size = one_row(texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("said")), F.lit(0)).alias("bytes")))
    parts = max(1, -(-size["n"] // QUERIES_AT_ONCE), -(-size["bytes"] // BYTES_AT_ONCE))
    found = None
    for part in range(parts):
        chosen = texts.filter(F.pmod(F.xxhash64("said"), F.lit(parts)) == part)
        asked = sorted(r["said"] for r in chosen.collect())
        if asked or found is None:
            hits = settle(_search(docs, asked, text, k))
            found = hits if found is None else found.union(hits)
    # items of the same text have the same ranks
    ranks = found.groupBy("said").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("ranks"))
    rows = attach_aggregate(items, ranks, "said", how="inner")
    return rows.select("item_id", F.inline("ranks")).select("item_id", "rank", "doc_id", "score")
