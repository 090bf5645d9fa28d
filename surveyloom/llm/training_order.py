"""Training-order materialisation of token sequences.

Documents become sequences of a fixed number of tokens. Every sequence has an index, made of a
hash of its document's id and text and of its place there, below a bound that is known from the
longest text. A keyed Feistel network over the next power of four permutes the indices;
values beyond the bound are permuted again until they fall inside (cycle-walking). The order of
the permuted indices is the training order, and a sequence's slot is its rank in it; neither
depends on how the input is partitioned. The hash spreads documents without an id, with one that
repeats, or with ids that lie far apart like all others; where two documents share one, id and
content decide.

Ranges of the permuted indices are the shards, one file each, in which every record takes the
same number of bytes. The slots of a shard begin where those of the shard before it end, so a
reader that has the number of records of each shard can start at any slot. Shards are written
under a temporary name and then renamed, and their content follows from the input and the key,
so a repeated task leaves the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from surveyloom.llm.common import whole_text
from surveyloom.llm.packing import END
from surveyloom.llm.sketches import mix
from surveyloom.llm.token_ids import proofs, token_ids
from surveyloom.operators.lookup import attach, scratch_folder, settle

LENGTH, PAD, ROUNDS = 256, 0, 4
#: Bytes of text that a shard takes about.
SHARD_TEXT = 16 << 20
#: The indices that are permuted, about.
INDICES = 1 << 61
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each index below n: a permutation of 0..n-1 that the key decides."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * _GOLD)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right * _GOLD + k) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        slot = once(index.astype(np.uint64))
        while (outside := slot >= np.uint64(n)).any():
            slot[outside] = once(slot[outside])
    return slot.astype(np.int64)


def token_sequences(
    docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document's ids and its end token in pieces of ``length``; the last one may be shorter.

    ``ids`` are little-endian, of 16 bits if the vocabulary allows it and else of 32.
    """
    proved = proofs(path)
    wide = is_wide(path)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, content long, piece int, n_tokens int, ids binary"

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = token_ids(proved)
        for batch in batches:
            at, pieces, n_tokens, ids = [], [], [], []
            for i, content in enumerate(batch.column(2)):
                own = np.append(np.frombuffer(reader.encode(content.as_py()), "<u4"), np.uint32(end_id))
                own = own.astype("<u4" if wide else "<u2")
                for piece, start in enumerate(range(0, len(own), length)):
                    some = own[start : start + length]
                    at.append(i)
                    pieces.append(piece)
                    n_tokens.append(len(some))
                    ids.append(some.tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pieces, pa.int32()),
                    pa.array(n_tokens, pa.int32()), pa.array(ids, pa.binary()),
                ],
                names=[id_column, "content", "piece", "n_tokens", "ids"],
            )

    content = whole_text(text)
    return docs.select(F.col(id_column), F.xxhash64(content).alias("content"), content.alias("__text")).mapInArrow(cut, schema)


def materialise(
    docs: DataFrame,
    path: str,
    folder: str,
    key: int,
    length: int = LENGTH,
    shard_text: int = SHARD_TEXT,
    pad_id: int = PAD,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all documents as shards in training order below ``folder``; one row per sequence.

    Columns: the id column (an integer), ``piece``, ``n_tokens`` (without padding), ``slot``,
    ``shard``, ``byte_offset``, ``stride`` and ``ids_crc32`` of the record as written, padding
    included. A null or empty text is its end token. Rows that repeat an id, and null ids, are placed
    by their content; rows alike in both share their places in the order and follow each other
    there. Other columns are left out. An empty table writes nothing and gives no rows.

    ``folder`` is a URI that executors can write to. The token ids move once, to the shard of
    their slot, and are kept nowhere else.
    """
    spark = docs.sparkSession
    known = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.octet_length(whole_text(text))).alias("longest"),
        F.sum(F.octet_length(whole_text(text))).alias("bytes"),
    ).first()
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, piece int, n_tokens int, shard long, nth long, byte_offset long, stride int, ids_crc32 long"
    )
    width = 4 if is_wide(path) else 2
    stride = width * length
    # a token has at least one byte of text, and each document has an end token
    most = ((known["longest"] or 0) + 1 + length - 1) // length
    places = INDICES // most
    bound = places * most
    shards = max(1, -(-(known["bytes"] or 0) // shard_text))
    share = -(-bound // shards)
    index = F.pmod(F.xxhash64(F.col(id_column).cast("long"), "content"), F.lit(places)) * most + F.col("piece")
    placed = token_sequences(docs, path, length, id_column=id_column, text=text).withColumn(
        "walked", permuted(index, bound, key)
    )
    placed = placed.withColumn("shard", F.expr(f"walked div {share}L"))
    dealt = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("walked", id_column, "content", "piece")
    filler = np.full(length, pad_id, f"<u{width}").tobytes()

    def write(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        shard, out, temporary, nth = None, None, None, 0

        def close():
            if out is not None:
                out.close()
                system.move(temporary, shard_name(root, shard))

        for batch in batches:
            crcs, places = [], []
            for own, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
                if own != shard:
                    close()
                    shard, temporary, nth = own, f"{root}/.{own}-{uuid.uuid4().hex}", 0
                    out = system.open_output_stream(temporary)
                record = ids + filler[len(ids) :]
                out.write(record)
                crcs.append(zlib.crc32(record))
                places.append(nth)
                nth += 1
            places = np.array(places, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in (id_column, "piece", "n_tokens", "shard")], pa.array(places),
                    pa.array(places * stride), pa.array([stride] * len(places), pa.int32()), pa.array(crcs, pa.int64()),
                ],
                names=[id_column, "piece", "n_tokens", "shard", "nth", "byte_offset", "stride", "ids_crc32"],
            )
        close()

    # written once, and read from then on: no later use of the rows writes the shards again
    written = settle(dealt.mapInArrow(write, schema))
    out = attach(written, settle(shard_bases(written)), "shard", how="inner")
    return out.select(
        id_column, "piece", "n_tokens", (F.col("base") + F.col("nth")).alias("slot"), "shard", "byte_offset", "stride", "ids_crc32"
    )


def shard_bases(written: DataFrame) -> DataFrame:
    """The first slot of each ``shard``: a running total over shards, a thousand at a time."""
    counts = written.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("shard") / 1000))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block")
    return based.select("shard", (F.col("before") + F.col("inside")).alias("base"))


def is_wide(path: str) -> bool:
    """Whether ids need 32 bits."""
    return max(proofs(path)[1].values(), default=0) > 65_535


def shard_name(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def read_slots(folder: str, bases: dict[int, int], first: int, n: int, length: int = LENGTH, wide: bool = False) -> np.ndarray:
    """``n`` sequences from slot ``first`` on, read sequentially; how a trainer resumes.

    ``bases`` has the first slot of each shard, as ``shard_bases`` gives them.
    """
    from pyarrow import fs

    stride = (4 if wide else 2) * length
    system, root = fs.FileSystem.from_uri(folder)
    order = sorted(bases, key=bases.get)
    at = max(0, int(np.searchsorted([bases[s] for s in order], first, "right")) - 1)
    out = [np.empty((0, length), "<u4" if wide else "<u2")]
    for shard in order[at:]:
        if n <= 0:
            break
        with system.open_input_file(shard_name(root, shard)) as f:
            f.seek((first - bases[shard]) * stride)
            data = f.read(n * stride)
        out.append(np.frombuffer(data, out[0].dtype).reshape(-1, length))
        first, n = first + len(out[-1]), n - len(out[-1])
    return np.concatenate(out)


def shard_folder(spark: SparkSession, name: str) -> str:
    """A new folder for shards below the shared one, as a URI."""
    home = scratch_folder(spark)
    return f"{home if ':' in home else 'file://' + home}/{name}-{uuid.uuid4().hex}"


def permuted(index: Column, bound: int, key: int) -> Column:
    """The permuted index of an index column."""

    @F.pandas_udf("long")
    def walked(values: pd.Series) -> pd.Series:
        return pd.Series(feistel(values.to_numpy(np.int64), bound, key))

    return walked(index)
