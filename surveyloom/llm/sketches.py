"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are its windows of ``WIDTH`` code points (a shorter text is one shingle, an
empty one has none). The sketch keeps the ``k`` smallest distinct 48-bit hashes. Sketches of
parts merge into the sketch of the whole set, and two sketches estimate resemblance (shared
share of the union), containment and the number of distinct shingles. A text with at most
``k`` shingles is represented exactly.

A fingerprint is the base64 of the hashes in ascending order, six bytes each, highest first.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import object_strings, shuffle_partitions, whole_text

K, WIDTH, BITS = 128, 12, 48
#: Code points by which texts of one id are dealt to buckets.
HEAD = 512
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` values, built from windows of doubling length."""
    block, size, out, done = values, 1, None, 0
    while True:
        if width & 1:
            if out is None:
                out = block
            else:
                n = len(values) - (done + size) + 1
                out = mix(out[:n] * _STEP + block[done : done + n])
            done += size
        width >>= 1
        if not width:
            return out
        block = mix(block[:-size] * _STEP + block[size:])
        size *= 2


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def shingle_hashes(points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles of code points, repeated ones too."""
    if not len(points):
        return np.empty(0, np.uint64)
    seeds = mix((points.astype(np.uint64) + np.uint64(1)) * _STEP)
    return window_hashes(seeds, min(width, len(points))) >> np.uint64(64 - BITS)


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 16 * k:
        # almost always enough; repeated shingles can make it too few
        few = np.unique(hashes[hashes < np.uint64((1 << BITS) // len(hashes) * 4 * k)])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def encode_sketch(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode_sketch(fingerprint: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def resemblance_of(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over the union; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum() / len(union))


def distinct_of(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / (float(a[k - 1]) + 1)


def containment_of(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that are in b; an empty a is contained."""
    if not len(a):
        return 1.0
    both = distinct_of(np.union1d(a, b)[:k], k) * resemblance_of(a, b, k)
    return min(1.0, both / distinct_of(a, k))


def fingerprints(docs: DataFrame, text: str = "text", output: str = "fingerprint", k: int = K, width: int = WIDTH):
    """Add the fingerprint of each whole text; null and empty texts have the empty fingerprint.

    Rows are kept one by one with their other columns; equal texts get equal fingerprints.
    """
    if output in docs.columns:
        raise ValueError(f"Column {output} exists")

    @F.pandas_udf("string")
    def sketched(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([encode_sketch(bottom_k(shingle_hashes(code_points(x), width), k)) for x in batch])

    return docs.withColumn(output, sketched(whole_text(text)))


def compare(measure: str, a: str | Column, b: str | Column, k: int = K) -> Column:
    """``resemblance`` or ``containment`` (of a in b) of two fingerprint columns; null counts as empty."""
    function = {"resemblance": resemblance_of, "containment": containment_of}[measure]

    @F.pandas_udf("double")
    def compared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([function(decode_sketch(x), decode_sketch(y), k) for x, y in zip(left, right)])

    return compared(a, b)


def distinct_shingles(fingerprint: str | Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a fingerprint column."""

    @F.pandas_udf("double")
    def estimated(column: pd.Series) -> pd.Series:
        return pd.Series([distinct_of(decode_sketch(x), k) for x in column])

    return estimated(fingerprint)


def merge_fingerprints(parts: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One merged fingerprint per key (null is a key too).

    Every task first merges what it has, so that a key with a third of the rows sends one
    sketch per task; these meet in salted groups before the last merge.
    """
    salts = max(1, int(shuffle_partitions(parts.sparkSession) ** 0.5))
    kind = parts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{fingerprint}` string, __salt int"

    def merged(sketches: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, np.uint64)

    def by_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        salt, held = TaskContext.get().partitionId() % salts, {}

        def rows():
            return pd.DataFrame(
                {key: [x for x, _ in held.values()], fingerprint: [encode_sketch(s) for _, s in held.values()], "__salt": salt}
            )

        for batch in batches:
            for value, sketch in zip(batch[key], batch[fingerprint]):
                at = None if pd.isna(value) else value
                before = held.get(at, (at, np.empty(0, np.uint64)))[1]
                held[at] = at, merged([before, decode_sketch(sketch)])
            if len(held) > 50_000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def by_group(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1].copy()
        out[fingerprint] = encode_sketch(merged([decode_sketch(x) for x in group[fingerprint]]))
        return out

    partial = parts.select(key, fingerprint).mapInPandas(by_task, schema)
    salted = partial.groupBy(key, "__salt").applyInPandas(by_group, schema)
    return salted.groupBy(key).applyInPandas(by_group, schema).select(key, fingerprint)


def compare_with_edits(docs: DataFrame, k: int = K, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness.

    The edited text has its last ``n_chars // 3`` code points replaced by the first as many
    (or all) of the next document in descending ``doc_id`` (null ids last, repeated ids by
    text); after the last document comes the first. A null text counts as empty, a table of
    one row is followed by itself, and an empty table gives no rows. Other columns are left out.

    Each text moves once: rows go to buckets of neighbouring ids, and the first row of each
    bucket goes to the bucket before it as well. An id that many rows share, or the missing one,
    has several buckets by ranges of the text; only rows alike in id and text (or in its first
    ``HEAD`` code points) always share one. What the driver holds are the bounds and first
    ids of the buckets, whose number is about four per shuffle partition, and a few texts' heads for each.
    """
    spark = docs.sparkSession
    n = buckets or 4 * shuffle_partitions(spark)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNull().alias("absent"),
        whole_text().alias("text"),
    )
    present = F.when(~F.col("absent"), F.col("doc_id"))
    told = rows.agg(
        F.percentile_approx(present, [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if("absent").alias("absent"),
    ).first()
    bounds = np.array(told["cuts"] or [], np.int64)
    # how many buckets an id has, where these are more than one; None is the missing id
    values, times = np.unique(bounds, return_counts=True)
    shared = {int(v): int(m) for v, m in zip(values, times) if m > 1}
    if (absent := told["absent"] * n // max(1, told["rows"])) > 1:
        shared[None] = absent
    head = F.lit("")
    if shared:
        heavy = F.col("doc_id").isin([v for v in shared if v is not None]) & ~F.col("absent")
        heavy = (heavy | F.col("absent")) if None in shared else heavy
        head = F.when(heavy, F.left("text", F.lit(HEAD))).otherwise(F.lit(""))
        # where texts are cut decides nothing but the balance, so a sample does
        some = rows.filter(heavy).sample(min(1.0, 8.0 * n / told["rows"]), 7)
        heads = {v: [] for v in shared}
        for r in some.select("doc_id", "absent", head.alias("head")).collect():
            heads[None if r["absent"] else r["doc_id"]].append(r["head"])
        for v, own in heads.items():
            own.sort()
            heads[v] = sorted({own[i * len(own) // shared[v]] for i in range(1, shared[v])}) if own else []
    else:
        heads = {}

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, absent: pd.Series, texts: pd.Series) -> pd.Series:
        # descending: bucket 0 holds the largest ids, null ids come last
        ids = ids.to_numpy(np.int64)
        at = len(bounds) - np.searchsorted(bounds, ids, "left")
        # the first of the buckets of ids that have several
        first = np.minimum(at, len(bounds) - np.searchsorted(bounds, ids, "right") + 1)
        out = np.where(absent, len(bounds) + 1, first)
        if heads:
            out += [
                bisect_left(heads.get(None if none else i, ()), text)
                for i, none, text in zip(ids.tolist(), absent, texts)
            ]
        return pd.Series(out, dtype="int32")

    dealt = rows.withColumn("head", head).withColumn("home", bucket("doc_id", "absent", "head"))
    # complements of ids ascend where ids descend
    leading = F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "head"))
    firsts = sorted((r["home"], r["first"]) for r in dealt.groupBy("home").agg(leading.alias("first")).collect())
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    first_row = {home: (~first["down"], first["head"]) for home, first in firsts}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, homes: pd.Series, texts: pd.Series, contents: pd.Series) -> pd.Series:
        out, sent = [], set()
        for i, home, text, content in zip(ids, homes, texts, contents):
            # of rows that are alike one is enough
            guest = first_row[home] == (i, text) and (home, content) not in sent
            if guest:
                sent.add((home, content))
            out.append([home, before[home]] if guest else [home])
        return pd.Series(out)

    both = F.posexplode(places("doc_id", "home", "head", F.xxhash64("text"))).alias("guest", "bucket")
    copies = dealt.select("doc_id", "absent", "text", both)
    # bucket, then guests last: the row after a bucket's own rows is the first of the next
    ordered = copies.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions(
        "bucket", "guest", F.desc("doc_id"), "text"
    )
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: bucket, guest, id, text, sketch

        for batch in batches:
            out = []
            for doc_id, absent, text, guest, place in zip(*(batch[c] for c in ("doc_id", "absent", "text", "guest", "bucket"))):
                same = held is not None and held[0] == place
                if guest and not (same and not held[1]):
                    continue  # only the first guest follows
                points = code_points(text)
                sketch = bottom_k(shingle_hashes(points, width), k)
                if same:
                    _, _, own_id, own, own_points, own_sketch = held
                    cut = len(own_points) // 3
                    edited = np.concatenate([own_points[: len(own_points) - cut], points[:cut]])
                    edited_sketch = bottom_k(shingle_hashes(edited, width), k)
                    changed = own[: len(own) - cut] + text[:cut]
                    out.append(
                        (
                            own_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), encode_sketch(own_sketch),
                            encode_sketch(edited_sketch), resemblance_of(own_sketch, edited_sketch, k),
                            resemblance_of(own_sketch, sketch, k),
                        )
                    )
                held = place, guest, None if absent else doc_id, text, points, sketch
            if out:
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
                frame["doc_id"] = pd.array([r[0] for r in out], dtype="Int64")
                yield object_strings(frame)

    return ordered.mapInPandas(described, schema)
