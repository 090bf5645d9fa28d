"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

Texts are words of letters and digits in lower case. A window is as many words of a document as
a benchmark item has, placed where the document has a shingle at the same place as the item; a
window without any shared shingle cannot be similar. Windows and items have 64-bit SimHashes of
their weighted shingles; a shingle weighs as much as it has characters. Pairs of one size whose
SimHashes differ in at most ``RADIUS`` bits are verified by the exact weighted similarity.

Eight blocks of eight bits find all pairs within the radius: of 23 different bits at most two
fall into one of the blocks, and items are indexed under every value within two bits of theirs.
At a similarity of 0.8 about 10 of 64 bits differ, with a deviation of 3, so a window that lies
beyond the radius is some four deviations off.

Everything is built-in column functions and joins on hashes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.operators.lookup import attach, fits_broadcast, settle

SHINGLE, SIMILAR = 5, 0.8
BLOCKS, BLOCK_BITS, FLIPPED = 8, 8, 2
RADIUS = BLOCKS * (FLIPPED + 1) - 1
#: Rows and bytes up to which the index of the items' blocks is broadcast (296 rows an item).
INDEX_ROWS, INDEX_BYTES = 4_000_000, 128 * 1024 * 1024
_HASH_DIGITS = 16


def words_of(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Hash of each shingle of ``width`` words, by place; empty for fewer words."""

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(width)])

    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<bigint>"))


def weighted_shingles(words: Column, width: int) -> Column:
    """Distinct shingles as strings of 16 hash digits and the number of characters, which is the weight.

    Strings are told apart by hash sets, so long texts take linear time; structs would be compared in pairs.
    """

    def weighed(i: Column) -> Column:
        own = [F.get(words, i + j) for j in range(width)]
        return F.concat(F.lpad(F.hex(F.xxhash64(*own)), _HASH_DIGITS, "0"), F.char_length(F.concat(*own)).cast("string"))

    last = F.size(words) - width
    made = F.transform(F.sequence(F.lit(0), last), weighed)
    return F.when(last >= 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _weight_of(shingle: Column) -> Column:
    return F.substring(shingle, _HASH_DIGITS + 1, 20).cast("long")


def weight(x: Column) -> Column:
    """Sum of the weights of weighted shingles."""
    return F.aggregate(x, F.lit(0).cast("long"), lambda n, s: n + _weight_of(s))


def similarity(a: Column, b: Column) -> Column:
    """Weight of the common shingles over the weight of all, for distinct weighted shingles."""
    both = weight(F.array_intersect(a, b))
    return both / (weight(a) + weight(b) - both)


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of weighted shingles: a bit is set if more than half of the weight has it.

    Two bits, 32 places apart, are counted in the halves of one sum.
    """
    half, total = (1 << 32) - 1, weight(shingles)
    hashed = F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("h"), _weight_of(s).alias("w")))
    pair = F.lit((1 << 32) + 1)
    bits = F.lit(0).cast("long")
    for b in range(32):
        counted = F.aggregate(
            hashed, F.lit(0).cast("long"), lambda n, s: n + s["w"] * F.shiftrightunsigned(s["h"], b).bitwiseAND(pair)
        )
        for at, own in ((b, counted.bitwiseAND(half)), (b + 32, F.shiftrightunsigned(counted, 32))):
            one = F.lit(-(1 << 63) if at == 63 else 1 << at)
            bits = bits.bitwiseOR(F.when(own * 2 > total, one).otherwise(F.lit(0)).cast("long"))
    return bits


def _blocks(bits: Column) -> list[Column]:
    return [F.shiftrightunsigned(bits, i * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1) for i in range(BLOCKS)]


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """All pairs of windows and items of one size whose SimHashes differ in at most ``RADIUS`` bits.

    ``windows`` has ``window``, ``size`` and ``bits``; ``items`` has ``item``, ``size`` and
    ``item_bits``. The items are indexed under each value of each block within ``FLIPPED`` bits.
    A pair comes once, from the first block that finds it.
    """
    masks = [sum(1 << b for b in bits) for n in range(FLIPPED + 1) for bits in combinations(range(BLOCK_BITS), n)]
    each = items.select("item", "size", "item_bits", F.posexplode(F.array(*_blocks(F.col("item_bits")))).alias("block", "own"))
    each = each.select("item", "size", "item_bits", "block", "own", F.explode(F.lit(masks)).alias("mask"))
    index = settle(each.select("item", "size", "item_bits", "block", F.col("own").bitwiseXOR(F.col("mask").cast("long")).alias("value")))
    probes = windows.select("window", "size", "bits", F.posexplode(F.array(*_blocks(F.col("bits")))).alias("block", "value"))
    small = fits_broadcast(index, INDEX_ROWS, INDEX_BYTES)
    found = probes.join(F.broadcast(index) if small else index.hint("merge"), ["size", "block", "value"])
    other = F.col("bits").bitwiseXOR(F.col("item_bits"))
    first = F.coalesce(*[F.when(F.bit_count(x) <= FLIPPED, F.lit(i)) for i, x in enumerate(_blocks(other))])
    return found.filter((F.bit_count(other) <= RADIUS) & (F.col("block") == first)).select("window", "item")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similar: float = SIMILAR,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs of documents and benchmark items where a window of the document is a copy.

    One row per id and item with ``similarity`` (of the best window), ``n_windows`` and
    ``first_word`` (place of the first such window). Items of fewer than five words are one
    shingle. Null and empty texts and items have no words and are in no pair; rows of an id
    count together, and so do rows of an item id, null ids too; other columns are left out. An
    empty table gives no rows.

    All windows whose SimHash lies within ``RADIUS`` bits of an item's of their size are checked. The
    documents' texts stay where they are: what moves are the shingles that an item has too.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("size", F.size("words"))
    items = settle(items.withColumn("width", F.least(F.lit(SHINGLE), "size")))
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # at most five
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    out = None
    for width in sorted(widths):
        found = _leaks_of_width(texts, items.filter(F.col("width") == width), width, similar)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = _nothing(texts, items)
    best = out.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("n_windows"), F.min("start").alias("first_word")
    )
    return best.withColumnsRenamed({"doc_id": id_column, "item_id": item_id})


def _nothing(texts: DataFrame, items: DataFrame) -> DataFrame:
    return texts.limit(0).select("doc_id", F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).crossJoin(
        items.limit(0).select("item_id")
    )


def _leaks_of_width(texts: DataFrame, items: DataFrame, width: int, similar: float) -> DataFrame:
    places = items.select("size", F.posexplode(shingles_of(F.col("words"), width)).alias("at", "h")).distinct()
    # where documents have an item's shingle, and where an item-sized window then starts
    small = fits_broadcast(places)
    each = texts.select("doc_id", words_of(F.col("text")).alias("words")).select(
        "doc_id", F.posexplode(shingles_of(F.col("words"), width)).alias("place", "h")
    )
    hits = each.join(F.broadcast(places) if small else places, "h")
    starts = settle(
        hits.select("doc_id", "size", F.greatest(F.col("place") - F.col("at"), F.lit(0)).alias("start")).distinct()
    )
    # the words of those windows, from the documents that have any
    per_doc = starts.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("windows"))
    held = attach(texts, settle(per_doc), "doc_id", how="inner", null_safe=True)
    cut = held.select("doc_id", words_of(F.col("text")).alias("words"), "windows").select(
        "doc_id", "words", F.explode("windows").alias("w")
    )
    own = cut.select(
        "doc_id", F.col("w.start").alias("start"), F.col("w.size").alias("size"), F.slice("words", F.col("w.start") + 1, F.col("w.size")).alias("words")
    )
    own = own.select("doc_id", "start", "size", weighted_shingles(F.col("words"), width).alias("shingles"))
    # equal windows are one, and so are equal items: documents that share a passage share its fingerprint
    own = settle(own.withColumn("window", F.xxhash64("size", "shingles")))
    kinds = _with_bits(own.groupBy("window", "size").agg(F.min("shingles").alias("shingles")), "bits")
    sides = items.select("item_id", "size", weighted_shingles(F.col("words"), width).alias("item_shingles"))
    sides = settle(sides.withColumn("item", F.xxhash64("size", "item_shingles")))
    item_kinds = sides.groupBy("item", "size").agg(F.min("item_shingles").alias("shingles"))
    item_kinds = _with_bits(item_kinds, "item_bits").withColumnRenamed("shingles", "item_shingles")
    pairs = within_radius(kinds, item_kinds)
    checked = attach(pairs, item_kinds.select("item", "item_shingles"), "item", how="inner")
    checked = checked.join(kinds.select("window", "shingles"), "window")
    good = checked.select(
        "window", "item", similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity")
    ).filter(F.col("similarity") >= similar)
    good = settle(good).join(sides.select("item", "item_id"), "item")
    return own.select("doc_id", "start", "window").join(good, "window").select("doc_id", "item_id", "start", "similarity")


def _with_bits(kinds: DataFrame, name: str) -> DataFrame:
    """The shingles' SimHash beside them, written once; the first write keeps them from being made 64 times."""
    return settle(settle(kinds).withColumn(name, simhash(F.col("shingles"))))
