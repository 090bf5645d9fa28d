"""Exact n-gram Jaccard links and their components, by a token-group matrix.

Texts with equal shingle sets are one node. Similar nodes are put into groups: nodes that agree
in two minima of their hashed shingles meet, and a group is what is linked among them. The
matrix stores, per group, the union of the shingles by which its members can be found. Two sets
that are similar enough share one of their first shingles in a common order (rarest first, as
far as a sketch of fixed size knows), so a group is looked up only by those, and what their
places leave to share bounds the overlap. Groups that pass are opened: first their leaders are
bounded by small counts of their shingles per hash bucket, and compared exactly where that leaves room, then, where no link was found, each member is bounded against the other
group's whole union, and compared with its members if it passes.

Links inside a group are never listed in pairs, and a group that turns out to be connected counts
as one from then on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from surveyloom.llm.common import shuffle_partitions, whole_text
from surveyloom.llm.components import components
from surveyloom.llm.shingle_sets import WIDTH, shingle_sets
from surveyloom.llm.sketches import mix
from surveyloom.operators.lookup import attach, fits_broadcast, settle

#: Two sets are linked if ``100 * intersection >= PERCENT * union``.
PERCENT = 80
#: Counters of the frequency sketch (a power of two) and the parts in which they are added up.
SKETCH_BITS, SKETCH_PARTS = 20, 16
#: Counters of a set's profile: at least so many, one for about four shingles, at most so many.
PROFILE_LOW, PROFILE_HIGH = 32, 1 << 14
#: Members that meet in one task.
CHUNK = 256


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares at least with any set that it is linked to."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def node_of(tokens: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little") >> 1


def profile(tokens: np.ndarray) -> bytes:
    """How many shingles fall into each of some hash buckets, up to 255; a power of two of them."""
    size = min(PROFILE_HIGH, max(PROFILE_LOW, 1 << max(0, (len(tokens) // 4).bit_length())))
    held = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(held, 255).astype(np.uint8).tobytes()


def may_be_linked(a: bytes, size_a: int, b: bytes, size_b: int, percent: int = PERCENT) -> bool:
    """False only if the profiles leave too little to share: no bucket gives more than its smaller count."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.minimum(v.reshape(-1, n).sum(axis=0, dtype=np.int64), 255) for v in (x, y))
    if ((x == 255) & (y == 255)).any():
        return True
    return (100 + percent) * int(np.minimum(x, y).sum()) >= percent * (size_a + size_b)


def shingle_levels(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Binary logarithm of how often shingles of each hash bucket occur, over all documents.

    The sketch has a fixed number of counters; tasks send compressed parts of it. It only orders
    shingles, so what it confuses costs time and no links.
    """
    size = 1 << SKETCH_BITS
    step = size // SKETCH_PARTS

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size, np.uint64)
        for batch in batches:
            held, n = [], 0
            for tokens in shingle_sets(batch.column(0), width):
                held.append(tokens >> np.uint64(64 - SKETCH_BITS))
                n += len(tokens)
                if n > size:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=size).astype(np.uint64)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=size).astype(np.uint64)
        parts = [zlib.compress(total[i * step : (i + 1) * step].astype("<u8").tobytes(), 1) for i in range(SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"]
        )

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<u8") for x in group["counts"])
        level = np.frompyfunc(int.bit_length, 1, 1)(total.tolist()).astype(np.uint8)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "counts": [level.tobytes()]})

    schema = "part int, counts binary"
    sums = docs.select(whole_text(text)).mapInArrow(counted, schema).groupBy("part").applyInPandas(added, schema)
    levels = np.zeros(size, np.uint8)
    for r in sums.collect():
        levels[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["counts"], np.uint8)
    return levels


def describe_sets(docs: DataFrame, text: str, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per row: ``n`` shingles, the set's ``node``, its ``meeting`` of minima, its ``profile``, and its ``firsts`` in the common order.

    Profiles and first shingles come with the first row of a set in a task only, so that copies meet once per
    task. The result is to be written before it is used twice.
    """

    def described(batches: Iterator) -> Iterator:
        import pyarrow as pa

        told: set[int] = set()
        for batch in batches:
            n, nodes, meetings, firsts, profiles = [], [], [], [], []
            for tokens in shingle_sets(batch.column(batch.schema.get_field_index("__text")), width):
                n.append(len(tokens))
                if not len(tokens):
                    nodes.append(None)
                    meetings.append(None)
                    profiles.append(None)
                    firsts.append(np.empty(0, np.int64))
                    continue
                node = node_of(tokens)
                nodes.append(node)
                pair = np.array([tokens[0], mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).min()])
                meetings.append(int(mix(pair * np.array([3, 5], np.uint64)).sum() >> np.uint64(1)))
                if node in told:
                    profiles.append(None)
                    firsts.append(np.empty(0, np.int64))
                    continue
                told.add(node)
                profiles.append(profile(tokens))
                own = levels[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                keep = len(tokens) - needed(len(tokens), percent) + 1
                firsts.append(tokens[np.argsort(own, kind="stable")[:keep]].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(c)) for c in names],
                    pa.array(n, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(meetings, pa.int64()),
                    pa.array(profiles, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=[*names, "n", "node", "meeting", "profile", "firsts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(whole_text(text)).alias("content"), whole_text(text).alias("__text"))
    return rows.mapInArrow(described, f"doc_id {kind}, content long, n long, node long, meeting long, profile binary, firsts array<long>")


def with_texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (unique ``content``, other columns) with the text of that content, as ``said``.

    Texts move rather than sets: compressed they are half as large, and sets are made in no time.
    """
    rows = docs.select(F.xxhash64(whole_text(text)).alias("content"), whole_text(text).alias("said"))
    return settle(attach(rows, settle(wanted), "content", how="inner").dropDuplicates(["content"]))


def _sets_of(texts: pd.Series, width: int) -> list[np.ndarray]:
    import pyarrow as pa

    return list(shingle_sets(pa.array(texts.tolist(), pa.large_string()), width))


def _grouped(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first one that it is connected with through links among them."""
    group = list(range(len(sets)))
    leaders: list[int] = []

    def top(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, own in enumerate(sets):
        for j in leaders:  # most are linked to a leader
            if linked(sets[j], own, percent):
                group[i] = top(j)
                break
        else:
            leaders.append(i)
    # links between members of different groups, where the union of a group leaves room for one
    members: dict[int, list[int]] = {}
    for i in range(len(sets)):
        members.setdefault(top(i), []).append(i)
    if len(members) > 1:
        unions = {g: np.unique(np.concatenate([sets[i] for i in m])) for g, m in members.items()}
        for i, own in enumerate(sets):
            for g, union in unions.items():
                if top(g) != top(i) and np.isin(own, union, assume_unique=True).sum() >= needed(len(own), percent):
                    for j in members[g]:
                        if linked(own, sets[j], percent):
                            a, b = sorted((top(i), top(j)))
                            group[b] = a
                            break
    return [top(i) for i in range(len(sets))]


def _first_groups(docs: DataFrame, text: str, width: int, percent: int, nodes: DataFrame) -> DataFrame:
    """``node`` and ``unit``: the group of nodes that agree in their minima and are linked there."""
    sizes = nodes.groupBy("meeting").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("content", "node").alias("lead")
    ).filter("members > 1")
    met = attach(nodes.select("node", "content", "meeting"), settle(sizes), "meeting", how="inner")
    held = with_texts(docs, text, met)
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    leads = F.col("content") == F.col("lead")
    # the lead goes to every chunk, so that what is linked to it is one group across chunks
    dealt = held.withColumn(
        "chunk",
        F.explode(F.when(leads, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), chunks).cast("int")))),
    ).withColumn("follows", (~leads).cast("int"))

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["follows", "node"])
        found = _grouped(_sets_of(part["said"], width), percent)
        nodes_in = part["node"].to_numpy()
        return pd.DataFrame({"node": nodes_in, "unit": nodes_in[found]})

    parts = dealt.select("meeting", "chunk", "follows", "node", "said").groupBy("meeting", "chunk")
    return settle(parts.applyInPandas(group, "node long, unit long").distinct())


def _candidates(rows: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups, ``a`` below ``b``, that share a first shingle and whose sizes and places leave room for a link."""
    n = shuffle_partitions(rows.sparkSession)
    rows = rows.select("node", "n", F.posexplode("firsts").alias("at", "token"))
    # size and room in one number, as this is the largest exchange
    sizes = F.shiftleft(F.col("n"), 32) + (F.col("n") - F.col("at"))
    rows = rows.select("token", "node", sizes.alias("sizes")).repartition(n, "token")
    small = fits_broadcast(units)
    # most shingles are of one set alone, and go before the groups of sets are looked up
    shared = rows.groupBy("token", "node").agg(F.max("sizes").alias("sizes"))
    sets = F.count(F.lit(1)).over(Window.partitionBy("token"))
    shared = shared.withColumn("sets", sets).filter("sets > 1").drop("sets")
    # rows stay where they are if the groups can be broadcast
    shared = attach(shared if small else settle(shared), units, "node", small=small).withColumn("unit", F.coalesce("unit", "node"))
    shared = shared if small else shared.repartition(n, "token")
    size, room = F.shiftright("sizes", 32), F.col("sizes").bitwiseAND((1 << 32) - 1)
    # the matrix: one row per shingle and group, with the sizes of its members
    matrix = shared.groupBy("token", "unit").agg(F.min(size).alias("low"), F.max(size).alias("high"), F.max(room).alias("room"))
    groups = F.count(F.lit(1)).over(Window.partitionBy("token"))
    matrix = settle(matrix.withColumn("groups", groups).filter("groups > 1").drop("groups"))
    a = matrix.select("token", *[F.col(c).alias(f"{c}_a") for c in ("unit", "low", "high", "room")])
    b = matrix.select("token", *[F.col(c).alias(f"{c}_b") for c in ("unit", "low", "high", "room")])
    fits = (
        (F.col("unit_a") < F.col("unit_b"))
        & (100 * F.col("high_a") >= percent * F.col("low_b"))
        & (100 * F.col("high_b") >= percent * F.col("low_a"))
        & ((100 + percent) * F.least("room_a", "room_b") >= percent * (F.col("low_a") + F.col("low_b")))
    )
    pairs = a.join(b, "token").filter(fits).select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
    return settle(pairs.distinct())


def _within_bounds(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs whose leaders' profiles leave room for a link."""

    @F.pandas_udf("boolean")
    def leave_room(a: pd.Series, size_a: pd.Series, b: pd.Series, size_b: pd.Series) -> pd.Series:
        return pd.Series([may_be_linked(*x, percent) for x in zip(a, size_a, b, size_b)], dtype=bool)

    asked = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    held = attach(rows.filter("profile IS NOT NULL").select("node", "n", "profile"), asked, "node", how="inner")
    held = settle(held.groupBy("node").agg(F.first("n").alias("n"), F.first("profile").alias("profile")))
    both = pairs
    for s in ("a", "b"):
        both = both.join(held.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("profile").alias(f"of_{s}")), s)
    return settle(both.filter(leave_room("of_a", "n_a", "of_b", "n_b")).select("a", "b"))


def _compare_leaders(pairs: DataFrame, leads: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose leaders are linked."""

    @F.pandas_udf("boolean")
    def are_linked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(a, b, percent) for a, b in zip(_sets_of(x, width), _sets_of(y, width))], dtype=bool)

    first = pairs.join(leads.select(F.col("node").alias("a"), F.col("said").alias("x")), "a")
    both = first.join(leads.select(F.col("node").alias("b"), F.col("said").alias("y")), "b")
    return both.filter(are_linked("x", "y")).select("a", "b")


def _open_groups(pairs: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs of groups, of which no leaders are linked, that have a link between members.

    ``pairs`` has the numbers of members. The members of the smaller group are the queries, and
    go to each chunk of the larger one, whose members are there once for all queries (or once
    for so many of them, where very many groups ask).
    """
    asks = F.col("members_a") <= F.col("members_b")
    pairs = pairs.select(
        "a", "b", F.when(asks, F.col("a")).otherwise(F.col("b")).alias("query"),
        F.when(asks, F.col("b")).otherwise(F.col("a")).alias("group"), F.least("members_a", "members_b").alias("n"),
    )
    load = pairs.groupBy("group").agg(F.ceil(F.sum("n") / (4 * CHUNK)).cast("int").alias("salts"))
    own = members.select(F.col("unit").alias("group"), "node", "members", "said").join(load, "group")
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    held = own.select(
        "group", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("query"), "said",
    )
    counts = own.groupBy("group").agg(F.max(chunks).alias("chunks"), F.max("salts").alias("salts"))
    asked = pairs.join(counts, "group").join(members.select(F.col("unit").alias("query"), "node", "said"), "query")
    asked = asked.select(
        "group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "query", "said",
    )

    def opened(part: pd.DataFrame) -> pd.DataFrame:
        inside = part["query"].isna()
        sets = _sets_of(part.loc[inside, "said"], width)
        found = set()
        if sets:
            union = np.unique(np.concatenate(sets))
            asked = part.loc[~inside]
            for query, x in zip(asked["query"].astype("int64"), _sets_of(asked["said"], width)):
                # a bound for all members at once, then each of them
                if query not in found and np.isin(x, union, assume_unique=True).sum() >= needed(len(x), percent):
                    if any(linked(x, y, percent) for y in sets):
                        found.add(query)
        return pd.DataFrame({"a": part["group"].iloc[0], "b": np.array(sorted(found), np.int64)})

    both = held.unionByName(asked).withColumn("query", F.col("query").cast("string"))
    return both.groupBy("group", "chunk", "salt").applyInPandas(opened, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two rows are linked if ``100 * intersection >= percent * union`` of their sets of word
    shingles; ``component_id`` is the smallest ``doc_id`` that links reach, itself included. Null
    and empty texts, and texts of white space, have no shingles and no links: they are their own
    component. Repeated rows are rows each; rows with equal sets are linked whatever their ids
    are, and a component of null ids alone has a null id. Other columns are left out, and an
    empty table gives no rows. No link between different texts is lost: nothing is capped.

    Sets are named and compared by 64-bit hashes.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    levels = shingle_levels(docs, "text", width)
    rows = settle(describe_sets(docs, "text", width, percent, levels))
    # one row per set: copies of a text, a third of all rows or more, are one before rows move
    nodes = settle(rows.filter("n > 0").groupBy("node").agg(F.min("content").alias("content"), F.max("meeting").alias("meeting")))
    units = _first_groups(docs, "text", width, percent, nodes)
    nodes = settle(attach(nodes.drop("meeting"), units, "node").withColumn("unit", F.coalesce("unit", "node")))
    pairs = _candidates(rows, units, percent)
    close = _within_bounds(pairs, rows, percent)
    asked = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    leads = with_texts(docs, "text", nodes.select("node", "content").join(asked, "node", "left_semi"))
    links = settle(_compare_leaders(close, leads, percent, width))
    found = components(links)
    # groups of several members that are not connected yet are opened
    sizes = nodes.groupBy("unit").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    label = found.select(F.col("node").alias("unit"), "component")
    left = pairs
    for s in ("a", "b"):
        left = left.join(label.select(F.col("unit").alias(s), F.col("component").alias(f"in_{s}")), s, "left")
        left = left.join(sizes.select(F.col("unit").alias(s), F.col("members").alias(f"members_{s}")), s, "left")
    left = left.filter(
        (F.coalesce("in_a", "a") != F.coalesce("in_b", "b")) & (F.coalesce("members_a", "members_b").isNotNull())
    )
    one = [F.coalesce(f"members_{s}", F.lit(1)).alias(f"members_{s}") for s in ("a", "b")]
    left = settle(left.select("a", "b", *one))
    if not left.isEmpty():
        open_units = left.select(F.col("a").alias("unit")).union(left.select("b")).distinct()
        inside = nodes.select("node", "content", "unit").join(open_units, "unit", "left_semi")
        inside = inside.join(sizes, "unit", "left").withColumn("members", F.coalesce("members", F.lit(1)))
        members = with_texts(docs, "text", inside)
        links = settle(links.union(_open_groups(left, members, percent, width)))
        found = components(links)
    nodes = nodes.select("node", "unit")
    of_node = nodes.join(found.select(F.col("node").alias("unit"), "component"), "unit", "left")
    of_node = of_node.select("node", F.coalesce("component", "unit").alias("component"))
    smallest = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(of_node, "node")
    named = smallest.groupBy("component").agg(F.min("first").alias("component_id"))
    lookup = smallest.select("node", "component").join(named, "component").select("node", "component_id")
    out = attach(rows.select("doc_id", "n", "node"), settle(lookup), "node")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
