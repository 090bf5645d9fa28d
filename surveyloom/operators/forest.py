"""Feature importance from a random forest.

The forest grows level by level. In each level every task adds up, tree by tree, how many rows and how
much of the target fall into each bin of the features that a node tries; the sums of a group of nodes meet
in one task, which finds the best splits. Which rows a tree draws follows from a number that is written
beside the row, so nothing is kept per row and tree between the passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil, exp, factorial, isinf, isnan

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from surveyloom.operators.checks import complete_rows
from surveyloom.operators.lookup import one_row, settle
from surveyloom.operators.models import rank_importance

BINS = 32
ROWS_AT_ONCE = 65_536
SUMS_BYTES = 64 * 1024 * 1024  # sums that a task holds; nodes that need more go in further passes
PART_BYTES = 64 * 1024  # sums of the nodes that one row hands on


@dataclass
class Level:
    """Per tree one entry per node of the level, and a last one for rows whose node is a leaf further up."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]  # bins up to this one go left
    child: list[np.ndarray]  # left and right number in the next level
    change: list[np.ndarray]  # mean of the left and right child less that of the node


def _cuts(data: DataFrame, columns: Sequence[str]) -> tuple[list[np.ndarray], float, float]:
    """Upper bounds of all bins of a feature but the last, and mean and sd of the target.

    Up to 32 different values get a bin each; others are cut at quantiles of all rows.
    """
    of = {f"{kind}{i}": a for i, c in enumerate(columns) for kind, a in (
        ("n", F.approx_count_distinct(c)), ("q", F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 1000)), ("m", F.max(F.abs(c))))}
    seen = one_row(data.agg(
        F.count(F.lit(1)).alias("rows"), F.avg("label").alias("mean"), F.stddev_pop("label").alias("sd"), F.min("weight").alias("least"),
        *[a.alias(k) for k, a in of.items()],
    ))
    if not seen["rows"]:
        raise ValueError("No complete rows to train on")
    if seen["least"] < 0:
        raise ValueError("Weights must not be negative")
    if endless := [i for i in range(len(columns)) if isinf(seen[f"m{i}"])]:
        raise ValueError(f"Infinite values in feature {endless[0]}")
    few = [i for i in range(len(columns)) if seen[f"n{i}"] <= 2 * BINS]
    values = one_row(data.agg(*[F.array_sort(F.collect_set(columns[i])).alias(f"v{i}") for i in few])) if few else {}
    cuts = []
    for i in range(len(columns)):
        own = values[f"v{i}"] if i in few else None
        cuts.append(np.array(own[:-1] if own and len(own) <= BINS else sorted(set(seen[f"q{i}"])), dtype=float))
    return cuts, seen["mean"], seen["sd"]


def _drawn_by_bits() -> np.ndarray:
    """How often a tree draws a row, for each value of 16 random bits: Poisson with mean 1."""
    share = np.cumsum([exp(-1) / factorial(k) for k in range(12)])
    return np.searchsorted(share, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def _bits(rows: np.ndarray, seed: int, four: int) -> np.ndarray:
    """16 random bits per row for each of four trees, from the number of the row alone."""
    start = int(np.random.SeedSequence([seed % 2**63, four]).generate_state(1, np.uint64)[0])
    z = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return z.view(np.uint16).reshape(-1, 4)


def _chunks(batches: Iterable, cuts: Sequence[np.ndarray]) -> Iterator[tuple]:
    """Number, target, weight and bins of many rows at a time; the bins of one feature follow those of another."""

    def joined(some: list) -> tuple:
        rows, y, w, *xs = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in some]) for i in range(3 + len(cuts))]
        return rows, y, w, np.concatenate([np.searchsorted(c, x).astype(np.uint8) for c, x in zip(cuts, xs)])

    some, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            some.append(b.slice(at, ROWS_AT_ONCE))
            n += some[-1].num_rows
            if n >= ROWS_AT_ONCE:
                yield joined(some)
                some, n = [], 0
    if n:
        yield joined(some)


def _walked(bins: np.ndarray, n: int, at: np.ndarray, levels: Sequence[Level], tree: int, value: np.ndarray | None = None) -> np.ndarray:
    """The nodes that the rows ``at`` reach below the given levels; ``value`` takes up the means on the way."""
    node = np.zeros(len(at), np.intp)
    for level in levels:
        here = bins.take((level.feature[tree] * n).take(node) + at) > level.cut[tree].take(node)
        node += node
        node += here
        if value is not None:
            value += level.change[tree].take(node)
        node = level.child[tree].take(node)
    return node


def _groups(tried: Sequence[np.ndarray]) -> list[dict[int, tuple[int, np.ndarray]]]:
    """Nodes whose sums are held at once: per tree the first one and the features that they try."""
    groups, held = [{}], 0
    for t, features in enumerate(tried):
        cell = 16 * BINS * features.shape[1]
        most = max(1, SUMS_BYTES // cell)
        for first in range(0, len(features), most):
            some = features[first : first + most]
            if held + cell * len(some) > SUMS_BYTES and groups[-1]:
                groups, held = [*groups, {}], 0
            groups[-1][t], held = (first, some), held + cell * len(some)
    return [g for g in groups if g]


def _sums(data: DataFrame, cuts: list, levels: list[Level], group: dict, mean: float, sd: float, seed: int) -> DataFrame:
    """Weights and targets per tree, node, feature tried and bin: a row per task and part of a tree's nodes."""

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        drawn = _drawn_by_bits()
        sums = {t: np.zeros((2, f.shape[1], len(f) * BINS)) for t, (_, f) in group.items()}
        for rows, y, w, bins in _chunks(batches, cuts):
            n, bits, four = len(rows), None, None
            y, plain = (y - mean) / sd, bool((w == 1).all())
            for t, (lowest, features) in group.items():
                if four != t // 4:
                    four = t // 4
                    bits = _bits(rows, seed, four)
                times = drawn.take(bits[:, t % 4])
                at = np.flatnonzero(times)
                node = _walked(bins, n, at, levels, t) - lowest
                if not (here := (node >= 0) & (node < len(features))).all():
                    at, node = at[here], node[here]
                weight = times.take(at).astype(float)
                if not plain:
                    weight *= w.take(at)
                target = y.take(at) * weight
                first = node * BINS
                for j in range(features.shape[1]):
                    cell = bins.take((features[:, j] * n).take(node) + at) + first
                    sums[t][0, j] += np.bincount(cell, weight, len(features) * BINS)
                    sums[t][1, j] += np.bincount(cell, target, len(features) * BINS)
        for t, s in sums.items():
            m, k = s.shape[1], s.shape[2] // BINS
            by_node = np.ascontiguousarray(s.reshape(2, m, k, BINS).transpose(2, 1, 3, 0))
            step = max(1, PART_BYTES // (16 * m * BINS))
            firsts = [i for i in range(0, k, step) if by_node[i : i + step, :, :, 0].any()]
            parts = [by_node[i : i + step].tobytes() for i in firsts]
            firsts = [group[t][0] + i for i in firsts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(parts), pa.int32()), pa.array(firsts, pa.int32()), pa.array(parts, pa.binary())],
                names=["tree", "first", "sums"],
            )

    return data.mapInArrow(added, "tree int, first int, sums binary")


def _best(sums: DataFrame, m: int) -> DataFrame:
    """The best split of each node. ``gain`` is the squared error it saves; without any it is 0 and all goes left."""

    def found(table):
        import pyarrow as pa

        both = sum(np.frombuffer(s.as_buffer(), float) for s in table.column("sums")).reshape(-1, m, BINS, 2)
        left = both.cumsum(2)
        total = left[:, :1, -1:, :]
        right = total - left
        square = lambda s: np.divide(s[..., 1] ** 2, s[..., 0], out=np.zeros(s.shape[:-1]), where=s[..., 0] > 0)
        parts = square(left) + square(right)
        gain = parts - square(total)
        # what is left of equal targets is rounding
        gain[(both[..., 0].cumsum(2) <= 0) | (both[..., 0][..., ::-1].cumsum(2)[..., ::-1] - both[..., 0] <= 0) | (gain <= 1e-12 * parts)] = 0
        k = len(gain)
        at = gain.reshape(k, -1).argmax(1)
        place, cut, node = at // BINS, at % BINS, np.arange(k)
        split = gain[node, place, cut] > 0
        cut[~split] = BINS - 1
        l, r = left[node, place, cut], right[node, place, cut]
        r[~split] = 0
        names = ["tree", "node", "place", "cut", "gain", "left", "left_sum", "right", "right_sum"]
        tree, first = table.column("tree")[0].as_py(), table.column("first")[0].as_py()
        whole = [np.full(k, tree), first + node, place, cut]
        real = [gain[node, place, cut], l[:, 0], l[:, 1], r[:, 0], r[:, 1]]
        return pa.Table.from_arrays([*[pa.array(v, pa.int32()) for v in whole], *[pa.array(v, pa.float64()) for v in real]], names=names)

    schema = "tree int, node int, place int, cut int, gain double, left double, left_sum double, right double, right_sum double"
    return sums.groupBy("tree", "first").applyInArrow(found, schema)


def _grow(data: DataFrame, cuts: list, mean: float, sd: float, trees: int, depth: int, seed: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """The levels of all trees, the mean of each tree's root, and what each feature saves in each tree."""
    p = len(cuts)
    m = max(1, ceil(p / 3)) if trees > 1 else p
    nodes, levels, saved, roots = [1] * trees, [], np.zeros((trees, p)), np.zeros(trees)
    for depth_now in range(depth):
        rng = np.random.default_rng([seed % 2**63, trees, depth_now])
        tried = [rng.random((k, p)).argsort(1)[:, :m] for k in nodes]
        level = Level(
            feature=[np.zeros(k + 1, np.intp) for k in nodes], cut=[np.full(k + 1, BINS, np.uint8) for k in nodes],
            child=[], change=[np.zeros(2 * k + 2) for k in nodes],
        )
        goes = [np.zeros(2 * k + 2, bool) for k in nodes]
        for group in _groups(tried):
            table = _best(_sums(data, cuts, levels, group, mean, sd, seed), m).toArrow()
            tree, node, place, cut, gain, lw, ls, rw, rs = [c.to_numpy() for c in table.columns]
            for t in group:
                own = np.flatnonzero(tree == t)
                if not depth_now and (lw[own] + rw[own]).any():
                    roots[t] = (ls[own] + rs[own])[0] / (lw[own] + rw[own])[0]
                own = own[gain[own] > 0]
                k, f = node[own], tried[t][node[own], place[own]]
                level.feature[t][k], level.cut[t][k] = f, cut[own]
                average = (ls[own] + rs[own]) / (lw[own] + rw[own])
                level.change[t][2 * k], level.change[t][2 * k + 1] = ls[own] / lw[own] - average, rs[own] / rw[own] - average
                goes[t][2 * k] = goes[t][2 * k + 1] = depth_now + 1 < depth
                np.add.at(saved[t], f, gain[own])
        nodes = [int(g.sum()) for g in goes]
        level.child.extend(np.where(g, g.cumsum() - 1, k) for g, k in zip(goes, nodes))
        levels.append(level)
        if not any(nodes):
            break
    return levels, roots, saved


def _predicted(data: DataFrame, cuts: list, levels: list[Level], roots: np.ndarray, mean: float, sd: float) -> DataFrame:
    def predicted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows, y, _, bins in _chunks(batches, cuts):
            n = len(rows)
            at, value = np.arange(n), np.full(n, roots.sum())
            for t in range(len(roots)):
                _walked(bins, n, at, levels, t, value)
            yield pa.RecordBatch.from_arrays([pa.array(value / len(roots) * sd + mean), pa.array(y)], names=["prediction", "label"])

    return data.mapInArrow(predicted, "prediction double, label double")


def forest_importance(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    num_trees: int = 100,
    max_depth: int = 10,
    top_n: int | None = None,
    seed: int = 42,
    weight: str | None = None,
) -> DataFrame:
    """Ranked importances with ``corr(prediction, label)²`` on the training rows.

    Rows without target or with a missing feature are left out. A tree draws as many rows as there are,
    with replacement; a node tries a third of the features, each at up to 31 cuts, and keeps the split
    that saves most squared error. A feature's importance is what its splits save, as a share of its
    tree, averaged over the trees. Draws follow from ``seed`` and from the order the rows are written in.
    The accuracy is one lazy aggregate over the predictions, computed only when the result is used.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("None of the feature columns are present")
    if other := [c for c in present if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]:
        raise ValueError(f"Features must be numbers: {', '.join(other)}")
    used = [*present, target, *([weight] if weight else [])]
    names = [f"x{i}" for i in range(len(present))]
    rows = complete_rows(df, used).select(
        F.col(target).cast("double").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        *[F.col(c).cast("double").alias(x) for c, x in zip(present, names)],
    )
    # dealt evenly once, in a multiple of the cores, since every level passes over all rows
    session = df.sparkSession
    cores, least = session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(cores * ceil(least / cores))
    data = settle(dealt.select(F.monotonically_increasing_id().alias("row"), "*"))
    cuts, mean, sd = _cuts(data, names)
    sd = sd if sd and not isnan(sd) else 1.0
    levels, roots, saved = _grow(data, cuts, mean, sd, num_trees, max_depth, seed)
    shares = np.divide(saved, saved.sum(1, keepdims=True), out=np.zeros_like(saved), where=saved.sum(1, keepdims=True) > 0).sum(0)
    pairs = list(zip(present, (shares / (shares.sum() or 1.0)).tolist()))
    accuracy = _predicted(data, cuts, levels, roots, mean, sd).agg(F.pow(F.corr("prediction", "label"), 2).alias("model_accuracy"))
    result = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(v).alias("importance")) for c, v in pairs]))
    return rank_importance(accuracy.select("model_accuracy", result).select("feature", "importance", "model_accuracy"), top_n)
