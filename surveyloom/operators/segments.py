"""K-means segmentation: features, clusters named by rank, profiles of the centres."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from surveyloom.functions.columns import map_labels
from surveyloom.operators.checks import complete_rows, require_columns
from surveyloom.operators.lookup import one_row
from surveyloom.operators.prep import reverse_item

FEATURES = "features"
#: Starts that are scored, different rows that they are drawn from at most, and the move that ends the passes.
STARTS, START_ROWS, SETTLED = 4, 2000, 1e-4
# Names of segments in order of engagement.
NAMES_BY_COUNT = {
    2: ("Proactive Learners", "Disengaged Learners"),
    3: ("Proactive Learners", "Average Learners", "Disengaged Learners"),
}


@dataclass(frozen=True)
class Segmentation:
    """Assigned rows plus the fitted centres, which are one short vector per cluster."""

    rows: DataFrame
    centres: tuple[tuple[float, ...], ...]
    columns: tuple[str, ...]
    cost: float
    labels: dict[int, str]
    cluster: str = "cluster"

    def drop_vectors(self) -> DataFrame:
        vectors = [f.name for f in self.rows.schema.fields if f.dataType.typeName() == "vectorudt"]
        return self.rows.drop(FEATURES, *vectors)

    def centre_table(self) -> DataFrame:
        """``(cluster, label, dimension, centre)`` rows."""
        rows = [
            (i, self.labels.get(i), c, float(v))
            for i, centre in enumerate(self.centres)
            for c, v in zip(self.columns, centre)
        ]
        spark = self.rows.sparkSession
        return spark.createDataFrame(rows, "cluster int, label string, dimension string, centre double")

    def summary(self) -> DataFrame:
        """One row per cluster: label, leading dimension, size, and the model's cost."""
        text = dominant_dimension(self.centres, self.columns)
        lead = {i: t for i, t in enumerate(text)}
        sizes = self.rows.groupBy(self.cluster).agg(F.count(F.lit(1)).alias("size"))
        return sizes.select(
            self.cluster,
            map_labels(self.cluster, self.labels).alias("label"),
            map_labels(self.cluster, lead).alias("characteristics"),
            "size",
            F.lit(self.cost).alias("inertia"),
        )


def rank_labels(centres: Sequence[Sequence[float]]) -> dict[int, str]:
    """Name clusters by the sum of their centre, highest first."""
    order = sorted(range(len(centres)), key=lambda i: -sum(centres[i]))
    names = NAMES_BY_COUNT.get(len(centres))
    if names:
        return {cluster: names[place] for place, cluster in enumerate(order)}
    return {cluster: f"Cluster {cluster} (Engagement Rank {place + 1})" for place, cluster in enumerate(order)}


def dominant_dimension(centres: Sequence[Sequence[float]], columns: Sequence[str]) -> list[str]:
    """The dimension furthest from average in each centre."""
    out = []
    for centre in centres:
        at = max(range(len(columns)), key=lambda i: abs(centre[i]))
        out.append(f"{'High' if centre[at] > 0 else 'Low'} in {columns[at]}")
    return out


@contextmanager
def held_for_training(df: DataFrame) -> Iterator[DataFrame]:
    """Spread narrow training rows evenly and hold them, spilling to disk, while a model iterates.

    The one shuffle is small next to the passes it speeds up: without it, uneven or few input
    partitions would be repeated in every pass.
    """
    held = df.hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def standard_features(df: DataFrame, columns: Sequence[str], output: str = FEATURES) -> DataFrame:
    """Assemble the columns and scale them to mean 0 and sample sd 1."""
    require_columns(df, columns)
    raw = VectorAssembler(inputCols=list(columns), outputCol="__raw").transform(complete_rows(df, columns))
    scaler = StandardScaler(inputCol="__raw", outputCol=output, withMean=True, withStd=True)
    return scaler.fit(raw).transform(raw).drop("__raw")


def attitude_features(df: DataFrame, columns: Sequence[str], reverse: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Reverse the listed items, then scale. Returns the frame and the names of its features."""
    require_columns(df, [*columns, *reverse])
    data = complete_rows(df, columns)
    names = []
    for c in columns:
        if c in reverse:
            data = reverse_item(data, c)
        names.append(f"{c}_reversed" if c in reverse else c)
    return standard_features(data, names), names


def _with_nearest(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], number: str, distance: str) -> DataFrame:
    """Add the number of the nearest centre and the squared distance to it; ties go to the first one.

    Plain columns, one step after the other, so that passes over them are compiled and work out nothing twice.
    """
    beside = lambda c, v: F.col(c) - F.lit(float(v))
    away = {f"__d{i}": sum((beside(c, v) * beside(c, v) for c, v in zip(columns, centre)), F.lit(0.0)) for i, centre in enumerate(centres)}
    least = F.least(*away) if len(away) > 1 else F.col("__d0")
    first = F.lit(len(centres) - 1)
    for i in reversed(range(len(centres) - 1)):
        first = F.when(F.col(f"__d{i}") == F.col(distance), F.lit(i)).otherwise(first)
    return df.withColumns(away).withColumn(distance, least).withColumn(number, first).drop(*away)


def _rounded(values: Iterable[float]) -> tuple[float, ...]:
    return tuple(round(float(v), 9) + 0.0 for v in values)


def _start(points: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[float, ...]]:
    """Centres among the points, each far from the earlier ones, moved a few times."""
    chosen = [points[rng.integers(len(points))]]
    while len(chosen) < k:
        away = np.min([((points - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        if not away.sum() > 0:
            break
        chosen.append(points[np.searchsorted(np.cumsum(away), rng.random() * away.sum())])
    centres = np.array(chosen)
    for _ in range(20):
        own = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
    return [_rounded(c) for c in centres]


def _best_start(held: DataFrame, k: int, width: int, seed: int) -> list[tuple[float, ...]]:
    """Of several starts the one with the least cost over all rows."""
    # without the digits that depend on how sums were split
    held_x = held.select(F.array(*[F.round(x, 6) + 0.0 for x in _places(width)]).alias("x"))
    drawn = F.xxhash64("x")
    n = one_row(held.agg(F.count(F.lit(1)).alias("n")))["n"]
    # different rows only; a part by hash first, so that not all of them have to be told apart
    for part in (max(1, n // (8 * START_ROWS)), 1):
        some = held_x.filter(F.pmod(drawn, F.lit(part)) == 0).distinct()
        points = [r["x"] for r in some.orderBy(drawn, "x").limit(START_ROWS).collect()]
        if part == 1 or len(points) >= START_ROWS // 2:
            break
    if not points:
        raise ValueError("No row has all columns")
    points = np.array(points, float).reshape(-1, width)
    starts = [_start(points, k, np.random.default_rng([seed, i])) for i in range(STARTS)]
    costs = [_cost(held, c) for c in starts]
    return starts[min(range(STARTS), key=lambda i: (round(costs[i], 6), i))]


def _places(width: int) -> list[str]:
    """Names of the columns that hold the features of a row, one number each."""
    return [f"x{i}" for i in range(width)]


def _cost(held: DataFrame, centres: Sequence[Sequence[float]]) -> float:
    """The weighted sum of squared distances to the nearest centre."""
    near = _with_nearest(held, _places(len(centres[0])), centres, "number", "distance")
    return float(one_row(near.agg(F.sum(F.col("w") * F.col("distance"))))[0])


def _centres_of_members(held: DataFrame, centres: Sequence[Sequence[float]]) -> list[tuple[float, ...]]:
    """The weighted means of the rows nearest to each centre; a centre without rows stays."""
    own = _with_nearest(held, _places(len(centres[0])), centres, "number", "distance")
    sums = [F.sum(F.col("w") * F.col(x)).alias(f"s{i}") for i, x in enumerate(_places(len(centres[0])))]
    means = {r["number"]: r for r in own.groupBy("number").agg(F.sum("w").alias("w"), *sums).collect()}
    return [
        _rounded(means[i][f"s{j}"] / means[i]["w"] for j in range(len(c))) if i in means and means[i]["w"] > 0 else tuple(c)
        for i, c in enumerate(centres)
    ]


def assign_to_centres(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], cluster: str = "cluster") -> DataFrame:
    """Rows that have every column, with the number of the nearest of given centres and the squared distance to it."""
    require_columns(df, columns)
    own = [f"__{x}" for x in _places(len(columns))]
    rows = complete_rows(df, columns).withColumns({x: F.col(c).cast("double") for x, c in zip(own, columns)})
    near = _with_nearest(rows, own, centres, "__number", "__distance")
    return near.select(*df.columns, F.col("__number").alias(cluster), F.col("__distance").alias("distance"))


def kmeans_segments(
    df: DataFrame,
    columns: Sequence[str],
    k: int = 3,
    max_iter: int = 20,
    seed: int = 42,
    weight: str | None = None,
    cluster: str = "cluster",
    scale: bool = True,
    reverse: Sequence[str] = (),
) -> Segmentation:
    """Cluster rows that have every column.

    The same rows give the same clusters however they are split: starts are drawn from rows with
    the smallest hashes of their features, all starts are scored by their cost over all rows, and
    centres are rounded to nine digits in each pass. Clusters are numbered by the sum of their
    centre, highest first. Fewer different rows than ``k`` give as many clusters. The features are
    held on the executors only while passes go over them; the driver holds centres and the rows
    that starts are drawn from (at most ``START_ROWS``).
    """
    if scale:
        data, names = attitude_features(df, columns, reverse)
    else:
        require_columns(df, columns)
        names = list(columns)
        data = VectorAssembler(inputCols=names, outputCol=FEATURES).transform(complete_rows(df, names))
    if weight:
        data = complete_rows(data, [weight])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # numbers in columns of their own, which passes read faster than arrays
    wide = data.withColumn("__x", vector_to_array(FEATURES))
    narrow = wide.select(*[F.get("__x", i).alias(x) for i, x in enumerate(_places(len(names)))], w.alias("w"))
    with held_for_training(narrow) as held:
        centres = _best_start(held, k, len(names), seed)
        for _ in range(max_iter):
            moved = _centres_of_members(held, centres)
            step = max((a - b) ** 2 for c, d in zip(centres, moved) for a, b in zip(c, d))
            centres = moved
            if step <= SETTLED**2:
                break
        centres = sorted(centres, key=lambda c: (-sum(c), c))
        cost = _cost(held, centres)
    own = [f"__{x}" for x in _places(len(names))]
    rows = wide.withColumns({x: F.get("__x", i) for i, x in enumerate(own)})
    rows = _with_nearest(rows, own, centres, "__number", "__distance").select(*data.columns, F.col("__number").alias(cluster))
    return Segmentation(rows, tuple(centres), tuple(names), cost, rank_labels(centres), cluster)


def attitude_segments(
    df: DataFrame, columns: Sequence[str], reverse: Sequence[str] = (), k: int = 3, label: str = "segment", **options
) -> Segmentation:
    """Segments with their engagement label on every row."""
    s = kmeans_segments(df, columns, k=k, reverse=reverse, **options)
    return Segmentation(
        s.rows.withColumn(label, map_labels(s.cluster, s.labels)), s.centres, s.columns, s.cost, s.labels, s.cluster
    )


def dimension_clusters(
    df: DataFrame, dimensions: Sequence[str], k: int = 4, max_iter: int = 100, seed: int = 42, **options
) -> Segmentation:
    """Clusters of rows in dimension space, named ``cluster_0`` to ``cluster_{k-1}``."""
    s = kmeans_segments(df, dimensions, k=k, max_iter=max_iter, seed=seed, **options)
    names = {i: f"cluster_{i}" for i in range(len(s.centres))}
    rows = s.rows.withColumn("cluster_name", map_labels(s.cluster, names))
    return Segmentation(rows, s.centres, s.columns, s.cost, names, s.cluster)


def silhouette(segmentation: Segmentation, weight: str | None = None) -> DataFrame:
    """Mean silhouette with squared distances, from per-cluster sums and not from pairs."""
    evaluator = ClusteringEvaluator(featuresCol=FEATURES, predictionCol=segmentation.cluster)
    value = (evaluator.setWeightCol(weight) if weight else evaluator).evaluate(segmentation.rows)
    k = len(segmentation.centres)
    return segmentation.rows.sparkSession.createDataFrame([(k, float(value))], "k int, silhouette double")
