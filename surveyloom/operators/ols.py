"""Weighted least squares from one aggregate.

The normal equations need only sums of products. Those are ordinary aggregates, so one
``groupBy`` fits every stratum at once, with map-side combining and without moving rows;
the solve then runs on one small row per stratum inside Arrow batches. Fixed effects are
absorbed by aggregating per group first and adding up the within-group products, which
equals a regression with one dummy per group. Where there are too many products for an aggregate
of columns, tasks add up whole matrices instead; what is solved is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from surveyloom.functions.tails import student_t_two_sided
from surveyloom.operators.checks import complete_rows, require_columns
from surveyloom.operators.lookup import attach_aggregate, one_row, settle
from surveyloom.operators.grouped import demean

INTERCEPT = "intercept"
#: Beyond this many products they are added up as matrices in tasks, not as columns of an aggregate.
PRODUCTS_AS_COLUMNS = 400
#: Bytes of matrices that a task holds before it hands them on, and the parts in which they are added up first.
HELD_BYTES, PARTS = 64 * 1024 * 1024, 32
# Columns are centred before anything is summed. What is left of a constant column is rounding,
# relative to its mean and to what a stratum's own mean leaves of the sums.
ROUNDING, USABLE_VARIATION = 1e-13, 1e-13
COLLINEAR = 1e-11

_TERM = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()),
        T.StructField("t_value", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
    ]
)
_FIT = [
    T.StructField("model", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("sum_weight", T.DoubleType()),
    T.StructField("groups", T.LongType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("adjusted_r2", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("terms", T.ArrayType(_TERM)),
]


def _list(by: Sequence[str] | str | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _sums(data: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Count, weight, weighted sums and sums of products of ``v0 .. v{k-1}`` per key."""
    aggs = ["count(1) AS n", "sum(w) AS sw", *[f"sum(w * v{i}) AS s{i}" for i in range(k)]]
    aggs += [f"sum(w * v{i} * v{j}) AS p{i}_{j}" for i, j in _pairs(k)]
    return data.groupBy(*keys).agg(*map(F.expr, aggs))


def _centred(i: int, j: int) -> str:
    return f"p{i}_{j} - s{i} * s{j} / sw"


def _means(data: DataFrame, k: int) -> list[float]:
    """The mean of each place of the arrays ``v`` that are complete; 0 without rows."""

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, total = 0, np.zeros(k)
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rows = rows[~np.isnan(rows).any(axis=1)]
            n += len(rows)
            total += rows.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total), pa.array([n] * k)], names=["at", "s", "n"])

    sums = data.select("v").mapInArrow(summed, "at int, s double, n long").groupBy("at").agg((F.sum("s") / F.sum("n")).alias("m"))
    means = {r["at"]: r["m"] for r in sums.where("m IS NOT NULL").collect()}
    return [means.get(i, 0.0) for i in range(k)]


def _matrix_sums(
    df: DataFrame, columns: list[str], weight: str | None, keys: list[str], absorb: str | None, min_rows: int
) -> tuple[DataFrame, list[float]]:
    """Per stratum ``n``, ``sw``, ``groups``, ``sums``, ``squares``, centred ``products`` and ``total``, and the means taken off.

    A task adds up one matrix per stratum that it meets and hands them on when they fill its
    bound; they are then added up in parts, and the parts per stratum, so that no task gets the
    matrices of all others. Columns of absorbed groups lose the means of their group first. The
    columns travel as one array, since hundreds of expressions take the optimizer longer than the rows.
    """
    k = len(columns)
    require_columns(df, columns)
    others = [*([weight] if weight else []), *keys, *([absorb] if absorb else [])]
    own, group = [f"k{i}" for i in range(len(keys))], "g" if absorb else None
    rows = complete_rows(df, others) if others else df
    rows = rows.select(
        *[F.col(c).alias(o) for c, o in zip(keys, own)],
        *([F.col(absorb).alias("g")] if absorb else []),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("v"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    # tasks leave out incomplete arrays as they read them; a filter would work out every column once more
    shift = _means(rows, k)
    data, counts = rows, None
    if group:
        data = rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
        means = rows.groupBy(*own, group).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(F.col("w") * (F.get("v", i) - F.lit(m))) / F.sum("w") for i, m in enumerate(shift)]).alias("m"),
        )
        means = settle(means.where(F.col("n") >= int(min_rows)).drop("n"))
        data = attach_aggregate(data, means, [*own, group], how="inner").drop(group)
        counts = means.groupBy(*own).agg(F.count(F.lit(1)).alias("groups"))
    named = own or ["k0"]
    if not own:
        data = data.withColumn("k0", F.lit(0))
    kinds = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in named)
    centred = group is not None

    def multiplied(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, types = TaskContext.get().partitionId() % PARTS, {}, None

        def handed_on():
            cols = list(zip(*held))
            sums = list(zip(*held.values()))
            made = [pa.array(c, t) for c, t in zip(cols, types)]
            made += [pa.array([part] * len(held), pa.int32()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.float64())]
            made += [pa.array([x.tobytes() for x in s], pa.binary()) for s in sums[2:]]
            return pa.RecordBatch.from_arrays(made, names=[*named, "part", "n", "sw", "s", "q", "g"])

        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            whole = ~np.isnan(at["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)).any(axis=1)
            if not whole.all():
                at = {c: x.filter(pa.array(whole)) for c, x in at.items()}
            types = [at[c].type for c in named]
            raw = at["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - np.array(shift)
            w = at["w"].to_numpy(zero_copy_only=False)
            inside = raw - at["m"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if centred else raw
            keys = list(zip(*[at[c].to_pylist() for c in named]))
            number: dict = {}
            code = np.array([number.setdefault(x, len(number)) for x in keys], np.int64)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(number) + 1))
            for key, i in number.items():
                mine = order[cuts[i] : cuts[i + 1]]
                x, v, u = inside[mine], raw[mine], w[mine]
                own_sums = (len(mine), float(u.sum()), u @ v, u @ (v * v), (x * u[:, None]).T @ x)
                old = held.get(key)
                held[key] = own_sums if old is None else tuple(a + b for a, b in zip(old, own_sums))
            if len(held) * 8 * k * (k + 2) > HELD_BYTES:
                yield handed_on()
                held = {}
        if held:
            yield handed_on()

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        out = parts.iloc[:1].copy()
        out["n"], out["sw"] = parts["n"].sum(), parts["sw"].sum()
        for c in ("s", "q", "g"):
            out[c] = [sum(np.frombuffer(x) for x in parts[c]).tobytes()]
        return out

    def finished(parts: pd.DataFrame) -> pd.DataFrame:
        out = added(parts)
        s, q, g = (np.frombuffer(out[c].iloc[0]) for c in ("s", "q", "g"))
        sw = out["sw"].iloc[0]
        products = g if centred else (g.reshape(k, k) - np.outer(s, s) / sw).ravel()
        out = out[[*named, "n", "sw"]]
        out["sums"], out["squares"], out["products"] = [s.tolist()], [q.tolist()], [products.tolist()]
        out["total"] = q[k - 1] - s[k - 1] * s[k - 1] / sw
        return out

    blocks = f"{kinds}, part int, n long, sw double, s binary, q binary, g binary"
    some = data.mapInArrow(multiplied, blocks).groupBy(*named, "part").applyInPandas(added, blocks)
    arrays = "sums array<double>, squares array<double>, products array<double>, total double"
    table = some.groupBy(*named).applyInPandas(finished, f"{kinds}, n long, sw double, {arrays}")
    if not own:
        # without any row there is still one fit, which says so
        one = df.sparkSession.range(1).select(F.lit(0).alias("k0"))
        table = one.join(table, "k0", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    if counts is None:
        table = table.withColumn("groups", F.lit(1).cast("long"))
    elif own:
        table = attach_aggregate(table, counts, own, how="inner")
    else:
        table = table.withColumn("groups", F.lit(one_row(counts)["groups"]).cast("long"))
    named = [F.col(o).alias(c) for o, c in zip(own, keys)]
    return table.select(*named, "n", "sw", "groups", "sums", "squares", "products", "total"), shift


def fit_ols(
    df: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    weight: str | None = None,
    by: Sequence[str] | str | None = None,
    absorb: str | None = None,
    min_rows: int = 0,
    model: str = "ols",
) -> DataFrame:
    """One row per stratum: fit statistics and an array of terms.

    Rows without outcome, predictor, weight, stratum or absorbed group are left out.
    ``absorb`` adds a fixed effect per group, dropping groups with fewer than ``min_rows``
    rows. One column-pruned pass first takes the means, which are subtracted before products
    are summed, so a mean that is huge next to the spread costs no digits. A predictor that is
    constant in a stratum gets no estimate and is named in ``status``. A stratum that cannot be
    fitted yields a row with the reason, never a failed job. Weights count as precision weights.
    """
    xs, keys = list(predictors), _list(by)
    if not xs:
        raise ValueError("No predictors given")
    if len(_pairs(len(xs) + 1)) > PRODUCTS_AS_COLUMNS:
        table, shift = _matrix_sums(df, [*xs, outcome], weight, keys, absorb, min_rows)
        return _solved(table, keys, xs, shift, absorb is not None, model)
    used = [outcome, *xs, *([weight] if weight else []), *keys, *([absorb] if absorb else [])]
    data = complete_rows(df, used).select(*dict.fromkeys(used))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    raw = [F.col(c).cast("double") for c in [*xs, outcome]]
    k, y = len(raw), len(xs)
    r = one_row(data.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(raw)]))
    shift = [m if m is not None else 0.0 for m in r]
    values = [(v - F.lit(m) if m else v).alias(f"v{i}") for i, (v, m) in enumerate(zip(raw, shift))]
    # own names for every column, so that they can be put together as SQL text
    groups = [F.col(c).alias(f"k{i}") for i, c in enumerate([*keys, *([absorb] if absorb else [])])]
    own = [f"k{i}" for i in range(len(keys))]
    rows = data.select(*groups, *values, w.alias("w"))

    if absorb:
        per_group = _sums(rows, [f"k{i}" for i in range(len(groups))], k).where(f"n >= {int(min_rows)}")
        aggs = ["sum(n) AS n", "sum(sw) AS sw", "count(1) AS groups"]
        aggs += [f"sum(s{i}) AS s{i}" for i in range(k)] + [f"sum(p{i}_{i}) AS p{i}_{i}" for i in range(k)]
        aggs += [f"sum({_centred(i, j)}) AS c{i}_{j}" for i, j in _pairs(k)]
        table = per_group.groupBy(*own).agg(*map(F.expr, aggs))
    else:
        table = _sums(rows, own, k)
        table = table.selectExpr("*", "1L AS groups", *[f"{_centred(i, j)} AS c{i}_{j}" for i, j in _pairs(k)])
    table = table.select(
        *[F.col(o).alias(c) for o, c in zip(own, keys)],
        *map(
            F.expr,
            [
                "n",
                "sw",
                "groups",
                f"array({', '.join(f's{i}' for i in range(k))}) AS sums",
                f"array({', '.join(f'p{i}_{i}' for i in range(k))}) AS squares",
                f"array({', '.join(f'c{min(i, j)}_{max(i, j)}' for i in range(k) for j in range(k))}) AS products",
                f"{_centred(y, y)} AS total",
            ],
        ),
    )
    return _solved(table, keys, xs, shift, absorb is not None, model)


def _solved(
    table: DataFrame, keys: list[str], xs: list[str], shift: list[float], absorbed: bool, model: str
) -> DataFrame:
    """One row per stratum from its sums."""
    schema = T.StructType([table.schema[c] for c in keys] + _FIT)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [
                {"model": model, **_solve(r, xs, shift, absorbed)} for r in batch.to_dict("records")
            ]
            out = batch[keys].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(fits, columns=[f.name for f in _FIT])], axis=1)

    return table.mapInPandas(solve, schema)


def _solve(r: Mapping, names: Sequence[str], shift: Sequence[float], absorbed: bool) -> dict:
    """Solve one stratum's normal equations from its centred products."""
    p, n = len(names), int(r["n"] or 0)
    fit = {"n": n, "sum_weight": r["sw"], "groups": int(r["groups"] or 0)}
    fit |= {"r2": None, "adjusted_r2": None, "rmse": None, "status": "ok"}
    blank = {"std_error": None, "t_value": None, "p_value": None}
    fit["terms"] = [{"term": t, "estimate": None, **blank} for t in names]
    if not absorbed:
        fit["terms"].append({"term": INTERCEPT, "estimate": None, **blank})
    taken = fit["groups"] - 1 if absorbed else 0
    if n == 0 or n <= p + 1 + taken or not r["sw"] > 0:
        return fit | {"status": "too few rows"}

    products = np.asarray(r["products"], float).reshape(p + 1, p + 1)
    squares = np.asarray(r["squares"], float)
    spread = np.diag(products)[:p]
    # the means of a stratum before the shift say how much of a spread can be rounding
    level = np.abs(np.asarray(r["sums"], float) / r["sw"]) + np.abs(np.asarray(shift))
    rounding = np.maximum(USABLE_VARIATION * squares, (ROUNDING * level) ** 2 * r["sw"])
    keep = np.flatnonzero(spread > rounding[:p])
    if len(keep) < p:
        kept = set(keep.tolist())
        lost = [names[i] for i in range(p) if i not in kept]
        fit["status"] = f"no usable variation: {', '.join(lost)}"
    total, sst = products[p, p], float(r["total"])
    scale = np.sqrt(spread[keep])
    gram = products[np.ix_(keep, keep)] / np.outer(scale, scale)
    # digits that a stratum's own mean took from the sums are missing in the eigenvalues too
    doubt = max(COLLINEAR, 1e-15 * float((squares[keep] / spread[keep]).max())) if len(keep) else 0.0
    if len(keep) and np.linalg.eigvalsh(gram)[0] < doubt:
        return fit | {"status": "collinear predictors"}
    inverse = np.linalg.inv(gram) / np.outer(scale, scale) if len(keep) else np.zeros((0, 0))
    cross = products[keep, p]
    beta = np.linalg.solve(gram, cross / scale) / scale if len(keep) else np.zeros(0)
    sse = max(0.0, float(total - beta @ cross))
    used = len(keep) + taken
    dof = n - used - 1
    fit["rmse"] = math.sqrt(sse / r["sw"])
    if sst > rounding[p]:
        fit["r2"] = 1.0 - sse / sst
        fit["adjusted_r2"] = 1.0 - (1.0 - fit["r2"]) * (n - 1) / dof if dof > 0 else fit["r2"]
    noise = sse / dof if dof > 0 else math.nan

    def term(name: str, value: float, variance: float) -> dict:
        se = math.sqrt(variance) if variance >= 0 else None
        t = value / se if se else None
        tail = student_t_two_sided(t, dof) if t is not None else None
        return {"term": name, "estimate": float(value), "std_error": se, "t_value": t, "p_value": tail}

    for at, i in enumerate(keep):
        fit["terms"][i] = term(names[i], beta[at], noise * inverse[at, at])
    if not absorbed:
        means = np.asarray(r["sums"], float) / r["sw"]
        origin = means[keep] + np.asarray(shift)[keep]
        value = means[p] + shift[p] - float(beta @ origin)
        fit["terms"][-1] = term(INTERCEPT, value, noise * (1.0 / r["sw"] + float(origin @ inverse @ origin)))
    return fit


def coefficients(fits: DataFrame) -> DataFrame:
    """One row per term."""
    keys = [c for c in fits.columns if c not in {f.name for f in _FIT}]
    return fits.select(*keys, "model", F.inline("terms"))


def fit_summary(fits: DataFrame) -> DataFrame:
    """One row per fit, without the terms."""
    return fits.drop("terms")


def term_value(term: str, part: str = "estimate") -> Column:
    """A term of a fit row as a column."""
    return F.element_at(F.filter("terms", lambda t: t["term"] == term), 1)[part]


def with_residuals(
    df: DataFrame,
    fit: Row,
    outcome: str,
    predictors: Sequence[str],
    weight: str | None = None,
    absorb: str | None = None,
) -> DataFrame:
    """Add ``fitted`` and ``residual`` for one fitted model, over all of its rows."""
    beta = {t["term"]: t["estimate"] for t in fit["terms"] if t["estimate"] is not None}
    used = [outcome, *predictors, *([weight] if weight else []), *([absorb] if absorb else [])]
    data = complete_rows(df, used)
    xs = [x for x in predictors if x in beta]
    if absorb:
        within = demean(data, [outcome, *xs], absorb, "__w", weight)
        residual = F.col(f"{outcome}__w")
        for x in xs:
            residual = residual - F.lit(beta[x]) * F.col(f"{x}__w")
        fitted = F.col(outcome) - residual
        return within.select(*df.columns, fitted.alias("fitted"), residual.alias("residual"))
    fitted = F.lit(beta.get(INTERCEPT, 0.0))
    for x in xs:
        fitted = fitted + F.lit(beta[x]) * F.col(x)
    return data.withColumn("fitted", fitted).withColumn("residual", F.col(outcome) - F.col("fitted"))


def add_residuals(
    df: DataFrame,
    fits: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    weight: str | None = None,
    by: Sequence[str] | str | None = None,
    absorb: str | None = None,
) -> DataFrame:
    """Add ``fitted`` and ``residual`` from a table of fits, one per stratum, over the rows that were fitted.

    Coefficients are a lookup table joined on the stratum, so any number of strata goes and
    nothing of them reaches the driver. Rows that ``fit_ols`` leaves out, and those of strata
    without a fit, are left out here too; a predictor without an estimate adds nothing.
    """
    keys, xs = _list(by), list(predictors)
    clash = {"fitted", "residual"} & set(df.columns)
    if clash:
        raise ValueError(f"Columns exist: {', '.join(sorted(clash))}")
    used = [outcome, *xs, *([weight] if weight else []), *keys, *([absorb] if absorb else [])]
    data = complete_rows(df, used)
    if absorb:
        data = demean(data, [outcome, *xs], [*keys, absorb], "__w", weight)
    # without strata all rows have the same key
    on = keys or ["__all"]
    extra = [] if keys else [F.lit(0).alias("__all")]
    # absorbed groups stand in for the intercept
    terms = xs if absorb else [*xs, INTERCEPT]
    betas = fits.where("rmse IS NOT NULL").select(
        *keys, *extra, *[F.coalesce(term_value(x), F.lit(0.0)).alias(f"__b{i}") for i, x in enumerate(terms)]
    )
    rows = attach_aggregate(data.select("*", *extra), betas, on, how="inner")
    part = lambda c: F.col(f"{c}__w" if absorb else c)
    said = F.lit(0.0) if absorb else F.col(f"__b{len(xs)}")
    for i, x in enumerate(xs):
        said = said + F.col(f"__b{i}") * part(x)
    residual = part(outcome) - said
    return rows.select(*df.columns, (F.col(outcome) - residual).alias("fitted"), residual.alias("residual"))
