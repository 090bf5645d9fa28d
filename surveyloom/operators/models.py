"""Regression designs: comparison, importance, interaction, strata, slopes, residuals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from surveyloom.functions.columns import band
from surveyloom.functions.tails import chi2_tail
from surveyloom.operators.checks import complete_rows, require_columns
from surveyloom.operators.grouped import cell_means, demean, repeatable_sample, top_groups
from surveyloom.operators.lookup import attach, attach_aggregate, one_row, settle
from surveyloom.operators.normalize import composite_score, zscore
from surveyloom.operators.ols import add_residuals, fit_ols, term_value
from surveyloom.operators.prep import add_strata
from surveyloom.operators.quantiles import quantile_values

# Labels of strata and grid groups, and the interaction's reading.
INDEX_STRATA = ("low_index", "medium_index", "high_index")
ATTITUDE_STRATA = ("negative_attitude", "neutral_attitude", "positive_attitude")
STRATUM_PROBS = (0.33, 0.67)
INDEX_GROUPS = ("Low Index", "Medium Index", "High Index")
ATTITUDE_GROUPS = ("Negative", "Neutral", "Positive")
EFFECT_LEVELS = (("low", 0.25), ("medium", 0.5), ("high", 0.75))
READING_LIMIT = 0.1

BASELINE, CONTROL, FIXED = "Baseline", "With Control", "With Fixed Effects"


# -- index models ---------------------------------------------------------------------


def baseline_model(df: DataFrame, score: str, index: str, weight: str, **options) -> DataFrame:
    return fit_ols(df, score, [index], weight, model=BASELINE, **options)


def control_model(df: DataFrame, score: str, index: str, control: str, weight: str, **options) -> DataFrame:
    return fit_ols(df, score, [index, control], weight, model=CONTROL, **options)


def fixed_effects_model(
    df: DataFrame, score: str, index: str, control: str, group: str, weight: str, min_rows: int = 0, **options
) -> DataFrame:
    return fit_ols(df, score, [index, control], weight, absorb=group, min_rows=min_rows, model=FIXED, **options)


def compare_models(fits: Sequence[DataFrame], term: str) -> DataFrame:
    """Fit statistics and one shared coefficient per model; the best R² is marked."""
    rows = reduce(DataFrame.unionByName, fits).select(
        "model", "r2", "rmse", term_value(term).alias("coefficient"), term_value(term, "p_value").alias("p_value"), "n"
    )
    # a handful of models, one row each
    best = F.max_by("model", "r2").over(Window.partitionBy())
    return rows.withColumn("is_best", F.col("model") == best)


def residual_sample(residuals: DataFrame, keys: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """A repeatable sample of residuals for a scatter plot."""
    return repeatable_sample(residuals.select(*keys, "fitted", "residual"), keys, n, seed)


def residual_trend(residuals: DataFrame) -> DataFrame:
    """Mean, population sd and the cubic trend of residual on fitted, over all rows.

    The trend is stated in standardized fitted values, whose mean and sd are included, so
    that the cubic stays well conditioned. The two columns are written once: the powers would
    repeat what is behind them many times over in every pass.
    """
    require_columns(residuals, ["fitted", "residual"])
    residuals = settle(residuals.select("fitted", "residual"))
    m = one_row(
        residuals.agg(
            F.avg("fitted").alias("mean"),
            F.stddev_samp("fitted").alias("sd"),
            F.avg("residual").alias("rm"),
            F.stddev_pop("residual").alias("rs"),
        )
    )
    sd = m["sd"] if m["sd"] and m["sd"] > 0 else 1.0
    t = (F.col("fitted") - F.lit(m["mean"])) / F.lit(sd)
    powers = residuals.select("residual", t.alias("t1"), (t * t).alias("t2"), (t * t * t).alias("t3"))
    fit = fit_ols(powers, "residual", ["t1", "t2", "t3"], model="residual trend")
    return fit.select(
        "n",
        F.lit(m["rm"]).cast("double").alias("mean_residual"),
        F.lit(m["rs"]).cast("double").alias("std_residual"),
        F.lit(m["mean"]).cast("double").alias("fitted_mean"),
        F.lit(m["sd"]).cast("double").alias("fitted_sd"),
        term_value("intercept").alias("constant"),
        *[term_value(f"t{i}").alias(name) for i, name in ((1, "linear"), (2, "quadratic"), (3, "cubic"))],
        "status",
    )


def residual_trends(residuals: DataFrame, by: str) -> DataFrame:
    """``residual_trend`` of every model or stratum named in ``by``, all from the same aggregates.

    A part whose fitted values are all alike, or that has too few rows, says so in ``status``.
    Rows without a name take no part.
    """
    require_columns(residuals, [by, "fitted", "residual"])
    # a name of its own, since fits have a column ``model`` too
    rows = residuals.where(F.col(by).isNotNull()).select(F.col(by).alias("part"), "fitted", "residual")
    spread = F.stddev_samp("fitted")
    stats = settle(
        rows.groupBy("part").agg(
            F.avg("residual").alias("mean_residual"),
            F.stddev_pop("residual").alias("std_residual"),
            F.avg("fitted").alias("fitted_mean"),
            F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("fitted_sd"),
        )
    )
    t = (F.col("fitted") - F.col("fitted_mean")) / F.col("fitted_sd")
    scaled = attach(rows, stats.select("part", "fitted_mean", "fitted_sd"), "part", how="inner")
    powers = scaled.select("part", "residual", t.alias("t1"), (t * t).alias("t2"), (t * t * t).alias("t3"))
    fits = fit_ols(powers, "residual", ["t1", "t2", "t3"], by="part", model="residual trend")
    trends = fits.select(
        "part",
        "n",
        term_value("intercept").alias("constant"),
        *[term_value(f"t{i}").alias(name) for i, name in ((1, "linear"), (2, "quadratic"), (3, "cubic"))],
        "status",
    )
    return attach_aggregate(stats, trends, "part", how="inner").withColumnRenamed("part", by)


def model_residuals(
    df: DataFrame,
    score: str,
    index: str,
    control: str,
    group: str,
    weight: str,
    keep: Sequence[str] = (),
    min_rows: int = 0,
    fits: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """``model``, ``fitted`` and ``residual`` of the three index models, written once.

    ``fits`` are those of ``baseline_model``, ``control_model`` and ``fixed_effects_model`` where
    they are at hand. Rows of groups that ``min_rows`` leaves out have no residual.
    """
    rows = settle(df.select(*dict.fromkeys([*keep, score, index, control, group, weight])))
    if fits is None:
        fits = [
            baseline_model(rows, score, index, weight),
            control_model(rows, score, index, control, weight),
            fixed_effects_model(rows, score, index, control, group, weight, min_rows),
        ]
    large = rows
    if min_rows:
        complete = complete_rows(rows, [score, index, control, group, weight])
        sizes = complete.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= int(min_rows))
        large = attach_aggregate(complete, sizes.select(group), group, how="inner")
    designs = [(BASELINE, rows, [index], None), (CONTROL, rows, [index, control], None), (FIXED, large, [index, control], group)]
    parts = [
        add_residuals(own, fit, score, xs, weight, absorb=absorb).select(F.lit(name).alias("model"), *keep, "fitted", "residual")
        for fit, (name, own, xs, absorb) in zip(fits, designs)
    ]
    return settle(reduce(DataFrame.unionByName, parts))


def residual_samples(residuals: DataFrame, by: str, names: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """A repeatable sample of residuals for each of a few named models or strata."""
    parts = [
        repeatable_sample(residuals.where(F.col(by) == name).select(by, "fitted", "residual"), ["fitted", "residual"], n, seed)
        for name in names
    ]
    return reduce(DataFrame.unionByName, parts)


def rank_importance(table: DataFrame, top_n: int | None = None) -> DataFrame:
    """Rank ``(feature, importance)`` rows, one per feature, and keep the first ``top_n``."""
    order = Window.orderBy(F.desc("importance"), F.asc("feature"))
    ranked = table.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_n) if top_n is not None else ranked


def regression_importance(
    df: DataFrame, columns: Sequence[str], target: str, weight: str, top_n: int | None = None
) -> DataFrame:
    """Absolute standardized coefficients scaled to sum to 1, ranked, with the fit's R²."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("None of the feature columns are present")
    z = zscore(df, present, suffix="__std")
    fit = fit_ols(z, target, [f"{c}__std" for c in present], weight, model="standardized")
    terms = fit.select("r2", F.explode("terms").alias("t")).where(F.col("t.term") != "intercept")
    size = F.abs(F.coalesce(F.col("t.estimate"), F.lit(0.0)))
    # one row per feature
    total = F.sum("size").over(Window.partitionBy())
    shares = (
        terms.select(F.regexp_replace("t.term", "__std$", "").alias("feature"), size.alias("size"), "r2")
        .withColumn("importance", F.when(total > 0, F.col("size") / total).otherwise(F.lit(0.0)))
        .select("feature", "importance", F.col("r2").alias("model_accuracy"))
    )
    return rank_importance(shares, top_n)


# -- interaction of index and attitude ---------------------------------------------------


@dataclass(frozen=True)
class InteractionSpec:
    score: str
    index: str
    attitude_items: tuple[str, ...]
    group: str
    weight: str
    control: str | None = None
    negate: tuple[str, ...] = ()
    min_rows: int = 0
    attitude: str = "attitude"

    @property
    def term(self) -> str:
        return f"{self.index}_x_{self.attitude}"

    def control_of(self, df: DataFrame) -> str | None:
        return self.control if self.control in df.columns else None

    def columns(self, df: DataFrame) -> list[str]:
        control = self.control_of(df)
        items = [c for c in self.attitude_items if c in df.columns]
        return [self.score, self.index, *items, self.group, self.weight, *([control] if control else [])]


def with_attitude(df: DataFrame, spec: InteractionSpec, by: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Only the model's columns, plus the composite attitude score.

    Settled: every model makes two or more passes over these few columns, and neither the
    joins nor the index behind them should be part of each pass.
    """
    cols = [*dict.fromkeys([*spec.columns(df), *keep])]
    require_columns(df, cols)
    return settle(composite_score(df.select(*cols), spec.attitude_items, spec.attitude, spec.negate, by=by))


def interaction_frame(
    df: DataFrame, spec: InteractionSpec, within: bool = True, by: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Model frame ``(y, predictors..., weight)`` from rows that have an attitude score.

    Within-group, the product is that of the demeaned terms and is not itself demeaned.
    Returns the frame and the predictor names, which equal the terms of the model.
    """
    control = spec.control_of(df)
    base = [spec.score, spec.index, spec.attitude, *([control] if control else [])]
    if within:
        keys = [*([by] if by else []), spec.group]
        data = demean(df, base, keys, "__d")
        pick = lambda c: F.col(f"{c}__d")
    else:
        data, pick = df, F.col
    product = pick(spec.index) * pick(spec.attitude)
    cols = [pick(spec.score).alias("y"), pick(spec.index).alias(spec.index), pick(spec.attitude).alias(spec.attitude)]
    cols.append(product.alias(spec.term))
    names = [spec.index, spec.attitude, spec.term]
    if control:
        cols.append(pick(control).alias(control))
        names.append(control)
    keep = [F.col(by)] if by else []
    return data.select(*keep, *cols, F.col(spec.weight).alias("w")), names


def interaction_model(
    df: DataFrame, spec: InteractionSpec, within: bool = True, model: str | None = None
) -> DataFrame:
    """score ~ index + attitude + index x attitude (+ control), within groups or pooled."""
    name = model or ("Within-Group Interaction" if within else "Pooled Interaction")
    frame, names = interaction_frame(with_attitude(df, spec), spec, within)
    return fit_ols(frame, "y", names, "w", model=name)


def marginal_effects(
    df: DataFrame, spec: InteractionSpec, within: bool = True, method: str = "approx", fit: DataFrame | None = None
) -> DataFrame:
    """Attitude effect ``b2 + b3 * level`` at the quartiles of the model's index."""
    frame, names = interaction_frame(with_attitude(df, spec), spec, within)
    fits = fit if fit is not None else fit_ols(frame, "y", names, "w", model="interaction")
    probs = [p for _, p in EFFECT_LEVELS]
    values = quantile_values(frame, spec.index, probs, method=method)
    levels = F.array(
        *[
            F.struct(F.lit(n).alias("level"), F.lit(p).alias("prob"), F.lit(v).cast("double").alias("index_value"))
            for (n, p), v in zip(EFFECT_LEVELS, values)
        ]
    )
    b2, b3 = term_value(spec.attitude), term_value(spec.term)
    return (
        fits.select(b2.alias("b2"), b3.alias("b3"), F.inline(levels))
        .select("level", "prob", "index_value", (F.col("b2") + F.col("b3") * F.col("index_value")).alias("attitude_effect"))
    )


def read_interaction(fits: DataFrame, term: str) -> DataFrame:
    """compensatory above 0.1, cumulative below -0.1, otherwise additive."""
    b = term_value(term)
    reading = (
        F.when(b > READING_LIMIT, "compensatory").when(b < -READING_LIMIT, "cumulative").when(b.isNotNull(), "additive")
    )
    keys = [c for c in fits.columns if c != "terms"]
    return fits.select(*keys, b.alias("interaction"), reading.alias("reading"))


# -- strata ------------------------------------------------------------------------------


def stratified_frame(
    df: DataFrame,
    spec: InteractionSpec,
    stratify_by: str = "index",
    top_n: int = 3,
    restandardize: bool = True,
    method: str = "approx",
) -> tuple[DataFrame, list[str]]:
    """The model frame with its ``stratum``, and the predictor names.

    ``index`` and ``attitude`` cut the table at its 33rd and 67th percentile and fit within
    groups; ``group`` takes the largest groups and fits the pooled model in each.
    ``restandardize`` recomputes the attitude composite inside each stratum.
    """
    if stratify_by == "group":
        top = top_groups(df, spec.group, top_n).select(spec.group)
        data = attach_aggregate(df, top, spec.group, how="inner").withColumn("stratum", F.col(spec.group).cast("string"))
    elif stratify_by == "index":
        require_columns(df, [spec.index])
        cuts = quantile_values(df, spec.index, STRATUM_PROBS, method=method)
        data = add_strata(df, spec.index, cuts, INDEX_STRATA)
    elif stratify_by == "attitude":
        scored = composite_score(df, spec.attitude_items, "__whole", spec.negate)
        cuts = quantile_values(scored, "__whole", STRATUM_PROBS, method=method)
        data = add_strata(scored, "__whole", cuts, ATTITUDE_STRATA)
    else:
        raise ValueError("stratify_by must be 'index', 'attitude' or 'group'")
    data = data.where("stratum IS NOT NULL")
    again = "stratum" if restandardize or stratify_by == "group" else None
    if again is None:
        scored = composite_score(df, spec.attitude_items, spec.attitude, spec.negate)
        column = spec.index if stratify_by == "index" else spec.attitude
        labels = INDEX_STRATA if stratify_by == "index" else ATTITUDE_STRATA
        prepared = add_strata(scored, column, cuts, labels).where("stratum IS NOT NULL")
    else:
        prepared = with_attitude(data, spec, by=again, keep=["stratum"])
    return interaction_frame(prepared, spec, within=stratify_by != "group", by="stratum")


def stratified_models(
    df: DataFrame,
    spec: InteractionSpec,
    stratify_by: str = "index",
    top_n: int = 3,
    restandardize: bool = True,
    method: str = "approx",
) -> DataFrame:
    """The interaction model per stratum of ``stratified_frame``, all strata from the same aggregate."""
    frame, names = stratified_frame(df, spec, stratify_by, top_n, restandardize, method)
    return _strata_fits(frame, names, spec, stratify_by)


def _strata_fits(frame: DataFrame, names: Sequence[str], spec: InteractionSpec, stratify_by: str) -> DataFrame:
    fits = fit_ols(frame, "y", names, "w", by="stratum", model=f"stratified by {stratify_by}")
    return fits.where(F.col("n") >= F.lit(spec.min_rows))


def stratified_residuals(
    df: DataFrame,
    spec: InteractionSpec,
    stratify_by: str = "index",
    top_n: int = 3,
    restandardize: bool = True,
    method: str = "approx",
) -> DataFrame:
    """``stratum``, ``fitted`` and ``residual`` of the interaction model in every stratum, written once.

    Within groups both are those of the demeaned score.
    """
    frame, names = stratified_frame(df, spec, stratify_by, top_n, restandardize, method)
    rows = settle(frame)
    fits = _strata_fits(rows, names, spec, stratify_by)
    return settle(add_residuals(rows, fits, "y", names, "w", by="stratum").select("stratum", "fitted", "residual"))


def strata_table(fits: DataFrame, spec: InteractionSpec) -> DataFrame:
    """One row per stratum with the three coefficients of interest."""
    return fits.select(
        "stratum",
        "n",
        "r2",
        "rmse",
        term_value(spec.index).alias("index_coef"),
        term_value(spec.attitude).alias("attitude_coef"),
        term_value(spec.term).alias("interaction_coef"),
        "status",
    )


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    bad = lambda a, k: a is None or math.isnan(a) or k < 1
    return pd.Series([math.nan if bad(a, k) else chi2_tail(a, int(k)) for a, k in zip(x, dof)], dtype=float)


def heterogeneity(fits: DataFrame, term: str, alpha: float = 0.05) -> DataFrame:
    """Does a coefficient differ between strata: its values, their variance, and Cochran's Q."""
    one = fits.select(
        F.col("stratum"), term_value(term).alias("b"), term_value(term, "std_error").alias("se")
    ).where("b IS NOT NULL")
    precision = 1.0 / (F.col("se") * F.col("se"))
    pooled = one.agg(
        F.count(F.lit(1)).cast("int").alias("strata"),
        F.avg("b").alias("mean_effect"),
        F.var_samp("b").alias("variance"),
        F.sum(precision).alias("p0"),
        F.sum(precision * F.col("b")).alias("p1"),
        F.sum(precision * F.col("b") * F.col("b")).alias("p2"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("stratum", "b")))).alias("effects"),
    )
    q = F.greatest(F.col("p2") - F.col("p1") * F.col("p1") / F.col("p0"), F.lit(0.0))
    out = pooled.select("strata", "mean_effect", "variance", q.alias("q_statistic"), "effects")
    return out.withColumn("p_value", _chi2_p("q_statistic", F.col("strata") - 1)).withColumn(
        "is_heterogeneous", F.col("p_value") < F.lit(alpha)
    )


# -- grid of index groups by attitude groups ------------------------------------------------


def _group_labels(named: Sequence[str], n: int, stem: str) -> list[str]:
    """Three groups carry names; two take the outer names; other sizes are numbered."""
    if n == len(named):
        return list(named)
    if n == 2:
        return [named[0], named[-1]]
    return [f"{stem} {i + 1} of {n}" for i in range(n)]


def grid_frame(
    df: DataFrame,
    spec: InteractionSpec,
    index_groups: int = 3,
    attitude_groups: int = 3,
    method: str = "approx",
) -> DataFrame:
    """Demeaned score and attitude with percentile groups of the demeaned index and attitude."""
    frame, _ = interaction_frame(with_attitude(df, spec), spec, within=True)
    out = frame
    for column, n, named, stem, output in (
        (spec.index, index_groups, INDEX_GROUPS, "Index", "index_group"),
        (spec.attitude, attitude_groups, ATTITUDE_GROUPS, "Attitude", "attitude_group"),
    ):
        if n < 2:
            raise ValueError("A grid needs at least two groups each way")
        probs = [i / n for i in range(1, n)]
        names = [f"cut{i}" for i in range(1, n)]
        cuts = quantile_values(frame, column, probs, method=method, names=names)
        out = out.withColumn(output, band(column, cuts, _group_labels(named, n, stem)))
    return out.where("index_group IS NOT NULL AND attitude_group IS NOT NULL")


def grid_cells(grid: DataFrame) -> DataFrame:
    return cell_means(grid, "index_group", "attitude_group", "y", "w")


def simple_slopes(grid: DataFrame, spec: InteractionSpec, min_rows: int = 100) -> DataFrame:
    """Slope of score on attitude in each index group with more than ``min_rows`` rows."""
    fits = fit_ols(grid, "y", [spec.attitude], "w", by="index_group", model="simple slope")
    return fits.where(F.col("n") > min_rows).select(
        "index_group",
        term_value(spec.attitude).alias("slope"),
        term_value("intercept").alias("intercept"),
        "r2",
        "n",
    )
