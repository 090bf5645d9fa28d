"""Named queries over the order tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from surveyloom.operators import checks, crosstab as ct, grouped as gr, models as md, normalize as nm
from surveyloom.operators import ols, prep, profile as pf, segments as sg, tables as tb
from surveyloom.operators.forest import forest_importance
from surveyloom.operators.lookup import add_site_columns, delete_folder, scratch_folder, settle
from surveyloom.operators.quantiles import quantiles
from surveyloom.plans.standin import (
    CONTROL,
    DIMENSIONS,
    FLAG,
    FLAGS,
    GROUP,
    INDEX,
    INDEX_SPEC,
    INTERACTION,
    ITEMS,
    KEYS,
    SCORE,
    WEIGHT,
    indexed,
    interaction_input,
    observations,
    table,
)
from surveyloom.sources import ingest as ig, versions as vs
from surveyloom.sources.sinks import missing_value_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tidy(df: DataFrame, digits: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """Round doubles for comparison between engines; adding 0.0 removes negative zero."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# -- bands -------------------------------------------------------------------------------


@query
def band_stats(spark, sf):
    df = prep.add_score_band(observations(spark, sf, SCORE, WEIGHT), SCORE)
    return tidy(gr.band_statistics(df, SCORE, WEIGHT, "band").drop("n_rows"))


@query
def band_labels_count(spark, sf):
    return gr.group_sizes(prep.add_score_band(observations(spark, sf, SCORE), SCORE), "band")


def _some_null_scores(spark, sf):
    df = observations(spark, sf, SCORE, WEIGHT, "quantity")
    return df.withColumn(SCORE, F.when(F.col("quantity").isNotNull(), F.col(SCORE)))


@query
def band_stats_null_score(spark, sf):
    df = prep.add_score_band(_some_null_scores(spark, sf), SCORE)
    return tidy(gr.band_statistics(df, SCORE, WEIGHT, "band"))


@query
def band_stats_null_on_top(spark, sf):
    df = prep.add_score_band(_some_null_scores(spark, sf), SCORE, invalid="top")
    return tidy(gr.band_statistics(df, SCORE, WEIGHT, "band"))


@query
def band_table(spark, sf):
    df = prep.add_score_band(observations(spark, sf, SCORE, WEIGHT), SCORE)
    stats = gr.band_statistics(df, SCORE, WEIGHT, "band")
    return tidy(tb.band_table(stats).select("position", "display_name", "sample_count", "population_percentage", "mean_score"))


# -- profiles ----------------------------------------------------------------------------


@query
def column_mean(spark, sf):
    return tidy(pf.column_mean(observations(spark, sf, "quantity"), "quantity"))


@query
def column_stats(spark, sf):
    return tidy(pf.column_statistics(observations(spark, sf, "quantity"), "quantity"))


@query
def describe_numeric(spark, sf):
    return tidy(pf.describe_numeric(table(spark, sf, "lineitem")))


@query
def missing_report(spark, sf):
    df = observations(spark, sf, "quantity", "discount", "effort", "psize", "price", FLAG)
    return tidy(pf.missing_report(df))


@query
def missing_by_variable(spark, sf):
    df = observations(spark, sf, "quantity", "effort", "psize")
    names = {"quantity": "Learning Time", "effort": "Effort", "psize": "Size"}
    return pf.missing_report(df, names=names, nan=True, decimals=2)


LOSS_COLUMNS = ["quantity", "effort", "psize"]


@query
def sample_loss(spark, sf):
    return tidy(pf.sample_loss(observations(spark, sf, *LOSS_COLUMNS, WEIGHT), LOSS_COLUMNS, WEIGHT))


@query
def missing_value_summary(spark, sf):
    df = observations(spark, sf, *LOSS_COLUMNS, WEIGHT)
    return missing_value_table(pf.missing_report(df, LOSS_COLUMNS, nan=True), pf.sample_loss(df, LOSS_COLUMNS, WEIGHT))


@query
def corr_pearson(spark, sf):
    return tidy(pf.correlation(observations(spark, sf, SCORE, "quantity"), SCORE, "quantity"))


@query
def corr_spearman(spark, sf):
    return tidy(pf.correlation(observations(spark, sf, SCORE, "quantity"), SCORE, "quantity", "spearman"))


@query
def average_ranks(spark, sf):
    return pf.average_ranks(observations(spark, sf, SCORE), SCORE)


@query
def corr_matrix(spark, sf):
    return tidy(pf.correlation_matrix(indexed(spark, sf), DIMENSIONS))


@query
def distinct_groups(spark, sf):
    return pf.distinct_values(observations(spark, sf, GROUP), GROUP)


# -- preparation -------------------------------------------------------------------------


@query
def recode_sentinels(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEYS, "l_quantity", "l_tax")
    return prep.recode_sentinels(df, {"l_quantity": [49.0, 50.0], "l_tax": [0.08]})


@query
def recode_from_codebook(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    sizes = df.select(F.lit("p_size").alias("column"), F.col("p_size").alias("code")).distinct()
    book = sizes.withColumn("is_missing", F.col("code") >= 49)
    return prep.recode_from_codebook(df, book, ["p_size"])


@query
def decode_labels(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation")
    book = nation.select(
        F.lit("s_nationkey").alias("column"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")
    )
    return prep.decode_labels(df, book, "s_nationkey", "nation_label")


@query
def listwise_delete(spark, sf):
    return checks.complete_rows(observations(spark, sf, *LOSS_COLUMNS, keys=True), LOSS_COLUMNS)


@query
def reflect_item(spark, sf):
    return prep.reverse_item(observations(spark, sf, "item", keys=True), "item")


@query
def label_map(spark, sf):
    df = observations(spark, sf, FLAG, keys=True)
    return prep.label_ids(df, FLAG, {"A": "accepted", "R": "returned"}, "flag_label", "other")


@query
def dummy_encode(spark, sf):
    return prep.add_dummies(observations(spark, sf, FLAG, keys=True), FLAG)


@query
def dummy_vector(spark, sf):
    df = prep.add_dummy_vector(observations(spark, sf, FLAG, keys=True), FLAG, "dummies")
    own = vector_to_array("dummies")
    return df.select(*KEYS, FLAG, F.size(own).alias("n_dummies"), own[0].alias("first_dummy"), own[1].alias("second_dummy"))


@query
def interaction_term(spark, sf):
    df = observations(spark, sf, "discount", "quantity", keys=True)
    return tidy(prep.add_interaction(df, "discount", "quantity"))


@query
def impute_mean(spark, sf):
    return tidy(prep.impute(observations(spark, sf, "quantity", "effort", keys=True), ["quantity", "effort"], "mean"))


@query
def impute_zero(spark, sf):
    return prep.impute(observations(spark, sf, "quantity", "effort", keys=True), ["quantity", "effort"], "zero")


@query
def impute_drop(spark, sf):
    return prep.impute(observations(spark, sf, "quantity", "effort", keys=True), ["quantity", "effort"], "drop")


# -- normalisation -----------------------------------------------------------------------


@query
def zscore(spark, sf):
    return tidy(nm.zscore(observations(spark, sf, "quantity", "discount", keys=True), ["quantity", "discount"]))


@query
def zscore_by_group(spark, sf):
    df = observations(spark, sf, GROUP, "quantity", keys=True)
    return tidy(nm.zscore(df, "quantity", by=GROUP))


@query
def dimension_score(spark, sf):
    df = observations(spark, sf, "quantity", "psize", keys=True)
    return tidy(nm.dimension_score(df, nm.Dimension("dim", ("quantity", "psize"), reverse=True)))


@query
def dimension_score_flipped_raw(spark, sf):
    df = observations(spark, sf, "quantity", "psize", keys=True)
    dim = nm.Dimension("dim", ("quantity", "psize"), flip=frozenset({"psize"}))
    return tidy(nm.dimension_score(df, dim, standardize=False, missing="impute_mean"))


@query
def composite_index(spark, sf):
    return tidy(indexed(spark, sf, keys=True).select(*KEYS, SCORE, *DIMENSIONS, INDEX))


@query
def composite_index_drop(spark, sf):
    df = observations(spark, sf, *INDEX_SPEC.columns, keys=True)
    spec = nm.IndexSpec(INDEX_SPEC.dimensions, missing="drop", output=INDEX)
    return tidy(nm.composite_index(df, spec).select(*KEYS, "quantity", "psize", INDEX))


@query
def index_levels(spark, sf):
    return gr.group_sizes(prep.add_index_level(indexed(spark, sf), INDEX), "level")


@query
def attitude_composite(spark, sf):
    df = observations(spark, sf, *ITEMS, keys=True)
    return tidy(nm.composite_score(df, ITEMS, "attitude", ("item",)))


# -- join and group statistics -------------------------------------------------------------


@query
def site_left_join(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "site_key")
    sites = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "site_key")
    return add_site_columns(
        lines, sites, "site_key", ["l_orderkey", "l_linenumber", "site_key", "l_quantity"], ["site_key", "s_acctbal"]
    )


@query
def index_by_band(spark, sf):
    return tidy(gr.index_by_group(indexed(spark, sf), INDEX, WEIGHT, "band", DIMENSIONS, "exact"))


@query
def index_by_band_approx(spark, sf):
    return gr.index_by_group(indexed(spark, sf), INDEX, WEIGHT, "band", DIMENSIONS)


@query
def dimension_means(spark, sf):
    return tidy(gr.dimension_means(indexed(spark, sf), DIMENSIONS, "band"))


@query
def percentiles_exact(spark, sf):
    return tidy(quantiles(observations(spark, sf, GROUP, SCORE), SCORE, [0.1, 1 / 3, 0.5, 0.67, 0.99], GROUP, "exact"))


@query
def percentiles_discrete(spark, sf):
    df = observations(spark, sf, SCORE)
    return quantiles(df, SCORE, [0.25, 0.5, 0.75], method="exact", kind="discrete")


@query
def percentiles_approx(spark, sf):
    return quantiles(observations(spark, sf, GROUP, SCORE), SCORE, [0.25, 0.5, 0.75], GROUP)


@query
def share_above_q75(spark, sf):
    return tidy(gr.share_above(indexed(spark, sf), INDEX, "band", 0.75, "exact"))


@query
def index_histogram(spark, sf):
    return tidy(gr.histogram(indexed(spark, sf), INDEX, 0.0, 100.0, 20, WEIGHT))


@query
def cell_means(spark, sf):
    df = observations(spark, sf, FLAG, GROUP, SCORE, WEIGHT)
    return tidy(gr.cell_means(df, FLAG, GROUP, SCORE, WEIGHT))


@query
def group_profile(spark, sf):
    return tidy(gr.cluster_profile(indexed(spark, sf, FLAG), FLAG, DIMENSIONS, WEIGHT))


@query
def group_outcomes(spark, sf):
    return tidy(gr.outcomes(observations(spark, sf, FLAG, SCORE, WEIGHT), FLAG, SCORE, WEIGHT))


@query
def cluster_sizes(spark, sf):
    return gr.group_sizes(observations(spark, sf, "item"), "item")


@query
def top_groups(spark, sf):
    return gr.top_groups(observations(spark, sf, GROUP), GROUP, 5)


@query
def within_group_demean(spark, sf):
    df = observations(spark, sf, GROUP, SCORE, "quantity", keys=True)
    return tidy(gr.demean(df, [SCORE, "quantity"], GROUP))


@query
def within_group_demean_weighted(spark, sf):
    df = observations(spark, sf, GROUP, SCORE, "quantity", WEIGHT, keys=True)
    return tidy(gr.demean(df, [SCORE, "quantity"], GROUP, weight=WEIGHT))


# -- cross-tabulation ----------------------------------------------------------------------


def _bands_by_flag(spark, sf):
    return prep.add_score_band(observations(spark, sf, SCORE, WEIGHT, FLAG), SCORE)


@query
def crosstab(spark, sf):
    return ct.crosstab(_bands_by_flag(spark, sf), "band", FLAG, WEIGHT, FLAGS)


@query
def crosstab_totals(spark, sf):
    return ct.crosstab_with_totals(_bands_by_flag(spark, sf), "band", FLAG, WEIGHT)


@query
def crosstab_rowpct(spark, sf):
    cells = ct.filled_cells(_bands_by_flag(spark, sf), "band", FLAG, WEIGHT, FLAGS)
    return tidy(ct.row_percent(cells, "band"))


@query
def crosstab_minmax(spark, sf):
    cells = ct.filled_cells(_bands_by_flag(spark, sf), "band", FLAG, WEIGHT, FLAGS)
    return tidy(nm.minmax_cells(cells, "weighted_count"))


@query
def expected_cells(spark, sf):
    return tidy(ct.expected_cells(_bands_by_flag(spark, sf), "band", FLAG, WEIGHT, FLAGS))


@query
def chi_square(spark, sf):
    return tidy(ct.chi_square(_bands_by_flag(spark, sf), "band", FLAG, WEIGHT))


@query
def chi_square_rescaled(spark, sf):
    return tidy(ct.chi_square(_bands_by_flag(spark, sf), "band", FLAG, WEIGHT, rescale=True))


@query
def segment_share_compare(spark, sf):
    stats = gr.segment_statistics(observations(spark, sf, FLAG, WEIGHT), WEIGHT, FLAG)
    return tidy(tb.share_comparison(stats, FLAG))


@query
def segment_table(spark, sf):
    stats = gr.segment_statistics(observations(spark, sf, FLAG, WEIGHT), WEIGHT, FLAG)
    return tidy(tb.segment_table(stats, FLAG, ["R", "N", "A"]))


# -- index models ---------------------------------------------------------------------------


def _model_input(spark, sf):
    # three models read these columns
    return settle(indexed(spark, sf, CONTROL, GROUP).select(SCORE, INDEX, CONTROL, GROUP, WEIGHT))


def _three_models(df):
    return [
        md.baseline_model(df, SCORE, INDEX, WEIGHT),
        md.control_model(df, SCORE, INDEX, CONTROL, WEIGHT),
        md.fixed_effects_model(df, SCORE, INDEX, CONTROL, GROUP, WEIGHT),
    ]


def _flat_fit(fits, terms, keys=()):
    """One row per fit with its coefficients as columns."""
    parts = [ols.term_value(t).alias(f"b_{t}") for t in terms]
    return tidy(fits.select(*keys, "n", "r2", "rmse", *parts), 5)


@query
def ols_baseline(spark, sf):
    df = indexed(spark, sf).select(SCORE, INDEX, WEIGHT)
    return _flat_fit(md.baseline_model(df, SCORE, INDEX, WEIGHT), [INDEX, "intercept"])


@query
def ols_baseline_errors(spark, sf):
    fits = md.baseline_model(indexed(spark, sf).select(SCORE, INDEX, WEIGHT), SCORE, INDEX, WEIGHT)
    return tidy(ols.coefficients(fits).drop("p_value"), 5)


@query
def ols_control(spark, sf):
    df = indexed(spark, sf, CONTROL).select(SCORE, INDEX, CONTROL, WEIGHT)
    return _flat_fit(md.control_model(df, SCORE, INDEX, CONTROL, WEIGHT), [INDEX, CONTROL, "intercept"])


@query
def ols_fixed_effects(spark, sf):
    df = indexed(spark, sf, CONTROL, GROUP).select(SCORE, INDEX, CONTROL, GROUP, WEIGHT)
    fit = md.fixed_effects_model(df, SCORE, INDEX, CONTROL, GROUP, WEIGHT)
    return _flat_fit(fit, [INDEX, CONTROL], ["groups"])


@query
def model_comparison(spark, sf):
    return tidy(md.compare_models(_three_models(_model_input(spark, sf)), INDEX).drop("p_value"), 5)


@query
def model_terms(spark, sf):
    fits = _three_models(_model_input(spark, sf))
    return ols.coefficients(fits[0].unionByName(fits[1]).unionByName(fits[2]))


def _baseline_residuals(spark, sf, keys=False):
    df = indexed(spark, sf, keys=keys).select(*(KEYS if keys else []), SCORE, INDEX, WEIGHT)
    fit = md.baseline_model(df, SCORE, INDEX, WEIGHT).first()
    return ols.with_residuals(df, fit, SCORE, [INDEX], WEIGHT)


@query
def residual_sample(spark, sf):
    return md.residual_sample(_baseline_residuals(spark, sf, keys=True), KEYS, 5000)


@query
def residuals_by_model(spark, sf):
    rows = md.model_residuals(_model_input(spark, sf), SCORE, INDEX, CONTROL, GROUP, WEIGHT)
    return tidy(md.residual_trends(rows, "model"), 4)


@query
def residuals_by_stratum(spark, sf):
    rows = md.stratified_residuals(interaction_input(spark, sf), INTERACTION, "group", top_n=3)
    return tidy(md.residual_trends(rows, "stratum"), 4)


@query
def residual_trend(spark, sf):
    return tidy(md.residual_trend(_baseline_residuals(spark, sf)), 4)


FEATURES = ["quantity", "discount", "tax", "psize", "price", "site"]


@query
def importance_regression(spark, sf):
    df = observations(spark, sf, *FEATURES, SCORE, WEIGHT)
    return tidy(md.regression_importance(df, FEATURES, SCORE, WEIGHT))


@query
def importance_topn(spark, sf):
    df = observations(spark, sf, *FEATURES, SCORE, WEIGHT)
    return tidy(md.regression_importance(df, FEATURES, SCORE, WEIGHT, top_n=3).drop("model_accuracy"))


@query
def importance_forest(spark, sf):
    df = observations(spark, sf, *FEATURES, SCORE)
    return forest_importance(df, FEATURES, SCORE)


# -- interaction ------------------------------------------------------------------------------

TERMS = [INDEX, "attitude", INTERACTION.term, CONTROL]


@query
def interaction_within(spark, sf):
    fits = md.interaction_model(interaction_input(spark, sf), INTERACTION)
    return _flat_fit(fits, [*TERMS, "intercept"], ["adjusted_r2"])


@query
def interaction_pooled(spark, sf):
    fits = md.interaction_model(interaction_input(spark, sf), INTERACTION, within=False)
    return _flat_fit(fits, [*TERMS, "intercept"], ["adjusted_r2"])


@query
def interaction_reading(spark, sf):
    fits = md.interaction_model(interaction_input(spark, sf), INTERACTION)
    return md.read_interaction(fits, INTERACTION.term).select("model", "reading")


@query
def marginal_effects(spark, sf):
    return tidy(md.marginal_effects(interaction_input(spark, sf), INTERACTION, method="exact"), 5)


@query
def stratified_by_index(spark, sf):
    fits = md.stratified_models(interaction_input(spark, sf), INTERACTION, "index", method="exact")
    return tidy(md.strata_table(fits, INTERACTION), 4)


@query
def stratified_by_attitude(spark, sf):
    fits = md.stratified_models(interaction_input(spark, sf), INTERACTION, "attitude", method="exact")
    return tidy(md.strata_table(fits, INTERACTION), 4)


@query
def stratified_by_group(spark, sf):
    fits = md.stratified_models(interaction_input(spark, sf), INTERACTION, "group", top_n=3)
    return tidy(md.strata_table(fits, INTERACTION), 4)


@query
def heterogeneity(spark, sf):
    fits = md.stratified_models(interaction_input(spark, sf), INTERACTION, "index", method="exact")
    return tidy(md.heterogeneity(fits, "attitude").drop("effects"), 4)


@query
def heterogeneity_variance(spark, sf):
    fits = md.stratified_models(interaction_input(spark, sf), INTERACTION, "group", top_n=3)
    return tidy(md.heterogeneity(fits, "attitude").select("strata", "mean_effect", "variance"), 4)


def _grid(spark, sf):
    return md.grid_frame(interaction_input(spark, sf), INTERACTION, method="exact")


@query
def interaction_grid(spark, sf):
    return tidy(md.grid_cells(_grid(spark, sf)))


@query
def simple_slopes(spark, sf):
    return tidy(md.simple_slopes(_grid(spark, sf), INTERACTION), 5)


@query
def grid_matrix(spark, sf):
    cells = md.grid_cells(_grid(spark, sf))
    columns = list(md.ATTITUDE_GROUPS)
    return tidy(tb.cell_matrix(cells, "index_group", "attitude_group", "weighted_mean_score", columns))


@query
def fitted_lines(spark, sf):
    return tidy(tb.fitted_lines(md.simple_slopes(_grid(spark, sf), INTERACTION), "index_group"), 5)


# -- segments -----------------------------------------------------------------------------------


def _segments(spark, sf):
    df = observations(spark, sf, "quantity", "item", "discount", "effort", WEIGHT, SCORE)
    return sg.attitude_segments(df, ["quantity", "item", "discount", "effort"], ["item"], 3)


def _clusters(spark, sf):
    return sg.dimension_clusters(indexed(spark, sf), DIMENSIONS, 4)


@query
def segments(spark, sf):
    return _segments(spark, sf).summary()


@query
def segments_given_centres(spark, sf):
    """Sizes and spreads of the clusters around given centres."""
    df = observations(spark, sf, WEIGHT, "quantity", "discount")
    near = sg.assign_to_centres(df, ["quantity", "discount"], [(10.0, 0.02), (25.0, 0.05), (40.0, 0.08)])
    sums = [F.sum(WEIGHT).alias("weight"), F.sum("distance").alias("inertia"), F.avg("quantity").alias("mean_quantity")]
    return tidy(near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums), 4)


@query
def segment_stats(spark, sf):
    return gr.segment_statistics(_segments(spark, sf).rows, WEIGHT, ["cluster", "segment"])


@query
def segment_crosstab(spark, sf):
    rows = prep.add_score_band(_segments(spark, sf).rows, SCORE)
    return ct.crosstab(rows, "band", "segment", WEIGHT, sg.NAMES_BY_COUNT[3])


@query
def segment_centres(spark, sf):
    return _segments(spark, sf).centre_table()


@query
def segment_profile(spark, sf):
    return gr.cluster_profile(_clusters(spark, sf).rows, "cluster_name", DIMENSIONS, WEIGHT)


@query
def segment_outcomes(spark, sf):
    return gr.outcomes(_clusters(spark, sf).rows, "cluster_name", SCORE, WEIGHT)


@query
def cluster_summary(spark, sf):
    return _clusters(spark, sf).summary()


@query
def silhouette(spark, sf):
    return sg.silhouette(_segments(spark, sf))


# -- sources --------------------------------------------------------------------------------------


# -- missing values that arrive as NaN, many groups, large means ---------------------------


def _with_nan(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls turned to NaN, which counts as missing too."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns})


@query
def zscore_nan(spark, sf):
    df = _with_nan(observations(spark, sf, "quantity", "discount", keys=True), "quantity")
    return tidy(nm.zscore(df, ["quantity", "discount"]).drop("quantity", "discount"))


@query
def composite_index_nan(spark, sf):
    df = _with_nan(observations(spark, sf, *INDEX_SPEC.columns, keys=True), "quantity", "psize")
    return tidy(nm.composite_index(df, INDEX_SPEC).select(*KEYS, *DIMENSIONS, INDEX))


@query
def band_stats_nan(spark, sf):
    df = prep.add_score_band(_with_nan(_some_null_scores(spark, sf), SCORE), SCORE)
    return tidy(gr.band_statistics(df, SCORE, WEIGHT, "band"))


@query
def impute_mean_nan(spark, sf):
    df = _with_nan(observations(spark, sf, "quantity", "effort", keys=True), "quantity", "effort")
    return tidy(prep.impute(df, ["quantity", "effort"], "mean"))


@query
def reflect_nan(spark, sf):
    df = _with_nan(observations(spark, sf, "quantity", keys=True), "quantity")
    return prep.reverse_item(df, "quantity").drop("quantity")


@query
def demean_nan(spark, sf):
    df = _with_nan(observations(spark, sf, GROUP, "quantity", keys=True), "quantity")
    return tidy(gr.demean(df, ["quantity"], GROUP).drop("quantity"))


@query
def percentiles_by_part(spark, sf):
    lines = table(spark, sf, "lineitem")
    return tidy(quantiles(lines, "l_extendedprice", [0.25, 0.5, 0.75], "l_partkey", "exact"))


@query
def crosstab_long(spark, sf):
    """Every part with every supplier, empty cells too, summed up per part."""
    lines = table(spark, sf, "lineitem")
    cells = ct.filled_cells(lines, "l_partkey", "l_suppkey", "l_quantity")
    empty = F.count_if(F.col("weighted_count") == 0)
    return tidy(
        cells.groupBy("l_partkey").agg(
            F.count(F.lit(1)).alias("cells"), empty.alias("empty_cells"), F.sum("weighted_count").alias("weighted_count")
        )
    )


@query
def chi_square_many(spark, sf):
    lines = table(spark, sf, "lineitem")
    found = ct.chi_square(lines, "l_partkey", "l_suppkey", "l_quantity")
    return tidy(found.select("statistic", "dof", "total_weight", "cramers_v"), 4)


@query
def ols_large_mean(spark, sf):
    """A predictor whose mean is a million times its spread."""
    df = observations(spark, sf, SCORE, WEIGHT, "discount").withColumn("far", F.col("discount") + 1e6)
    fits = ols.fit_ols(df, SCORE, ["far"], WEIGHT)
    return tidy(fits.select("n", "r2", "rmse", ols.term_value("far").alias("far"), "status"), 3)


@query
def ols_collinear(spark, sf):
    """A predictor that repeats another one beside a large mean is told, not fitted."""
    df = observations(spark, sf, SCORE, WEIGHT, "discount").withColumn("far", F.col("discount") + 5e4)
    fits = ols.fit_ols(df.withColumn("twin", 2 * F.col("far") + 3), SCORE, ["far", "twin"], WEIGHT)
    return fits.select("n", "status", ols.term_value("far").alias("far"), ols.term_value("twin").alias("twin"))


def _waves(spark, sf, n: int):
    """The observations with n columns that repeat at different rates, and one that follows from two of them."""
    df = observations(spark, sf, WEIGHT, "l_orderkey", "l_partkey")
    # one array made by one small function: sixty columns side by side are too long a method to be compiled
    wave = lambda i: F.sin(F.col("l_orderkey") * (F.lit(0.37) + i) + F.col("l_partkey") * (F.lit(0.11) * i))
    df = df.select(WEIGHT, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), wave).alias("waves"))
    waves = [F.get("waves", i).alias(f"x{i}") for i in range(n)]
    # read off two keys in every pass: written, they would be sixty times what they are made of
    return df.select(WEIGHT, *waves).withColumn("y", 2 * F.col("x0") - 3 * F.col("x1") + 5), [f"x{i}" for i in range(n)]


@query
def ols_wide(spark, sf):
    """60 predictors in one fit."""
    df, xs = _waves(spark, sf, 60)
    return tidy(ols.coefficients(ols.fit_ols(df, "y", xs, WEIGHT)).select("term", "estimate"), 5)


@query
def ols_wide_collinear(spark, sf):
    """60 predictors, of which one is constant, or repeats another."""
    df, xs = _waves(spark, sf, 59)
    flat = ols.fit_ols(df.withColumn("flat", F.lit(7.0)), "y", [*xs, "flat"], WEIGHT, model="constant")
    twin = ols.fit_ols(df.withColumn("twin", 2 * F.col("x9")), "y", [*xs, "twin"], WEIGHT, model="twin")
    return flat.unionByName(twin).select("model", "n", "status")


@query
def codebook_profile(spark, sf):
    return ig.codebook(table(spark, sf, "orders")).select("position", "column", "type", F.size("samples").alias("samples"))


@query
def source_files(spark, sf):
    """Rows that each data file of a dataset holds."""
    lines = table(spark, sf, "lineitem").select(F.col("_metadata.file_name").alias("file"), "l_orderkey")
    return lines.groupBy("file").agg(F.count("l_orderkey").alias("n"))


@query
def ingest_roundtrip(spark, sf):
    """Ingest a table to fresh Parquet, then compare rows, columns and schema."""
    home = f"{scratch_folder(spark)}/ingest-{uuid.uuid4().hex}"
    source = ig.Source("orders", f"{sf}/orders.parquet", f"{home}/orders", format="parquet")
    ig.ingest(spark, source, f"{home}/manifest")
    return ig.validate_ingest(source.read(spark), spark.read.parquet(source.target), "orders")


@query
def ingest_incremental(spark, sf):
    """A store per source file after one part of the orders was changed, one removed and one added."""
    home = f"{scratch_folder(spark)}/ingest-{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    part = lambda i: orders.filter(F.col("o_orderkey") % 3 == i)
    source = ig.Source("orders", f"{home}/in", f"{home}/out", format="parquet", options={"recursiveFileLookup": "true"})
    for i in range(3):
        part(i).write.parquet(f"{home}/in/part-{i}")
    vs.ingest_incremental(spark, source)
    part(1).withColumn("o_totalprice", F.col("o_totalprice") + 1).write.mode("overwrite").parquet(f"{home}/in/part-1")
    delete_folder(f"{home}/in/part-2")
    part(2).withColumn("o_orderkey", -F.col("o_orderkey")).write.parquet(f"{home}/in/part-3")
    vs.ingest_incremental(spark, source)
    return tidy(
        vs.read_version(spark, source.target)
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("o_totalprice").alias("price")),
        2,
    )


@query
def manifest_diff(spark, sf):
    """Files still to do after an ingest: none."""
    home = f"{scratch_folder(spark)}/ingest-{uuid.uuid4().hex}"
    source = ig.Source("orders", f"{sf}/orders.parquet", f"{home}/orders", format="parquet")
    ig.ingest(spark, source, f"{home}/manifest")
    manifest = ig.read_manifest(spark, f"{home}/manifest")
    left = ig.changed_files(ig.list_files(spark, source.path), manifest, "orders")
    return left.agg(F.count(F.lit(1)).alias("changed_files")).select(
        F.lit("orders").alias("dataset"), "changed_files"
    )
