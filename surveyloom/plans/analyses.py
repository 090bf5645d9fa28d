"""Whole analyses. Each returns a dict of named result tables, ready for the sinks.

A step that fails is reported under ``errors`` and the others still run. An expensive
shared input is persisted while the tables are being built and written by the caller's
``use`` function, and released by the same handle.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from surveyloom.operators import crosstab as ct
from surveyloom.operators import grouped as gr
from surveyloom.operators import models as md
from surveyloom.operators import normalize as nm
from surveyloom.operators import ols
from surveyloom.operators import profile as pf
from surveyloom.operators import segments as sg
from surveyloom.operators import tables as tb
from surveyloom.operators.checks import complete_rows, missing_columns, require_columns
from surveyloom.operators.forest import forest_importance
from surveyloom.operators.lookup import add_site_columns
from surveyloom.operators.prep import add_score_band, recode_from_codebook
from surveyloom.sources.catalog import Catalog
from surveyloom.sources.ingest import Source, ingest_all
from surveyloom.sources.sinks import missing_value_table, write_tables

log = logging.getLogger(__name__)


@dataclass
class Result:
    """Named tables, plus the message of every step that failed."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            self.tables[name] = build()
            return self.tables[name]
        except Exception as error:
            log.warning("%s failed: %s", name, error)
            self.errors[name] = str(error)
            return None

    def write(self, folder: str) -> list[str]:
        """Write table by table, so that one that cannot be computed leaves the others."""
        paths = []
        for name, table in self.tables.items():
            try:
                paths += write_tables({name: table}, folder)
            except Exception as error:
                log.warning("%s could not be written: %s", name, error)
                self.errors[name] = str(error)
        return paths


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Hold a frame on the executors, spilling to disk, while a block uses it repeatedly."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def score_bands(df: DataFrame, score: str, weight: str, invalid: str = "null") -> Result:
    """Weighted statistics per score band, in display order."""
    require_columns(df, [score, weight])
    out = Result()
    bands = add_score_band(df.select(score, weight), score, invalid=invalid)
    out.step("band_statistics", lambda: tb.band_table(gr.band_statistics(bands, score, weight, "band")))
    return out


def indexed_observations(
    observations: DataFrame,
    sites: DataFrame | None,
    spec: nm.IndexSpec,
    key: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Prune, join the site table, check the indicators, and add dimensions and index."""
    data = observations
    if sites is not None:
        wanted = [*dict.fromkeys([key, *keep, *spec.columns])]
        left = [c for c in wanted if c in observations.columns]
        right = [key, *[c for c in wanted if c in sites.columns and c not in observations.columns]]
        data = add_site_columns(observations, sites, key, left, right)
    ok, absent = missing_columns(data, [*spec.columns, *keep])
    if not ok:
        raise ValueError(f"Missing columns: {', '.join(absent)}")
    return nm.composite_index(data, spec)


def index_analyses(
    df: DataFrame,
    spec: nm.IndexSpec,
    score: str,
    weight: str,
    control: str,
    group: str,
    band: str = "band",
    clusters: int | None = 4,
    method: str = "approx",
    trees: int = 100,
    min_rows: int = 0,
) -> Result:
    """Models, distributions, importance and clusters of an indexed table."""
    out = Result()
    index, dims = spec.output, spec.names
    base = out.step("ols_baseline", lambda: md.baseline_model(df, score, index, weight))
    ctrl = out.step("ols_control", lambda: md.control_model(df, score, index, control, weight))
    fixed = out.step(
        "ols_fixed_effects", lambda: md.fixed_effects_model(df, score, index, control, group, weight, min_rows)
    )
    fits = [f for f in (base, ctrl, fixed) if f is not None]
    if fits:
        out.step("model_comparison", lambda: md.compare_models(fits, index))
    if len(fits) == 3:
        residuals = out.step(
            "residuals", lambda: md.model_residuals(df, score, index, control, group, weight, min_rows=min_rows, fits=fits)
        )
        if residuals is not None:
            # rows of all models are an input of the tables, not a result
            del out.tables["residuals"]
            names = (md.BASELINE, md.CONTROL, md.FIXED)
            out.step("residuals_by_model", lambda: md.residual_trends(residuals, "model"))
            out.step("residual_sample", lambda: md.residual_samples(residuals, "model", names))
    out.step("index_by_band", lambda: gr.index_by_group(df, index, weight, band, dims, method))
    out.step("share_above_q75", lambda: gr.share_above(df, index, band, 0.75, method))
    out.step("index_histogram", lambda: gr.histogram(df, index, 0.0, 100.0, 50, weight))
    out.step("dimension_correlations", lambda: pf.correlation_matrix(df, dims))
    out.step("importance_forest", lambda: forest_importance(df, spec.columns, score, num_trees=trees))
    out.step("importance_regression", lambda: md.regression_importance(df, spec.columns, score, weight))
    if clusters:
        found: list[sg.Segmentation] = []

        def cluster() -> DataFrame:
            found.append(sg.dimension_clusters(df, dims, clusters))
            return found[0].summary()

        if out.step("clusters", cluster) is not None:
            rows, name = found[0].rows, "cluster_name"
            out.step("cluster_profile", lambda: gr.cluster_profile(rows, name, dims, weight))
            out.step("cluster_outcomes", lambda: gr.outcomes(rows, name, score, weight))
            out.step("cluster_silhouette", lambda: sg.silhouette(found[0]))
    return out


def interaction_analyses(df: DataFrame, spec: md.InteractionSpec, method: str = "approx") -> Result:
    """Within-group and pooled models, both stratifications, heterogeneity, and the grid."""
    out = Result()
    require_columns(df, [spec.score, spec.index, spec.group, spec.weight])
    within = out.step("interaction_within", lambda: md.interaction_model(df, spec, True))
    out.step("interaction_pooled", lambda: md.interaction_model(df, spec, False))
    if within is not None:
        out.step("main_model_coefficients", lambda: ols.coefficients(within))
        out.step("interaction_reading", lambda: md.read_interaction(within, spec.term))
        out.step("marginal_effects", lambda: md.marginal_effects(df, spec, method=method, fit=within))
    for kind in ("index", "attitude"):
        fits = out.step(
            f"stratified_fits_by_{kind}", lambda: md.stratified_models(df, spec, kind, method=method)
        )
        if fits is not None:
            out.step(f"stratified_by_{kind}", lambda: md.strata_table(fits, spec))
            out.step(f"heterogeneity_by_{kind}", lambda: md.heterogeneity(fits, spec.attitude))
            out.step(
                f"residuals_by_{kind}_stratum",
                lambda: md.residual_trends(md.stratified_residuals(df, spec, kind, method=method), "stratum"),
            )
    grid = out.step("grid_rows", lambda: md.grid_frame(df, spec, method=method))
    if grid is not None:
        # rows of the grid are an input of the tables, not a result
        del out.tables["grid_rows"]
        out.step("grid_cells", lambda: md.grid_cells(grid))
        slopes = out.step("simple_slopes", lambda: md.simple_slopes(grid, spec))
        cells = out.tables.get("grid_cells")
        if cells is not None:
            out.step(
                "grid_matrix",
                lambda: tb.cell_matrix(
                    cells, "index_group", "attitude_group", "weighted_mean_score", md.ATTITUDE_GROUPS
                ),
            )
        if slopes is not None:
            out.step("fitted_lines", lambda: tb.fitted_lines(slopes, "index_group"))
    return out


def attitude_analyses(
    df: DataFrame,
    items: Sequence[str],
    weight: str,
    reverse: Sequence[str] = (),
    k: int = 3,
    names: Mapping[str, str] | None = None,
) -> tuple[Result, sg.Segmentation]:
    """Missingness, list-wise deletion, segments and their weighted shares."""
    require_columns(df, [*items, weight])
    out = Result()
    missing = pf.missing_report(df, items, nan=True)
    loss = pf.sample_loss(df, items, weight)
    out.step("missing_values", lambda: missing_value_table(missing, loss, names))
    found = sg.attitude_segments(complete_rows(df, items), items, reverse, k)
    stats = gr.segment_statistics(found.rows, weight, "segment")
    order = sg.NAMES_BY_COUNT.get(k) or sorted(found.labels.values())
    out.step("segment_statistics", lambda: tb.segment_table(stats, "segment", order))
    out.step("segment_shares", lambda: tb.share_comparison(stats, "segment"))
    out.step("segment_centres", found.centre_table)
    return out, found


def cross_analyses(
    df: DataFrame, score: str, items: Sequence[str], weight: str, reverse: Sequence[str] = (), k: int = 3
) -> Result:
    """Score bands crossed with attitude segments, and the test of independence."""
    banded = add_score_band(df, score)
    out, found = attitude_analyses(banded, items, weight, reverse, k)
    columns = sg.NAMES_BY_COUNT.get(k) or sorted(found.labels.values())
    rows = found.rows
    out.step("crosstab", lambda: tb.ordered_table(ct.crosstab(rows, "band", "segment", weight, columns), "band", tb.BAND_ORDER))
    out.step("crosstab_totals", lambda: ct.crosstab_with_totals(rows, "band", "segment", weight))
    out.step("chi_square", lambda: ct.chi_square(rows, "band", "segment", weight))
    return out


@dataclass(frozen=True)
class Study:
    """Column roles of one survey."""

    score: str
    weight: str
    group: str
    control: str
    index: nm.IndexSpec
    interaction: md.InteractionSpec
    site_key: str | None = None


def without_missing_codes(df: DataFrame, codebook: DataFrame) -> DataFrame:
    """Null out the codes that the codebook marks as missing, in the columns the table has."""
    return recode_from_codebook(df, codebook, df.columns)


def run_study(
    observations: DataFrame,
    sites: DataFrame | None,
    study: Study,
    folder: str,
    with_index: bool = True,
    with_interaction: bool = True,
    method: str = "approx",
    trees: int = 100,
    codebook: DataFrame | None = None,
) -> Result:
    """Bands, index and interaction analyses, written below ``folder`` as they are built.

    With a ``(column, code, is_missing)`` codebook, codes that stand for a missing answer become
    null before anything is computed, in observations and sites.
    """
    if codebook is not None:
        observations = without_missing_codes(observations, codebook)
        sites = without_missing_codes(sites, codebook) if sites is not None else None
    total = score_bands(observations, study.score, study.weight)
    total.write(folder)
    if not with_index:
        return total
    keep = [study.score, study.weight, study.group, study.control, *study.interaction.attitude_items]
    data = indexed_observations(observations, sites, study.index, study.site_key, [*dict.fromkeys(keep)])
    data = add_score_band(data, study.score)
    with reused(data) as held:
        parts = [
            index_analyses(
                held, study.index, study.score, study.weight, study.control, study.group, method=method, trees=trees
            )
        ]
        if with_interaction:
            parts.append(interaction_analyses(held, study.interaction, method))
        for part in parts:
            part.write(folder)
            total.tables |= part.tables
            total.errors |= part.errors
    return total


def run_from_files(
    spark: SparkSession,
    sources: Sequence[Source],
    manifest: str,
    study: Study,
    folder: str,
    observations: str = "student",
    sites: str | None = "school",
    **options,
) -> tuple[DataFrame, Result]:
    """Ingest what changed, then run the study on the named datasets.

    Returns the ingest report and the study's result. A dataset that fails to ingest only
    stops the study if the study reads it.
    """
    report = ingest_all(spark, sources, manifest)
    needed = {observations, *([sites] if sites else [])}
    catalog = Catalog("", tuple(s.name for s in sources), paths={s.name: s.target for s in sources})
    failed = {r["dataset"]: r["message"] for r in report.where("status = 'failed'").collect()}  # one row per dataset
    for name in sorted(needed & set(failed)):
        raise ValueError(f"Dataset '{name}' could not be ingested: {failed[name]}")
    site_table = catalog.read(spark, sites) if sites else None
    return report, run_study(catalog.read(spark, observations), site_table, study, folder, **options)
