"""SQL for the named queries, for checking results on another engine.

Regressions are stated here as plain elimination on centred weighted cross products, one
predictor after another, which is independent of the way the library solves them.
"""

from __future__ import annotations

from collections.abc import Sequence

OBS = """
obs AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_extendedprice / 100 AS score, CAST(l_linenumber AS DOUBLE) AS wt, l_returnflag AS flag,
         NULLIF(l_quantity, 50) AS quantity, l_discount AS discount, l_tax AS tax,
         NULLIF(l_tax, 0.08) AS effort, CAST(1 + l_partkey % 4 AS DOUBLE) AS item,
         n_name AS grp, s_acctbal AS site, c_acctbal AS control,
         CAST(NULLIF(p_size, 50) AS DOUBLE) AS psize, p_retailprice AS price
  FROM lineitem
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
)"""

BAND = "CASE WHEN score IS NULL THEN NULL WHEN score < 482 THEN 'low' WHEN score < 607 THEN 'middle' ELSE 'high' END"

BANDED = OBS + f", banded AS (SELECT *, {BAND} AS band FROM obs)"

IXD = (
    OBS
    + f""",
mom AS (
  SELECT AVG(quantity) mq, STDDEV_SAMP(quantity) sq, AVG(site) ms, STDDEV_SAMP(site) ss,
         AVG(discount) md, STDDEV_SAMP(discount) sd, AVG(psize) mp, STDDEV_SAMP(psize) sp,
         AVG(tax) mt, STDDEV_SAMP(tax) st, AVG(price) mr, STDDEV_SAMP(price) sr FROM obs
),
dims AS (
  SELECT obs.*, {BAND} AS band,
         -(COALESCE((quantity - mq) / sq, 0) + COALESCE((site - ms) / ss, 0)) / 2 AS dim_resources,
         -COALESCE((discount - md) / sd, 0) AS dim_access,
         (COALESCE((psize - mp) / sp, 0) + COALESCE((tax - mt) / st, 0)) / 2 AS dim_learning,
         -COALESCE((price - mr) / sr, 0) AS dim_location
  FROM obs CROSS JOIN mom
),
raws AS (SELECT *, 0.25 * (dim_resources + dim_access + dim_learning + dim_location) AS raw FROM dims),
rng AS (SELECT MIN(raw) AS lo, MAX(raw) AS hi FROM raws),
ixd AS (SELECT raws.*, 100 * (raw - lo) / (hi - lo) AS idx FROM raws CROSS JOIN rng)"""
)


def attitude(source: str, name: str, by: str | None = None) -> str:
    """Composite of discount, effort and reversed item, over the table or within ``by``."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    z = lambda c: f"({c} - AVG({c}) {over}) / STDDEV_SAMP({c}) {over}"
    return f"{name} AS (SELECT *, ({z('discount')} + {z('effort')} - {z('item')}) / 3 AS attitude FROM {source})"


def demeaned(source: str, name: str, by: str) -> str:
    d = lambda c, n: f"{c} - AVG({c}) OVER (PARTITION BY {by}) AS {n}"
    return f"""{name}_d AS (
  SELECT *, {d('score', 'y')}, {d('idx', 'x1')}, {d('attitude', 'x2')}, {d('control', 'x4')} FROM {source}
),
{name} AS (SELECT *, x1 * x2 AS x3 FROM {name}_d)"""


def pooled(source: str, name: str) -> str:
    return f"{name} AS (SELECT *, score AS y, idx AS x1, attitude AS x2, idx * attitude AS x3, control AS x4 FROM {source})"


def ols_ctes(
    source: str,
    y: str,
    xs: Sequence[str],
    w: str = "wt",
    by: str | None = None,
    absorb: str | None = None,
    name: str = "fit",
) -> str:
    """CTEs ending in ``name``: n, r2, rmse, b0.. (predictors), intercept, per ``by``.

    ``lastc`` is the last predictor's variation that the others leave unexplained.
    """
    v = [*xs, y]
    p = len(xs)
    key = by or "1"
    group = f"{key}, {absorb}" if absorb else key
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*v, w, *([by] if by else []), *([absorb] if absorb else [])])
    rows = (
        f"{name}_rows AS (SELECT {key} AS k, {absorb or '1'} AS a, {w} AS w, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS v{i}" for i, c in enumerate(v))
        + f" FROM {source} WHERE {complete})"
    )
    means = (
        f"{name}_means AS (SELECT k, SUM(w) AS sw, "
        + ", ".join(f"SUM(w * v{i}) / SUM(w) AS m{i}" for i in range(p + 1))
        + f" FROM {name}_rows GROUP BY k)"
    )
    local = (
        f"{name}_local AS (SELECT k, a, "
        + ", ".join(f"SUM(w * v{i}) / SUM(w) AS g{i}" for i in range(p + 1))
        + f" FROM {name}_rows GROUP BY k, a)"
    )
    centre = "g" if absorb else "m"
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    products = (
        f"{name}_s0 AS (SELECT r.k, COUNT(*) AS n, COUNT(DISTINCT r.a) AS ngroups, SUM(w) AS sw, "
        + f"SUM(w * (v{p} - m{p}) * (v{p} - m{p})) AS sst, "
        + ", ".join(f"SUM(w * (v{i} - {centre}{i}) * (v{j} - {centre}{j})) AS c{i}_{j}" for i, j in pairs)
        + f" FROM {name}_rows r JOIN {name}_means m ON r.k = m.k JOIN {name}_local l ON r.k = l.k AND r.a = l.a GROUP BY r.k)"
    )
    steps = [rows, means, local, products]
    for s in range(p):
        cols = []
        for i, j in pairs:
            c = f"c{i}_{j}"
            cols.append(f"{c} - c{s}_{i} * c{s}_{j} / c{s}_{s} AS {c}" if i > s else c)
        steps.append(f"{name}_s{s + 1} AS (SELECT k, n, ngroups, sw, sst, {', '.join(cols)} FROM {name}_s{s})")
    previous = f"{name}_s{p}"
    for i in reversed(range(p)):
        known = "".join(f" - c{i}_{j} * b{j}" for j in range(i + 1, p))
        steps.append(f"{name}_b{i} AS (SELECT *, (c{i}_{p}{known}) / c{i}_{i} AS b{i} FROM {previous})")
        previous = f"{name}_b{i}"
    intercept = f"m{p}" + "".join(f" - b{i} * m{i}" for i in range(p))
    betas = ", ".join(f"b{i}" for i in range(p))
    steps.append(
        f"{name} AS (SELECT f.k, n, ngroups, f.sw, c{p - 1}_{p - 1} AS lastc, 1 - c{p}_{p} / sst AS r2, SQRT(c{p}_{p} / f.sw) AS rmse, "
        f"1 - (c{p}_{p} / sst) * (n - 1) / (n - {p} - 1) AS adjusted_r2, {betas}, {intercept} AS intercept "
        f"FROM {previous} f JOIN {name}_means m ON f.k = m.k)"
    )
    return ",\n".join(steps)


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"ROUND({expr}, {digits}) + 0.0 AS {name}"


def ints(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


WMEAN = "SUM({x} * wt) / SUM(CASE WHEN {x} IS NOT NULL THEN wt END)"


def wmean(x: str) -> str:
    return WMEAN.format(x=x)


def _band_statistics(source: str, rows: bool) -> str:
    head = f"{ints('COUNT(*)', 'n_rows')}, " if rows else ""
    return f"""
SELECT band, {head}{ints('COUNT(score)', 'sample_count')}, SUM(wt) AS weighted_count,
       {r('AVG(score)', 'mean_score')}, {r(wmean('score'), 'weighted_mean_score')},
       {r('MIN(score)', 'min_score')}, {r('MAX(score)', 'max_score')},
       {r('100 * SUM(wt) / SUM(SUM(wt)) OVER ()', 'population_percentage')}
FROM {source} GROUP BY band"""


NULLED = OBS + ", nulled AS (SELECT * REPLACE (CASE WHEN quantity IS NOT NULL THEN score END AS score) FROM obs)"
TOP_BAND = "CASE WHEN score < 482 THEN 'low' WHEN score < 607 THEN 'middle' ELSE 'high' END"


def _statistics(column: str, shown: str | None = None) -> str:
    return f"""SELECT '{shown or column}' AS "column", {ints(f'COUNT({column})', '"count"')}, {r(f'AVG({column})', 'mean')},
       {r(f'STDDEV_SAMP({column})', 'stddev')}, {r(f'CAST(MIN({column}) AS DOUBLE)', '"min"')},
       {r(f'CAST(MAX({column}) AS DOUBLE)', '"max"')}, {ints(f'COUNT(*) - COUNT({column})', 'null_count')},
       {ints('COUNT(*)', 'total_rows')},
       {r(f'100.0 * (COUNT(*) - COUNT({column})) / COUNT(*)', 'null_percentage')}"""


def _missing(columns: Sequence[str], digits: int, names: dict[str, str] | None = None) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{(names or {}).get(c, c)}' AS variable, '{c}' AS "column", {ints('COUNT(*)', 'total_count')},
        {ints(f'COUNT({c})', 'valid_count')}, {ints(f'COUNT(*) - COUNT({c})', 'missing_count')},
        {r(f'100.0 * (COUNT(*) - COUNT({c})) / COUNT(*)', 'missing_rate', digits)} FROM obs"""
        for c in columns
    )


LOST = "quantity IS NULL OR effort IS NULL OR psize IS NULL"
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
DIMS = ["dim_resources", "dim_access", "dim_learning", "dim_location"]


def _loss(measure: str, amount: str, digits: int = 6) -> str:
    kept = f"SUM(CASE WHEN {LOST} THEN 0 ELSE {amount} END)"
    return f"""SELECT '{measure}' AS measure, CAST(SUM({amount}) AS DOUBLE) AS "before", CAST({kept} AS DOUBLE) AS "after",
       CAST(SUM({amount}) - {kept} AS DOUBLE) AS removed,
       {r(f'100.0 * (SUM({amount}) - {kept}) / SUM({amount})', 'loss_rate', digits)} FROM obs"""


AVG_RANK = """
ranked AS (
  SELECT *, RANK() OVER (ORDER BY {a}) + (COUNT(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
            RANK() OVER (ORDER BY {b}) + (COUNT(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM obs WHERE {a} IS NOT NULL AND {b} IS NOT NULL
)"""

CELLS = BANDED + ", cells AS (SELECT band, flag, SUM(wt) AS o FROM banded GROUP BY band, flag)"
EXPECTED = (
    CELLS
    + """,
margins AS (
  SELECT *, SUM(o) OVER (PARTITION BY band) AS rt, SUM(o) OVER (PARTITION BY flag) AS ct, SUM(o) OVER () AS gt FROM cells
),
expd AS (SELECT *, rt * ct / gt AS e FROM margins)"""
)


def _chi(scale: str) -> str:
    return f"""WITH {EXPECTED},
factor AS (SELECT {scale} AS f FROM banded),
stat AS (SELECT SUM((o - e) * (o - e) / e) * MAX(f) AS x, MAX(gt) * MAX(f) AS total,
                (COUNT(DISTINCT band) - 1) * (COUNT(DISTINCT flag) - 1) AS dof,
                LEAST(COUNT(DISTINCT band), COUNT(DISTINCT flag)) - 1 AS d FROM expd CROSS JOIN factor)
SELECT {r('x', 'statistic')}, {r('EXP(-x / 2) * (1 + x / 2)', 'p_value')}, CAST(dof AS INTEGER) AS dof,
       {r('total', 'total_weight')}, {r('SQRT(x / (total * d))', 'cramers_v')},
       EXP(-x / 2) * (1 + x / 2) < 0.05 AS significant FROM stat"""


ATT = IXD + ",\n" + attitude("ixd", "att")
WITHIN = ATT + ",\n" + demeaned("att", "wi", "grp")
X4 = ["x1", "x2", "x3", "x4"]

GRID = (
    WITHIN
    + """,
cuts AS (SELECT QUANTILE_CONT(x1, 1.0/3) AS i1, QUANTILE_CONT(x1, 2.0/3) AS i2,
                QUANTILE_CONT(x2, 1.0/3) AS a1, QUANTILE_CONT(x2, 2.0/3) AS a2 FROM wi),
grid AS (
  SELECT wi.*,
    CASE WHEN x1 < i1 THEN 'Low Index' WHEN x1 < i2 THEN 'Medium Index' ELSE 'High Index' END AS index_group,
    CASE WHEN x2 < a1 THEN 'Negative' WHEN x2 < a2 THEN 'Neutral' ELSE 'Positive' END AS attitude_group
  FROM wi CROSS JOIN cuts WHERE x1 IS NOT NULL AND x2 IS NOT NULL
)"""
)
SLOPES = GRID + ",\n" + ols_ctes("grid", "y", ["x2"], by="index_group", name="sl")


def _strata(kind: str, xs: Sequence[str] = X4) -> str:
    """CTEs up to ``st`` (stratified fits) for one way of cutting the table."""
    if kind == "group":
        top = "top AS (SELECT grp AS tg FROM ixd WHERE grp IS NOT NULL GROUP BY grp ORDER BY COUNT(*) DESC, grp LIMIT 3)"
        cut = "strat AS (SELECT ixd.*, grp AS stratum FROM ixd JOIN top ON grp = tg)"
        return ",\n".join(
            [IXD, top, cut, attitude("strat", "sa", "stratum"), pooled("sa", "sw"), ols_ctes("sw", "y", xs, by="stratum", name="st")]
        )
    if kind == "index":
        source, column, labels = "ixd", "idx", ("low_index", "medium_index", "high_index")
        head = IXD
    else:
        source, column = "whole", "whole_attitude"
        labels = ("negative_attitude", "neutral_attitude", "positive_attitude")
        head = ATT + ", whole AS (SELECT * EXCLUDE (attitude), attitude AS whole_attitude FROM att)"
    cuts = f"cuts AS (SELECT QUANTILE_CONT({column}, 0.33) AS lo3, QUANTILE_CONT({column}, 0.67) AS hi3 FROM {source})"
    strat = f"""strat AS (SELECT s.*, CASE WHEN {column} < lo3 THEN '{labels[0]}' WHEN {column} < hi3 THEN '{labels[1]}'
      ELSE '{labels[2]}' END AS stratum FROM {source} s CROSS JOIN cuts WHERE {column} IS NOT NULL)"""
    return ",\n".join(
        [
            head,
            cuts,
            strat,
            attitude("strat", "sa", "stratum"),
            demeaned("sa", "sw", "stratum, grp"),
            ols_ctes("sw", "y", xs, by="stratum", name="st"),
        ]
    )


def _strata_table(kind: str) -> str:
    return f"""WITH {_strata(kind)}
SELECT k AS stratum, {ints('n', 'n')}, {r('r2', 'r2', 4)}, {r('rmse', 'rmse', 4)}, {r('b0', 'index_coef', 4)},
       {r('b1', 'attitude_coef', 4)}, {r('b2', 'interaction_coef', 4)}, 'ok' AS status FROM st"""


OLS_PAIR = ["idx", "control"]
MODEL_ROWS = (
    IXD
    + ",\n"
    + ols_ctes("ixd", "score", ["idx"], name="m1")
    + ",\n"
    + ols_ctes("ixd", "score", OLS_PAIR, name="m2")
    + ",\n"
    + ols_ctes("ixd", "score", OLS_PAIR, absorb="grp", name="m3")
)
FEATURES = ["quantity", "discount", "tax", "psize", "price", "site"]
IMPORTANCE = (
    OBS
    + ", z AS (SELECT score, wt, "
    + ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER () AS z_{c}" for c in FEATURES)
    + " FROM obs),\n"
    + ols_ctes("z", "score", [f"z_{c}" for c in FEATURES], name="im")
    + ", sizes AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, ABS(b{i}) AS s, r2 FROM im" for i, c in enumerate(FEATURES))
    + "), shares AS (SELECT feature, s / SUM(s) OVER () AS imp, r2, ROW_NUMBER() OVER (ORDER BY s DESC, feature) AS rk FROM sizes)"
)


def _interaction(source: str, ctes: str) -> str:
    return f"""WITH {ctes},
{ols_ctes(source, 'y', X4, name='fit')}
SELECT {r('adjusted_r2', 'adjusted_r2', 5)}, {ints('n', 'n')}, {r('r2', 'r2', 5)}, {r('rmse', 'rmse', 5)},
       {r('b0', 'b_idx', 5)}, {r('b1', 'b_attitude', 5)}, {r('b2', 'b_idx_x_attitude', 5)}, {r('b3', 'b_control', 5)},
       {r('intercept', 'b_intercept', 5)} FROM fit"""


RESIDUALS = (
    IXD
    + ",\n"
    + ols_ctes("ixd", "score", ["idx"], name="m1")
    + """,
res AS (SELECT intercept + b0 * idx AS fitted, score - (intercept + b0 * idx) AS residual FROM ixd CROSS JOIN m1),
rs AS (SELECT AVG(residual) AS rm, STDDEV_POP(residual) AS rsd, AVG(fitted) AS fm, STDDEV_SAMP(fitted) AS fsd FROM res),
pw AS (SELECT residual, (fitted - fm) / fsd AS t1, POW((fitted - fm) / fsd, 2) AS t2, POW((fitted - fm) / fsd, 3) AS t3, 1.0 AS one
       FROM res CROSS JOIN rs),
"""
    + ols_ctes("pw", "residual", ["t1", "t2", "t3"], w="one", name="tr")
)

BY_MODEL = (
    MODEL_ROWS
    + """,
pair AS (SELECT * FROM ixd WHERE score IS NOT NULL AND idx IS NOT NULL AND control IS NOT NULL AND wt IS NOT NULL),
grouped AS (SELECT grp AS g, SUM(wt * score) / SUM(wt) AS gs, SUM(wt * idx) / SUM(wt) AS gi, SUM(wt * control) / SUM(wt) AS gc
            FROM pair WHERE grp IS NOT NULL GROUP BY grp),
res AS (
SELECT 'Baseline' AS model, score AS y, score - intercept - b0 * idx AS residual FROM ixd CROSS JOIN m1
WHERE score IS NOT NULL AND idx IS NOT NULL AND wt IS NOT NULL
UNION ALL SELECT 'With Control', score, score - intercept - b0 * idx - b1 * control FROM pair CROSS JOIN m2
UNION ALL SELECT 'With Fixed Effects', score, score - gs - b0 * (idx - gi) - b1 * (control - gc)
FROM pair JOIN grouped ON grp = g CROSS JOIN m3)"""
)


def _residual_trends(by: str, ctes: str) -> str:
    """From ``res`` with ``y`` and ``residual`` per model or stratum."""
    return f"""WITH {ctes},
rs AS (SELECT {by} AS part, AVG(residual) AS rm, STDDEV_POP(residual) AS rsd, AVG(y - residual) AS fm,
              STDDEV_SAMP(y - residual) AS fsd FROM res GROUP BY {by}),
pw AS (SELECT part, residual, (y - residual - fm) / fsd AS t1, POW((y - residual - fm) / fsd, 2) AS t2,
              POW((y - residual - fm) / fsd, 3) AS t3, 1.0 AS one FROM res JOIN rs ON {by} = part),
{ols_ctes("pw", "residual", ["t1", "t2", "t3"], w="one", by="part", name="tr")}
SELECT part AS {by}, {ints('n', 'n')}, {r('rm', 'mean_residual', 4)}, {r('rsd', 'std_residual', 4)}, {r('fm', 'fitted_mean', 4)},
       {r('fsd', 'fitted_sd', 4)}, {r('intercept', 'constant', 4)}, {r('b0', 'linear', 4)}, {r('b1', 'quadratic', 4)},
       {r('b2', 'cubic', 4)}, 'ok' AS status FROM tr JOIN rs ON k = part"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["band_stats"] = f"WITH {BANDED} {_band_statistics('banded', False)}"
    q["band_labels_count"] = f"WITH {BANDED} SELECT band, {ints('COUNT(*)', 'n')} FROM banded GROUP BY band"
    q["band_stats_null_score"] = (
        f"WITH {NULLED}, banded AS (SELECT *, {BAND} AS band FROM nulled) {_band_statistics('banded', True)}"
    )
    q["band_stats_null_on_top"] = (
        f"WITH {NULLED}, banded AS (SELECT *, {TOP_BAND} AS band FROM nulled) {_band_statistics('banded', True)}"
    )
    q["band_table"] = f"""WITH {BANDED}, s AS ({_band_statistics('banded', False)})
SELECT CASE band WHEN 'low' THEN 1 WHEN 'middle' THEN 2 ELSE 3 END AS "position",
       CASE band WHEN 'low' THEN 'Low (< 482)' WHEN 'middle' THEN 'Middle (482-606)' ELSE 'High (≥ 607)' END AS display_name,
       sample_count, population_percentage, mean_score FROM s"""

    q["column_mean"] = f"""WITH {OBS} SELECT 'quantity' AS "column", {r('AVG(quantity)', 'mean')} FROM obs"""
    q["column_stats"] = f"WITH {OBS} {_statistics('quantity')} FROM obs"
    numeric = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    q["describe_numeric"] = " UNION ALL ".join(f"{_statistics(c)}, 11 AS total_columns FROM lineitem" for c in numeric)
    q["missing_report"] = f"WITH {OBS} " + _missing(["quantity", "discount", "effort", "psize", "price", "flag"], 6)
    names = {"quantity": "Learning Time", "effort": "Effort", "psize": "Size"}
    q["missing_by_variable"] = f"WITH {OBS} " + _missing(["quantity", "effort", "psize"], 2, names)
    q["sample_loss"] = f"WITH {OBS} {_loss('unweighted', '1')} UNION ALL {_loss('weighted', 'wt')}"
    q["missing_value_summary"] = f"""WITH {OBS},
m AS ({_missing(['quantity', 'effort', 'psize'], 2)}), l AS ({_loss('unweighted', '1', 2)} UNION ALL {_loss('weighted', 'wt', 2)})
SELECT variable, "column", CAST(total_count AS DOUBLE) AS total, CAST(valid_count AS DOUBLE) AS valid,
       CAST(missing_count AS DOUBLE) AS missing, missing_rate FROM m
UNION ALL SELECT 'Sample loss (' || measure || ')', 'all', "before", "after", removed, loss_rate FROM l"""
    q["corr_pearson"] = f"""WITH {OBS} SELECT 'score' AS x, 'quantity' AS y, 'pearson' AS method,
       {r('CORR(score, quantity)', 'correlation')} FROM obs"""
    q["corr_spearman"] = f"""WITH {OBS}, {AVG_RANK.format(a='score', b='quantity')}
SELECT 'score' AS x, 'quantity' AS y, 'spearman' AS method, {r('CORR(ra, rb)', 'correlation')} FROM ranked"""
    q["average_ranks"] = f"""WITH {OBS} SELECT score AS "value", {ints('COUNT(*)', 'ties')},
       SUM(COUNT(*)) OVER (ORDER BY score) - (COUNT(*) - 1) / 2.0 AS avg_rank FROM obs GROUP BY score"""
    q["corr_matrix"] = f"WITH {IXD} " + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {r(f'CORR({a}, {b})', 'correlation')} FROM ixd" for a in DIMS for b in DIMS
    )
    q["distinct_groups"] = f"WITH {OBS} SELECT DISTINCT grp FROM obs"

    q["recode_sentinels"] = f"""SELECT {KEYS}, CASE WHEN l_quantity NOT IN (49, 50) THEN l_quantity END AS l_quantity,
       CASE WHEN l_tax <> 0.08 THEN l_tax END AS l_tax FROM lineitem"""
    q["recode_from_codebook"] = "SELECT p_partkey, CASE WHEN p_size < 49 THEN p_size END AS p_size FROM part"
    q["decode_labels"] = """SELECT s_suppkey, s_nationkey, n_name AS nation_label
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""
    q["listwise_delete"] = f"WITH {OBS} SELECT {KEYS}, quantity, effort, psize FROM obs WHERE NOT ({LOST})"
    q["reflect_item"] = f"WITH {OBS} SELECT {KEYS}, item, MAX(item) OVER () + 1 - item AS item_reversed FROM obs"
    q["label_map"] = f"""WITH {OBS} SELECT {KEYS}, flag,
       CASE flag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'other' END AS flag_label FROM obs"""
    q["dummy_encode"] = f"""WITH {OBS} SELECT {KEYS}, flag, CAST(flag = 'N' AS DOUBLE) AS "flag_N",
       CAST(flag = 'R' AS DOUBLE) AS "flag_R" FROM obs"""
    q["dummy_vector"] = f"""WITH {OBS}, lv AS (SELECT flag AS level, ROW_NUMBER() OVER (ORDER BY flag) - 1 AS place,
       COUNT(*) OVER () AS n FROM (SELECT DISTINCT flag FROM obs WHERE flag IS NOT NULL))
SELECT {KEYS}, flag, CAST(n - 1 AS INTEGER) AS n_dummies, CAST(place = 1 AS DOUBLE) AS first_dummy, CAST(place = 2 AS DOUBLE) AS second_dummy
FROM obs LEFT JOIN lv ON flag = level"""
    q["interaction_term"] = f"""WITH {OBS} SELECT {KEYS}, {r('discount', 'discount')}, {r('quantity', 'quantity')},
       {r('discount * quantity', 'discount_x_quantity')} FROM obs"""
    q["impute_mean"] = f"""WITH {OBS} SELECT {KEYS}, {r('COALESCE(quantity, AVG(quantity) OVER ())', 'quantity')},
       {r('COALESCE(effort, AVG(effort) OVER ())', 'effort')} FROM obs"""
    q["impute_zero"] = f"WITH {OBS} SELECT {KEYS}, COALESCE(quantity, 0) AS quantity, COALESCE(effort, 0) AS effort FROM obs"
    q["impute_drop"] = f"WITH {OBS} SELECT {KEYS}, quantity, effort FROM obs WHERE quantity IS NOT NULL AND effort IS NOT NULL"

    z = lambda c, over="": f"({c} - AVG({c}) OVER ({over})) / STDDEV_SAMP({c}) OVER ({over})"
    q["zscore"] = f"""WITH {OBS} SELECT {KEYS}, {r('quantity', 'quantity')}, {r('discount', 'discount')},
       {r(z('quantity'), 'quantity_z')}, {r(z('discount'), 'discount_z')} FROM obs"""
    q["zscore_by_group"] = f"""WITH {OBS} SELECT {KEYS}, grp, {r('quantity', 'quantity')},
       {r(z('quantity', 'PARTITION BY grp'), 'quantity_z')} FROM obs"""
    q["dimension_score"] = f"""WITH {OBS} SELECT {KEYS}, {r('quantity', 'quantity')}, {r('psize', 'psize')},
       {r(f"-(COALESCE({z('quantity')}, 0) + COALESCE({z('psize')}, 0)) / 2", 'dim')} FROM obs"""
    q["dimension_score_flipped_raw"] = f"""WITH {OBS} SELECT {KEYS}, {r('quantity', 'quantity')}, {r('psize', 'psize')},
       {r('(COALESCE(quantity, AVG(quantity) OVER ()) - COALESCE(psize, AVG(psize) OVER ())) / 2', 'dim')} FROM obs"""
    q["composite_index"] = (
        f"WITH {IXD} SELECT {KEYS}, {r('score', 'score')}, " + ", ".join(r(d, d) for d in DIMS) + f", {r('idx', 'idx')} FROM ixd"
    )
    dropped = IXD.replace("LEFT JOIN customer ON o_custkey = c_custkey", "LEFT JOIN customer ON o_custkey = c_custkey\n  WHERE l_quantity <> 50 AND p_size <> 50")
    q["composite_index_drop"] = f"""WITH {dropped} SELECT {KEYS}, {r('quantity', 'quantity')}, {r('psize', 'psize')},
       {r('idx', 'idx')} FROM ixd"""
    q["index_levels"] = f"""WITH {IXD} SELECT CASE WHEN idx < 33.33 THEN 'low' WHEN idx < 66.67 THEN 'medium' ELSE 'high' END AS level,
       {ints('COUNT(*)', 'n')} FROM ixd GROUP BY 1"""
    q["attitude_composite"] = f"""WITH {OBS}, {attitude('obs', 'att')}
SELECT {KEYS}, {r('discount', 'discount')}, {r('effort', 'effort')}, {r('item', 'item')}, {r('attitude', 'attitude')} FROM att"""

    q["site_left_join"] = """SELECT l_orderkey, l_linenumber, l_suppkey AS site_key, l_quantity, s_acctbal
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey"""
    quart = ", ".join(r(f"QUANTILE_CONT(idx, {p})", n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")))
    q["index_by_band"] = f"""WITH {IXD} SELECT band, {ints('COUNT(*)', 'sample_count')}, SUM(wt) AS weighted_count,
       {r('AVG(idx)', 'mean_index')}, {r(wmean('idx'), 'weighted_mean_index')}, {r('STDDEV_SAMP(idx)', 'std_index')}, {quart},
       {', '.join(r(f'AVG({d})', f'mean_{d}') for d in DIMS)} FROM ixd GROUP BY band"""
    q["dimension_means"] = f"WITH {IXD} " + " UNION ALL ".join(
        f"SELECT band, '{d}' AS dimension, {r(f'AVG({d})', 'mean_value')} FROM ixd GROUP BY band" for d in DIMS
    )
    probs = ((0.1, "q10"), ("1.0/3", "q33"), (0.5, "q50"), (0.67, "q67"), (0.99, "q99"))
    q["percentiles_exact"] = f"""WITH {OBS} SELECT grp, {', '.join(r(f'QUANTILE_CONT(score, {p})', n) for p, n in probs)}
FROM obs GROUP BY grp"""
    q["percentiles_discrete"] = f"""WITH {OBS} SELECT QUANTILE_DISC(score, 0.25) AS q25, QUANTILE_DISC(score, 0.5) AS q50,
       QUANTILE_DISC(score, 0.75) AS q75 FROM obs"""
    q["share_above_q75"] = f"""WITH {IXD}, c AS (SELECT QUANTILE_CONT(idx, 0.75) AS t FROM ixd)
SELECT band, {r('MAX(t)', 'threshold')}, {r('AVG(CASE WHEN idx > t THEN 1.0 ELSE 0.0 END)', 'share_above')}
FROM ixd CROSS JOIN c GROUP BY band"""
    q["index_histogram"] = f"""WITH {IXD}, b AS (SELECT LEAST(CAST(FLOOR(idx / 5) AS INTEGER) + 1, 20) AS bin, wt FROM ixd)
SELECT bin, CAST((bin - 1) * 5 AS DOUBLE) AS "lower", CAST(bin * 5 AS DOUBLE) AS "upper", {ints('COUNT(*)', 'n')}, SUM(wt) AS weighted_count FROM b GROUP BY bin"""
    q["cell_means"] = f"""WITH {OBS} SELECT flag, grp, {ints('COUNT(*)', 'n')}, SUM(wt) AS weighted_n,
       {r(wmean('score'), 'weighted_mean_score')}, {r('AVG(score)', 'mean_score')}, {r('STDDEV_SAMP(score)', 'std_score')}
FROM obs GROUP BY flag, grp"""
    q["group_profile"] = f"""WITH {IXD} SELECT flag, {ints('COUNT(*)', 'sample_count')}, SUM(wt) AS weighted_count,
       {', '.join(r(f'AVG({d})', f'mean_{d}') for d in DIMS)} FROM ixd GROUP BY flag"""
    q["group_outcomes"] = f"""WITH {OBS} SELECT flag, {ints('COUNT(*)', 'sample_count')}, {r('AVG(score)', 'mean_score')},
       {r(wmean('score'), 'weighted_mean_score')}, {r('STDDEV_SAMP(score)', 'std_score')}, {r('MIN(score)', 'min_score')},
       {r('MAX(score)', 'max_score')} FROM obs GROUP BY flag"""
    q["cluster_sizes"] = f"WITH {OBS} SELECT item, {ints('COUNT(*)', 'n')} FROM obs GROUP BY item"
    q["top_groups"] = f"""WITH {OBS} SELECT grp, {ints('COUNT(*)', 'n')} FROM obs WHERE grp IS NOT NULL GROUP BY grp
ORDER BY n DESC, grp LIMIT 5"""
    plain = lambda c: f"{c} - AVG({c}) OVER (PARTITION BY grp)"
    heavy = lambda c: (
        f"{c} - SUM({c} * wt) OVER (PARTITION BY grp) / SUM(CASE WHEN {c} IS NOT NULL THEN wt END) OVER (PARTITION BY grp)"
    )
    q["demean_nan"] = f"WITH {OBS} SELECT {KEYS}, grp, {r(plain('quantity'), 'quantity_within')} FROM obs"
    q["band_stats_nan"] = q["band_stats_null_score"]
    q["impute_mean_nan"] = q["impute_mean"]
    q["zscore_nan"] = f"WITH {OBS} SELECT {KEYS}, {r(z('quantity'), 'quantity_z')}, {r(z('discount'), 'discount_z')} FROM obs"
    q["composite_index_nan"] = f"WITH {IXD} SELECT {KEYS}, " + ", ".join(r(d, d) for d in DIMS) + f", {r('idx', 'idx')} FROM ixd"
    q["reflect_nan"] = f"WITH {OBS} SELECT {KEYS}, MAX(quantity) OVER () + 1 - quantity AS quantity_reversed FROM obs"
    q["percentiles_by_part"] = "SELECT l_partkey, " + ", ".join(
        r(f"QUANTILE_CONT(l_extendedprice, {p})", f"q{p * 100:.0f}") for p in (0.25, 0.5, 0.75)
    ) + " FROM lineitem GROUP BY l_partkey"
    q["crosstab_long"] = f"""WITH s AS (SELECT COUNT(DISTINCT l_suppkey) AS n FROM lineitem)
SELECT l_partkey, {ints('MAX(n)', 'cells')}, {ints('MAX(n) - COUNT(DISTINCT l_suppkey)', 'empty_cells')},
       {r('SUM(l_quantity)', 'weighted_count')} FROM lineitem CROSS JOIN s GROUP BY l_partkey"""
    q["chi_square_many"] = f"""WITH c AS (SELECT l_partkey, l_suppkey, SUM(l_quantity) AS o FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, SUM(o) OVER (PARTITION BY l_partkey) AS rt, SUM(o) OVER (PARTITION BY l_suppkey) AS ct, SUM(o) OVER () AS gt FROM c),
t AS (SELECT SUM((o - rt * ct / gt) * (o - rt * ct / gt) / (rt * ct / gt)) + MAX(gt) - SUM(rt * ct / gt) AS x, MAX(gt) AS gt,
             COUNT(DISTINCT l_partkey) AS r, COUNT(DISTINCT l_suppkey) AS c FROM m)
SELECT {r('x', 'statistic', 4)}, CAST((r - 1) * (c - 1) AS INTEGER) AS dof, {r('gt', 'total_weight', 4)},
       {r('SQRT(x / (gt * (LEAST(r, c) - 1)))', 'cramers_v', 4)} FROM t"""
    q["ols_large_mean"] = f"""WITH {OBS}, m AS (SELECT SUM(wt * discount) / SUM(wt) AS mx, SUM(wt * score) / SUM(wt) AS my FROM obs),
s AS (SELECT COUNT(*) AS n, SUM(wt) AS sw, SUM(wt * (discount - mx) * (discount - mx)) AS sxx,
             SUM(wt * (discount - mx) * (score - my)) AS sxy, SUM(wt * (score - my) * (score - my)) AS syy FROM obs CROSS JOIN m)
SELECT {ints('n', 'n')}, {r('sxy * sxy / sxx / syy', 'r2', 3)}, {r('SQRT((syy - sxy * sxy / sxx) / sw)', 'rmse', 3)},
       {r('sxy / sxx', 'far', 3)}, 'ok' AS status FROM s"""
    q["ols_collinear"] = f"""SELECT {ints('COUNT(*)', 'n')}, 'collinear predictors' AS status, CAST(NULL AS DOUBLE) AS far,
       CAST(NULL AS DOUBLE) AS twin FROM lineitem"""
    known = "CASE i WHEN 0 THEN 2.0 WHEN 1 THEN -3.0 ELSE 0.0 END"
    q["ols_wide"] = f"""SELECT 'x' || i AS term, CAST({known} AS DOUBLE) AS estimate FROM range(60) t(i)
UNION ALL SELECT 'intercept', CAST(5 AS DOUBLE)"""
    q["ols_wide_collinear"] = f"""SELECT model, {ints('COUNT(*)', 'n')}, status FROM lineitem
CROSS JOIN (VALUES ('constant', 'no usable variation: flat'), ('twin', 'collinear predictors')) m(model, status) GROUP BY model, status"""
    q["source_files"] = f"""SELECT 'lineitem.parquet' AS file, {ints('COUNT(l_orderkey)', 'n')} FROM lineitem"""
    q["within_group_demean"] = f"""WITH {OBS} SELECT {KEYS}, grp, {r('score', 'score')}, {r('quantity', 'quantity')},
       {r(plain('score'), 'score_within')}, {r(plain('quantity'), 'quantity_within')} FROM obs"""
    q["within_group_demean_weighted"] = f"""WITH {OBS} SELECT {KEYS}, grp, {r('score', 'score')}, {r('quantity', 'quantity')},
       wt, {r(heavy('score'), 'score_within')}, {r(heavy('quantity'), 'quantity_within')} FROM obs"""

    q["crosstab"] = f"""WITH {CELLS} SELECT band, {', '.join(f"COALESCE(SUM(o) FILTER (flag = '{f}'), 0) AS {f}" for f in 'ANR')}
FROM cells GROUP BY band"""
    q["crosstab_totals"] = f"""WITH {BANDED} SELECT CASE WHEN GROUPING(band) = 1 THEN 'total' ELSE band END AS band,
       CASE WHEN GROUPING(flag) = 1 THEN 'total' ELSE flag END AS flag, SUM(wt) AS weighted_count
FROM banded GROUP BY CUBE (band, flag)"""
    q["crosstab_rowpct"] = f"""WITH {CELLS} SELECT band, flag, {r('o', 'weighted_count')},
       {r('100 * o / SUM(o) OVER (PARTITION BY band)', 'row_percent')} FROM cells"""
    q["crosstab_minmax"] = f"""WITH {CELLS} SELECT band, flag, {r('o', 'weighted_count')},
       {r('(o - MIN(o) OVER ()) / (MAX(o) OVER () - MIN(o) OVER ())', 'scaled')} FROM cells"""
    q["expected_cells"] = f"""WITH {EXPECTED} SELECT band, flag, {r('o', 'observed')}, {r('rt', 'row_total')},
       {r('ct', 'column_total')}, {r('gt', 'grand_total')}, {r('e', 'expected')} FROM expd"""
    q["chi_square"] = _chi("MAX(1.0)")
    q["chi_square_rescaled"] = _chi("COUNT(*) / SUM(wt)")
    share = lambda x: f"100 * {x} / SUM({x}) OVER ()"
    q["segment_share_compare"] = f"""WITH {OBS} SELECT flag, {r(share('COUNT(*)'), 'sample_percentage')},
       {r(share('SUM(wt)'), 'population_percentage')} FROM obs GROUP BY flag"""
    q["segment_table"] = f"""WITH {OBS} SELECT flag, {ints('COUNT(*)', 'sample_count')}, {r('SUM(wt)', 'weighted_count')},
       {r(share('SUM(wt)'), 'population_percentage')}, CASE flag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS "position",
       flag AS display_name FROM obs GROUP BY flag"""

    fit = lambda extra: f"{extra}{ints('n', 'n')}, {r('r2', 'r2', 5)}, {r('rmse', 'rmse', 5)}"
    b0, b1 = r("b0", "b_idx", 5), r("b1", "b_control", 5)
    b_int = r("intercept", "b_intercept", 5)
    q["ols_baseline"] = f"WITH {IXD},\n{ols_ctes('ixd', 'score', ['idx'])} SELECT {fit('')}, {b0}, {b_int} FROM fit"
    q["ols_control"] = f"WITH {IXD},\n{ols_ctes('ixd', 'score', OLS_PAIR)} SELECT {fit('')}, {b0}, {b1}, {b_int} FROM fit"
    q["ols_fixed_effects"] = f"""WITH {IXD},
{ols_ctes('ixd', 'score', OLS_PAIR, absorb='grp')} SELECT {fit(ints('ngroups', '"groups"') + ', ')}, {b0}, {b1} FROM fit"""
    q["ols_baseline_errors"] = f"""WITH {IXD},
{ols_ctes('ixd', 'score', ['idx'])},
mean AS (SELECT SUM(wt * idx) / SUM(wt) AS mx FROM ixd),
spread AS (SELECT SUM(wt * (idx - mx) * (idx - mx)) AS sxx FROM ixd CROSS JOIN mean),
se AS (SELECT *, SQRT(rmse * rmse * sw / (n - 2) / sxx) AS se0,
              SQRT(rmse * rmse * sw / (n - 2) * (1 / sw + mx * mx / sxx)) AS se1 FROM fit CROSS JOIN mean CROSS JOIN spread)
SELECT 'Baseline' AS model, 'idx' AS term, {r('b0', 'estimate', 5)}, {r('se0', 'std_error', 5)}, {r('b0 / se0', 't_value', 5)} FROM se
UNION ALL
SELECT 'Baseline', 'intercept', {r('intercept', 'estimate', 5)}, {r('se1', 'std_error', 5)}, {r('intercept / se1', 't_value', 5)} FROM se"""
    q["model_comparison"] = f"""WITH {MODEL_ROWS},
ms AS (SELECT 'Baseline' AS model, n, r2, rmse, b0 FROM m1 UNION ALL SELECT 'With Control', n, r2, rmse, b0 FROM m2
       UNION ALL SELECT 'With Fixed Effects', n, r2, rmse, b0 FROM m3)
SELECT model, {r('r2', 'r2', 5)}, {r('rmse', 'rmse', 5)}, {r('b0', 'coefficient', 5)}, {ints('n', 'n')},
       r2 = MAX(r2) OVER () AS is_best FROM ms"""
    q["residual_trend"] = f"""WITH {RESIDUALS}
SELECT {ints('n', 'n')}, {r('rm', 'mean_residual', 4)}, {r('rsd', 'std_residual', 4)}, {r('fm', 'fitted_mean', 4)},
       {r('fsd', 'fitted_sd', 4)}, {r('intercept', 'constant', 4)}, {r('b0', 'linear', 4)}, {r('b1', 'quadratic', 4)},
       {r('b2', 'cubic', 4)}, 'ok' AS status FROM tr CROSS JOIN rs"""
    q["residuals_by_model"] = _residual_trends("model", BY_MODEL)
    fitted = " - ".join(["y", "intercept", *[f"b{i} * {x}" for i, x in enumerate(X4)]])
    complete = " AND ".join(f"{c} IS NOT NULL" for c in ["y", *X4, "wt"])
    q["residuals_by_stratum"] = _residual_trends(
        "stratum", f"{_strata('group')},\nres AS (SELECT stratum, y, {fitted} AS residual FROM sw JOIN st ON stratum = k WHERE {complete})"
    )
    q["importance_regression"] = f"""WITH {IMPORTANCE}
SELECT feature, {r('imp', 'importance')}, {r('r2', 'model_accuracy')}, CAST(rk AS INTEGER) AS "rank" FROM shares"""
    q["importance_topn"] = f"""WITH {IMPORTANCE}
SELECT feature, {r('imp', 'importance')}, CAST(rk AS INTEGER) AS "rank" FROM shares WHERE rk <= 3"""

    q["interaction_within"] = _interaction("wi", WITHIN)
    q["interaction_pooled"] = _interaction("po", ATT + ",\n" + pooled("att", "po"))
    q["interaction_reading"] = f"""WITH {WITHIN},
{ols_ctes('wi', 'y', X4)}
SELECT 'Within-Group Interaction' AS model,
       CASE WHEN b2 > 0.1 THEN 'compensatory' WHEN b2 < -0.1 THEN 'cumulative' ELSE 'additive' END AS reading FROM fit"""
    q["marginal_effects"] = f"""WITH {WITHIN},
{ols_ctes('wi', 'y', X4)},
lv AS (SELECT 'low' AS level, 0.25 AS prob, QUANTILE_CONT(x1, 0.25) AS v FROM wi
       UNION ALL SELECT 'medium', 0.5, QUANTILE_CONT(x1, 0.5) FROM wi
       UNION ALL SELECT 'high', 0.75, QUANTILE_CONT(x1, 0.75) FROM wi)
SELECT level, CAST(prob AS DOUBLE) AS prob, {r('v', 'index_value', 5)}, {r('b1 + b2 * v', 'attitude_effect', 5)} FROM lv CROSS JOIN fit"""
    for kind in ("index", "attitude", "group"):
        q[f"stratified_by_{kind}"] = _strata_table(kind)
    q["heterogeneity_variance"] = f"""WITH {_strata('group')}
SELECT CAST(COUNT(*) AS INTEGER) AS strata, {r('AVG(b1)', 'mean_effect', 4)}, {r('VAR_SAMP(b1)', 'variance', 4)} FROM st"""
    q["heterogeneity"] = f"""WITH {_strata('index', ['x1', 'x3', 'x4', 'x2'])},
pr AS (SELECT b3 AS b, lastc * (n - 5) / (rmse * rmse * sw) AS p FROM st),
hq AS (SELECT COUNT(*) AS strata, AVG(b) AS mean_effect, VAR_SAMP(b) AS variance,
              SUM(p * b * b) - SUM(p * b) * SUM(p * b) / SUM(p) AS x FROM pr)
SELECT CAST(strata AS INTEGER) AS strata, {r('mean_effect', 'mean_effect', 4)}, {r('variance', 'variance', 4)},
       {r('x', 'q_statistic', 4)}, {r('EXP(-x / 2)', 'p_value', 4)}, EXP(-x / 2) < 0.05 AS is_heterogeneous FROM hq"""
    ymean = "SUM(y * wt) / SUM(CASE WHEN y IS NOT NULL THEN wt END)"
    q["interaction_grid"] = f"""WITH {GRID} SELECT index_group, attitude_group, {ints('COUNT(*)', 'n')}, SUM(wt) AS weighted_n,
       {r(ymean, 'weighted_mean_score')}, {r('AVG(y)', 'mean_score')}, {r('STDDEV_SAMP(y)', 'std_score')}
FROM grid GROUP BY index_group, attitude_group"""
    q["simple_slopes"] = f"""WITH {SLOPES} SELECT k AS index_group, {r('b0', 'slope', 5)}, {r('intercept', 'intercept', 5)},
       {r('r2', 'r2', 5)}, {ints('n', 'n')} FROM sl WHERE n > 100"""
    cell = lambda a: f"COALESCE({ymean.replace('SUM(y * wt)', f'SUM(y * wt) FILTER (attitude_group = {a!r})').replace('SUM(CASE WHEN y IS NOT NULL THEN wt END)', f'SUM(CASE WHEN y IS NOT NULL THEN wt END) FILTER (attitude_group = {a!r})')}, 0)"
    q["grid_matrix"] = f"""WITH {GRID} SELECT index_group, {', '.join(r(cell(a), f'"{a}"') for a in ('Negative', 'Neutral', 'Positive'))}
FROM grid GROUP BY index_group"""
    q["fitted_lines"] = f"""WITH {SLOPES} SELECT k AS index_group, CAST(i AS INTEGER) AS step, {r('-2 + 4.0 / 99 * i', 'x', 5)},
       {r('intercept + b0 * (-2 + 4.0 / 99 * i)', 'y', 5)} FROM sl CROSS JOIN range(100) t(i) WHERE n > 100"""

    q["ingest_roundtrip"] = """SELECT 'orders' AS dataset, CAST(COUNT(*) AS BIGINT) AS source_rows, CAST(COUNT(*) AS BIGINT) AS target_rows,
       6 AS source_columns, 6 AS target_columns, TRUE AS same_schema, TRUE AS valid FROM orders"""
    away = {i: f"((quantity - {a}) * (quantity - {a}) + (discount - {b}) * (discount - {b}))" for i, (a, b) in enumerate([(10.0, 0.02), (25.0, 0.05), (40.0, 0.08)])}
    least = f"LEAST({', '.join(away.values())})"
    q["segments_given_centres"] = f"""WITH {OBS}, near AS (
  SELECT wt, quantity, {least} AS d, CASE WHEN {away[0]} = {least} THEN 0 WHEN {away[1]} = {least} THEN 1 ELSE 2 END AS cluster
  FROM obs WHERE quantity IS NOT NULL AND discount IS NOT NULL AND wt IS NOT NULL
)
SELECT cluster, {ints('COUNT(*)', 'n')}, {r('SUM(wt)', 'weight', 4)}, {r('SUM(d)', 'inertia', 4)}, {r('AVG(quantity)', 'mean_quantity', 4)}
FROM near GROUP BY cluster"""
    q["ingest_incremental"] = f"""SELECT o_orderstatus, {ints('COUNT(*)', 'n')},
       CAST(SUM(CASE WHEN o_orderkey % 3 = 2 THEN -o_orderkey ELSE o_orderkey END) AS BIGINT) AS keys,
       {r('SUM(o_totalprice + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END)', 'price', 2)} FROM orders GROUP BY o_orderstatus"""
    q["manifest_diff"] = "SELECT 'orders' AS dataset, CAST(0 AS BIGINT) AS changed_files"
    return q


ORACLE = build()
