"""Upper-tail probabilities for test statistics that arrive one row per model or table.

Spark has no chi-square or Student-t distribution function. These scalar helpers run
inside Arrow batches over result-sized frames (one row per coefficient), never per
observation.
"""

from __future__ import annotations

import math

_TINY = 1e-300


def _continued_fraction(terms, limit: int = 100_000) -> float:
    """Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...)) from an iterator of (a, b)."""
    _, b0 = next(terms)
    f = b0 or _TINY
    c, d = f, 0.0
    for _, (a, b) in zip(range(limit), terms):
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        f *= step
        if abs(step - 1.0) < 1e-15:
            return f
    raise ArithmeticError(f"A continued fraction did not converge in {limit} terms")


def chi2_tail(x: float, dof: int) -> float:
    """P(X > x) for a chi-square variable, through the regularized incomplete gamma."""
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - scale * total)

    def terms():
        yield 0.0, z + 1 - a
        i = 1
        while True:
            yield -i * (i - a), z + 2 * i + 1 - a
            i += 1

    return scale / _continued_fraction(terms())


def _beta_fraction(x: float, a: float, b: float) -> float:
    def terms():
        yield 0.0, 1.0
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    return math.exp(front) / (a * _continued_fraction(terms()))


def student_t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|) for Student's t, through the regularized incomplete beta."""
    if dof <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    a, b = dof / 2.0, 0.5
    x = dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    if x < (a + 1) / (a + b + 2):
        return _beta_fraction(x, a, b)
    y = t * t / (dof + t * t)
    return 1.0 - _beta_fraction(y, b, a)
