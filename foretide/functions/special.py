"""Student-t and normal functions as column expressions: built-ins only, so they stay inside generated code."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
#: Terms of Stirling's series of ln gamma, in 1/z, 1/z^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
#: The asymptotic series of digamma in 1/z^2, 1/z^4, ...
DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
SHIFT = 8
NODES, WEIGHTS = np.polynomial.legendre.leggauss(32)


def _series(z: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in reversed(terms):
        out = out / (z * z) + c
    return out


def ln_gamma(x: Column) -> Column:
    """For x > 0: Stirling's series at x + SHIFT, and back by the recurrence."""
    z, product = x + SHIFT, F.lit(1.0)
    for i in range(SHIFT):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + HALF_LN_2PI + _series(z, STIRLING) / z - F.log(product)


def ln_beta(a: Column, b: Column) -> Column:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)


def digamma(x: Column) -> Column:
    z, back = x + SHIFT, F.lit(0.0)
    for i in range(SHIFT):
        back = back + 1 / (x + i)
    return F.log(z) - 0.5 / z + _series(z, DIGAMMA) / (z * z) - back


def t_logpdf(x: Column, nu: Column) -> Column:
    """Null unless nu > 0 is finite and x a number."""
    value = -(nu + 1) / 2 * F.log1p(x * x / nu) - F.log(nu) / 2 - ln_beta(nu / 2, F.lit(0.5))
    return F.when((nu > 0) & (nu < float("inf")) & ~F.isnan(x), value)


def _cosine_integral(low: Column, high: Column, nu: Column) -> Column:
    """Integral of cos(theta)^(nu - 1) from low to high, by 32 Gauss-Legendre points."""
    half, middle = (high - low) / 2, (high + low) / 2
    total = F.lit(0.0)
    for node, weight in zip(NODES.tolist(), WEIGHTS.tolist()):
        total = total + weight * F.exp((nu - 1) * F.log(F.cos(middle + half * node)))
    return half * total


def t_cdf(x: Column, nu: Column) -> Column:
    """Student's t distribution function; nu is any positive number."""
    angle = F.least(F.atan(F.abs(x) / F.sqrt(nu)), 9 / F.sqrt(nu))
    part = _cosine_integral(F.lit(0.0), angle, nu) * F.exp(-ln_beta(nu / 2, F.lit(0.5)))
    # no branch around the sum: common parts are then worked out once
    return F.nanvl(0.5 + F.signum(x) * F.least(part, F.lit(0.5)), F.lit(None).cast("double"))


def t_crps(x: Column, nu: Column) -> Column:
    """Continuous ranked probability score of a standard t; times the scale for a scaled one. Needs nu > 1."""
    density, below = F.exp(t_logpdf(x, nu)), t_cdf(x, nu)
    spread = 2 * F.sqrt(nu) / (nu - 1) * F.exp(ln_beta(F.lit(0.5), nu - 0.5) - 2 * ln_beta(F.lit(0.5), nu / 2))
    return F.when(nu > 1, 2 * density * (nu + x * x) / (nu - 1) + x * (2 * below - 1) - spread)


def t_entropy(nu: Column, textbook: bool = False) -> Column:
    """Entropy of a standard t. The reference values have (nu - 1)/2 before the digammas, textbooks (nu + 1)/2."""
    front = (nu + 1 if textbook else nu - 1) / 2
    return front * (digamma((nu + 1) / 2) - digamma(nu / 2)) + F.log(nu) / 2 + ln_beta(nu / 2, F.lit(0.5))


#: Coefficients of a rational approximation of the normal quantile (relative error under 1.2E-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(x, terms):
    out = terms[0]
    for c in terms[1:]:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal; null outside (0, 1)."""
    q, tail = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    centre = _horner(q * q, _A) * q / _horner(q * q, _B)
    outer = _horner(tail, _C) / _horner(tail, _D)
    value = F.when((p >= 0.02425) & (p <= 0.97575), centre).when(p < 0.5, outer).otherwise(-outer)
    return F.when((p > 0) & (p < 1), value)


def t_ppf_value(p: float, nu: float) -> float:
    """Quantile of t for constants, by bisection on the driver."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf_value(mid, nu) < p else (lo, mid)
    return (lo + hi) / 2


def t_cdf_value(x: float, nu: float) -> float:
    angle = min(math.atan(abs(x) / math.sqrt(nu)), 9 / math.sqrt(nu))
    part = angle / 2 * float((WEIGHTS * np.cos(angle / 2 * (NODES + 1)) ** (nu - 1)).sum())
    ln_b = math.lgamma(nu / 2) + math.lgamma(0.5) - math.lgamma(nu / 2 + 0.5)
    return 0.5 + math.copysign(min(0.5, part * math.exp(-ln_b)), x)


def t_ppf(p: Column, nu: Column, steps: int = 24) -> Column:
    """Quantile of Student's t: Newton's steps from the normal quantile, which lies between 0 and it, so that they only move outwards."""
    far = F.greatest(p, 1 - p)
    start = norm_ppf(far)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: x + (far - t_cdf(x, nu)) / F.exp(t_logpdf(x, nu)))
    return F.when((nu > 0) & (p > 0) & (p < 1), F.when(p == 0.5, F.lit(0.0)).when(p > 0.5, walk).otherwise(-walk))


def predictive_quantile(mu: Column, sigma: Column, nu: Column, p: Column) -> Column:
    return mu + sigma * t_ppf(p, nu)


def predictive_sd(sigma: Column, nu: Column) -> Column:
    return F.when(nu > 2, sigma * F.sqrt(nu / (nu - 2)))


def exceedance(mu: Column, sigma: Column, nu: Column, level: Column) -> Column:
    """Probability of a value above level."""
    return t_cdf((mu - level) / sigma, nu)


def log_score(p: Column, happened: Column) -> Column:
    """Binary negative log-likelihood."""
    return -F.when(happened, F.log(p)).otherwise(F.log1p(-p))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in degrees; differences are taken in degrees, where those of whole degrees are exact."""
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(s, F.lit(1.0)))))
