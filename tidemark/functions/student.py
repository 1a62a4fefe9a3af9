"""Student's t distribution as column expressions: logarithm of the gamma function, incomplete beta function, distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' coefficients for 7 and nine terms.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
#: Steps of the continued fraction, two for each of its terms.
STEPS = 1_000
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z of 0.5 and more."""
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (z + k)
    t = z + 6.5
    return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.ln(t) - t + F.ln(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's steps as a fold over their numbers."""
    kept = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
    d = 1 / kept(1 - (a + b) * x / (a + 1))
    begin = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

    def step(s: Column, j: Column) -> Column:
        m = F.floor((j + 1) / 2).cast("double")
        even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        odd = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        term = F.when(j % 2 == 1, odd).otherwise(even)
        c, d = kept(1 + term / s["c"]), 1 / kept(1 + term * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step, lambda s: s["h"])


def student_cdf(t: Column, df: Column) -> Column:
    """Cumulative Student t distribution; null where t is, or where df is not above 0."""
    a, b = df / 2, F.lit(0.5)
    x, y = df / (df + t * t), t * t / (df + t * t)
    front = F.exp(log_gamma(a + 0.5) - log_gamma(F.greatest(a, F.lit(0.5))) - 0.5 * math.log(math.pi) + a * F.ln(x) + b * F.ln(y))
    near = front * _fraction(a, b, x) / a
    far = 1 - front * _fraction(b, a, y) / b
    beta = F.when(x < (a + 1) / (a + 2.5), near).otherwise(far)
    return F.when((df > 0) & t.isNotNull(), F.when(t == 0, 0.5).when(t > 0, 1 - beta / 2).otherwise(beta / 2))
