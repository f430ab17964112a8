"""Column -> Column functions on ``array<double>`` values.

They stay in the JVM. ``let`` evaluates a sub-expression once per row: Spark would
otherwise recompute an outer expression for every element of a ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers below EPS count as zero; descriptor entries are capped.
EPS = 1e-8
SIFT_CAP = 0.2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def chi2(a: Column, b: Column) -> Column:
    """Half the sum of (x-y)^2/(x+y); a term with x+y = 0 counts zero."""
    terms = F.zip_with(
        a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0))
    )
    return _total(terms) / 2


def l2sq(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def sqnorm(a: Column) -> Column:
    return _total(F.transform(a, lambda x: x * x))


def l2sq_by_norms(a: Column, b: Column) -> Column:
    return sqnorm(a) - 2 * dot(a, b) + sqnorm(b)


def array_low(a: Column) -> Column:
    """Smallest entry; zero for an empty array."""
    return F.coalesce(F.array_min(a), F.lit(0.0))


def array_high(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(0.0))


def minmax(v: Column, lo: Column, hi: Column) -> Column:
    """Scale to [0, 1]; NULL where hi = lo, so that no threshold test passes."""
    return F.try_divide(v - lo, hi - lo)


def l2_normalize(a: Column, norm: float = 1.0, eps: float = EPS) -> Column:
    return let(
        F.sqrt(sqnorm(a)),
        lambda n: F.when(n > eps, F.transform(a, lambda x: x * (F.lit(float(norm)) / n))).otherwise(a),
    )


def sift_normalize(a: Column, threshold: float = 1.0) -> Column:
    """Descriptors at or above the threshold are scaled, capped and rescaled; the rest divided and capped."""

    def strong(n: Column) -> Column:
        capped = F.transform(a, lambda x: F.least(x / n, F.lit(SIFT_CAP)))
        return let(capped, lambda c: let(F.sqrt(sqnorm(c)), lambda m: F.transform(c, lambda x: x / m)))

    weak = F.transform(a, lambda x: F.least(x / F.lit(float(threshold)), F.lit(SIFT_CAP)))
    return let(F.sqrt(sqnorm(a)), lambda n: F.when(n >= threshold, strong(n)).otherwise(weak))


def logsumexp(a: Column) -> Column:
    return let(
        F.array_max(a), lambda m: F.log(_total(F.transform(a, lambda x: F.exp(x - m)))) + m
    )


def softmax(a: Column) -> Column:
    return let(logsumexp(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: (F.tanh(x / 2) + 1) / 2)


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def linear(a: Column) -> Column:
    return a


def snap(a: Column, eps: float = EPS) -> Column:
    return F.transform(a, lambda x: F.when(F.abs(x) < eps, F.lit(0.0)).otherwise(x))


def argmax(a: Column) -> Column:
    """1-based position of the first largest entry."""
    return F.array_position(a, F.array_max(a)).cast("int")


def affine(a: Column, shift: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(a, shift, lambda x, m: x + m), scale, lambda x, s: x * s)


def subvector_array(vec: Column, groups: int) -> Column:
    """Split into ``groups`` runs of floor(d/groups); the last run takes the remainder."""
    width = F.floor(F.size(vec) / groups).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda g: F.slice(
            vec,
            g * width + 1,
            F.when(g == groups - 1, F.size(vec) - g * width).otherwise(width),
        ),
    )


METRICS: dict[str, Callable[[Column, Column], Column]] = {"chi2": chi2, "l2sq": l2sq}
ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "soft": softmax,
    "sigm": sigmoid,
    "relu": relu,
    "linear": linear,
    "SVM": linear,
}
