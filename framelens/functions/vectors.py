"""Array expressions over embeddings, histograms and flattened pixel arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_ZERO_NORM = 1e-12


def as_doubles(vector) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(vector, str) else vector.cast("array<double>")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a, b) -> Column:
    return array_sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def l2_norm(vector) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda total, x: total + x * x))


def _guard_zero(norm: Column, value: Column, on_zero: str) -> Column:
    if on_zero == "null":
        return F.when(norm >= NEAR_ZERO_NORM, value)
    if on_zero == "error":
        failure = F.raise_error(F.lit("a vector of near-zero length cannot be normalised"))
        return F.when(norm >= NEAR_ZERO_NORM, value).when(norm.isNotNull(), failure)
    raise ValueError("on_zero must be 'null' or 'error'")


def l2_normalize(vector, *, on_zero: str = "null") -> Column:
    """Unit vector; a near-zero one gives null or raises."""
    # A lambda body is evaluated per element, so the norm is bound once by an outer lambda.
    values = as_doubles(vector)
    scaled = F.transform(F.array(l2_norm(vector)), lambda norm: _guard_zero(norm, F.transform(values, lambda x: x / norm), on_zero))
    return F.get(scaled, F.lit(0))


def cosine(a, b, *, on_zero: str = "null") -> Column:
    norm_a, norm_b = l2_norm(a), l2_norm(b)
    return _guard_zero(F.least(norm_a, norm_b), dot(a, b) / (norm_a * norm_b), on_zero)


def bhattacharyya(first, second) -> Column:
    """Histogram distance in [0, 1]; 0 for equal shapes."""
    left, right = as_doubles(first), as_doubles(second)
    shared = array_sum(F.zip_with(left, right, lambda x, y: F.sqrt(x * y)))
    scale = F.sqrt(array_sum(left)) * F.sqrt(array_sum(right))
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - shared / scale))


def mean_abs_difference(a, b) -> Column:
    left, right = as_doubles(a), as_doubles(b)
    return F.try_divide(array_sum(F.zip_with(left, right, lambda x, y: F.abs(x - y))), F.size(left))


def masked_mae(original, output, alpha, *, threshold: float = 0.01) -> Column:
    """Mean absolute difference over cells whose alpha is below the threshold; null when there is none."""
    outside = F.filter(
        F.arrays_zip(
            as_doubles(original).alias("a"), as_doubles(output).alias("b"), as_doubles(alpha).alias("m")
        ),
        lambda cell: cell["m"] < threshold,
    )
    total = F.aggregate(outside, F.lit(0.0), lambda acc, cell: acc + F.abs(cell["a"] - cell["b"]))
    return F.when(F.size(outside) > 0, total / F.size(outside))
