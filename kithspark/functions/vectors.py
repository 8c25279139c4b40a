"""Column functions over vectors: arrays of numbers, computed in double."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from kithspark.schemas import EYE_WEIGHT, FULL_WEIGHT


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of the elements, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def finite(v: Column) -> Column:
    """Whether no element is null, NaN or infinite; null for a null vector."""
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def usable(v: Column) -> Column:
    """Not null, not empty, all finite, not zero."""
    return F.coalesce((F.size(v) > 0) & finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine_similarity(a: Column, b: Column) -> Column:
    """From -1 to 1; null if either is unusable or their sizes differ."""
    ok = usable(a) & usable(b) & (F.size(a) == F.size(b))
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; 2 where a vector is null, empty, zero or not finite; sizes that differ are an error."""
    differ = F.raise_error(F.lit("vectors differ in size")).cast("double")
    return F.when(F.size(a) != F.size(b), differ).otherwise(metric_or_far(1 - cosine_similarity(a, b)))


def sizes_differ(a: Column, b: Column) -> Column:
    """Whether ``cosine_distance`` refuses the two."""
    return F.coalesce(F.size(a) != F.size(b), F.lit(False))


def validate_weights(full, eye) -> tuple[float, float]:
    """The two weights scaled to a sum of 1; negative, non-finite, non-numeric or both zero are refused."""
    try:
        full, eye = float(full), float(eye)
    except (TypeError, ValueError):
        raise ValueError("weights must be numbers") from None
    if not (math.isfinite(full) and math.isfinite(eye)) or full < 0 or eye < 0 or full + eye == 0:
        raise ValueError("weights must be finite, not negative and not both 0")
    return full / (full + eye), eye / (full + eye)


def fused_similarity(full_a: Column, full_b: Column, eye_a: Column, eye_b: Column, weights: tuple[float, float] = (FULL_WEIGHT, EYE_WEIGHT)) -> Column:
    """The weighted mean of both signals' similarities, or the one that there is, or null."""
    wf, we = validate_weights(*weights)
    f, e = cosine_similarity(full_a, full_b), cosine_similarity(eye_a, eye_b)
    return F.coalesce(F.lit(wf) * f + F.lit(we) * e, f, e)


def fused_distance(full_a: Column, full_b: Column, eye_a: Column, eye_b: Column, weights: tuple[float, float] = (FULL_WEIGHT, EYE_WEIGHT)) -> Column:
    return 1 - fused_similarity(full_a, full_b, eye_a, eye_b, weights)


def weights_used(eye_a: Column, eye_b: Column, weights: tuple[float, float] = (FULL_WEIGHT, EYE_WEIGHT)) -> Column:
    """(full, eye) as a pair is blended."""
    wf, we = validate_weights(*weights)
    both = cosine_similarity(eye_a, eye_b).isNotNull()
    return F.struct(F.when(both, wf).otherwise(1.0).alias("full"), F.when(both, we).otherwise(0.0).alias("eye"))


def unit(v: Column) -> Column:
    """Scaled to length one, in double; null for an unusable vector."""
    n = norm(v)
    return F.when(usable(v), F.transform(v, lambda x: x.cast("double") / n))


def weighted_sum(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * wa + y.cast("double") * wb)


def metric_or_far(distance: Column) -> Column:
    """A distance for callers that need a number: 2 where it can't be computed."""
    return F.coalesce(distance, F.lit(2.0))
