"""Fixed-bucket histograms and the quantile read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from featurelake.functions.scalars import clamp

# Upper bounds of the confidence buckets and of the latency buckets (seconds).
CONFIDENCE_BOUNDS = [0.0, 0.2, 0.4, 0.6, 0.8, 0.9, 0.95, 1.0]
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def equal_width_bin(c: Column, bins: int = 20, low: float = 0.0, high: float = 1.0) -> Column:
    """1-based bin on a fixed grid; both ends fall into the outermost bins."""
    return F.least(F.width_bucket(clamp(c, low, high), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))


def cumulative_counts(c: Column, bounds: Sequence[float]) -> list[Column]:
    """One aggregate per bound counting values at or below it, then the total."""
    counts = [F.count_if(c <= F.lit(float(b))) for b in bounds] + [F.count(c)]
    return [n.alias(f"le_{i}") for i, n in enumerate(counts)]


def quantile_from_counts(q: float, bounds: Sequence[float]) -> Column:
    """Quantile from cumulative counts ``le_0 .. le_k`` with linear interpolation in the bucket.

    A rank in the open last bucket reports the highest finite bound; the first bucket starts at 0.
    """
    total = F.col(f"le_{len(bounds)}").cast("double")
    rank = total * F.lit(float(q))
    result = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        upto = F.col(f"le_{i}").cast("double")
        below = F.col(f"le_{i - 1}").cast("double") if i else F.lit(0.0)
        start = F.lit(float(bounds[i - 1])) if i else F.lit(0.0)
        inside = start + (F.lit(float(bounds[i])) - start) * (rank - below) / F.nullif(upto - below, F.lit(0.0))
        result = F.when(upto >= rank, F.coalesce(inside, start)).otherwise(result)
    return F.when(total > 0, result)
