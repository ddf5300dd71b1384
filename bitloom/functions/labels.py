"""Column functions on label sets and posteriors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all labels; 0 where both sets are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def label_mask(ids: Column) -> Column:
    """A set of ids as the bits of a long; null where an id is below 0, above 62 or null."""
    fits = F.forall(ids, lambda i: i.isNotNull() & i.between(0, 62))
    return F.when(fits, F.aggregate(ids, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))))


def mask_jaccard(a: Column, b: Column) -> Column:
    """`jaccard` of two masks; null where either is."""
    both, either = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(either > 0, both / either).otherwise(F.lit(0.0))


def active(posterior: Column, threshold: Column | float) -> Column:
    """Zero-based labels that reach the threshold; the first of the greatest where none does."""
    found = F.filter(F.transform(posterior, lambda p, i: F.when(p >= threshold, i).otherwise(F.lit(-1))), lambda i: i >= 0)
    first = F.array((F.array_position(posterior, F.array_max(posterior)) - 1).cast("int"))
    return F.when(F.size(found) > 0, found).otherwise(first)


def soft_relevance(p: Column, q: Column) -> Column:
    """1 - prod(1 - p q), by logarithms; a factor is 1e-7 at least."""
    logs = F.aggregate(F.zip_with(p, q, lambda x, y: F.log1p(-F.least(x * y, F.lit(1 - 1e-7)))), F.lit(0.0), lambda s, x: s + x)
    return -F.expm1(logs)


def soft_jaccard(p: Column, q: Column) -> Column:
    both = F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(p, q, lambda x, y: x + y - x * y), F.lit(0.0), lambda s, x: s + x)
    return both / F.greatest(either, F.lit(1e-8))


def multi_hot(ids: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(ids, i).cast("int"))


def strict_multi_hot(ids: Column, size: int) -> Column:
    """`multi_hot` of a set: an id that is null, stands twice or is not from 0 to size - 1 ends the job with the set in its message."""
    bad = F.exists(ids, lambda i: i.isNull() | (i < 0) | (i >= size)) | (F.size(F.array_distinct(ids)) != F.size(ids))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not a set of ids below {size}: "), F.to_json(ids))).cast("array<int>")).otherwise(multi_hot(ids, size))


def unit_faults(posterior: Column, width: int) -> Column:
    """What a posterior breaks: "null", "width", "not finite" or "outside" (of 0 to 1); null where it is good."""
    odd = F.exists(posterior, lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")))
    return F.when(posterior.isNull(), "null").when(F.size(posterior) != width, "width").when(odd, "not finite").when(F.exists(posterior, lambda p: (p < 0) | (p > 1)), "outside")
