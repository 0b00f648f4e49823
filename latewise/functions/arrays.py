"""Helpers on probability and logit arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: keeps the row sum away from zero.
ROW_SUM_EPSILON = 1e-12


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(shifted, lambda e: e / _total(shifted))


def argmax(values: Column) -> Column:
    """Zero-based place of the largest entry; the lowest place wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalize_probs(probs: Column, keep: list[int] | None = None) -> Column:
    """Divide by the row sum plus a tiny constant, then keep only the listed classes.

    A one-entry array is read as the probability of the second of two classes.
    """
    pair = F.when(F.size(probs) == 1, F.array(1 - probs[0], probs[0])).otherwise(probs)
    scaled = F.transform(pair, lambda p: p / (_total(pair) + F.lit(ROW_SUM_EPSILON)))
    if keep is None:
        return scaled
    return F.transform(F.array(*[F.lit(k) for k in keep]), lambda k: F.get(scaled, k))


def probability_of(probs: Column, label: Column) -> Column:
    """The entry of ``probs`` at the zero-based class ``label``; a label without an entry is an error."""
    return F.coalesce(F.get(probs, label.cast("int")), F.raise_error(F.lit("a label has no probability")).cast("double"))
