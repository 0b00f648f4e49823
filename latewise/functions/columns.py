"""Date, binning and ratio helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Bin edges and names that results are compared on.
PROCESSING_EDGES = [-1, 0, 2, 4, 6, math.inf]
PROCESSING_LABELS = ["0_days", "1_2_days", "3_4_days", "5_6_days", "7_plus_days"]
PRICE_EDGES = [0, 50, 100, 200, 500, math.inf]
PRICE_LABELS = ["Very_Low", "Low", "Medium", "High", "Very_High"]


def parse_ts(col: Column, fmt: str | None = None) -> Column:
    """Text to a zone-free timestamp; text that does not parse raises under ANSI mode."""
    return F.to_timestamp_ntz(col, F.lit(fmt)) if fmt else F.to_timestamp_ntz(col)


def whole_days_between(start: Column, end: Column) -> Column:
    """Days from start to end, rounded towards minus infinity (noon to the midnight before is -1)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_DAY)).cast("int")


def cut(col: Column, edges: list[float], labels: list[str]) -> Column:
    """Name of the right-closed interval (edge[i], edge[i+1]] that holds the value, else null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    result = F.when(col <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        hit = col.isNotNull() if math.isinf(upper) else col <= F.lit(upper)
        result = result.when(hit, F.lit(label))
    return result


def processing_bin(days: Column) -> Column:
    return cut(days, PROCESSING_EDGES, PROCESSING_LABELS)


def price_range(price: Column) -> Column:
    return cut(price, PRICE_EDGES, PRICE_LABELS)


def indicator(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Month, quarter, weekday (Monday is 0) and weekend flag of an order date."""
    return {
        "order_month": F.month(ts),
        "order_quarter": F.quarter(ts),
        "order_weekday": F.weekday(ts),
        "is_weekend_order": indicator(F.weekday(ts) >= 5),
    }


def delay_days(real: Column, scheduled: Column) -> Column:
    return real - scheduled


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
