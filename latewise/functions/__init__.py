"""Column-to-Column helpers; all of them stay inside the JVM."""

from latewise.functions.arrays import argmax, normalize_probs, probability_of, softmax
from latewise.functions.columns import (
    calendar_parts,
    cut,
    delay_days,
    guarded_ratio,
    indicator,
    parse_ts,
    price_range,
    processing_bin,
    whole_days_between,
)
from latewise.functions.geo import geodesic_km, haversine_km, manhattan_deg

__all__ = [
    "argmax",
    "calendar_parts",
    "cut",
    "delay_days",
    "geodesic_km",
    "guarded_ratio",
    "haversine_km",
    "indicator",
    "manhattan_deg",
    "normalize_probs",
    "parse_ts",
    "price_range",
    "probability_of",
    "processing_bin",
    "softmax",
    "whole_days_between",
]
