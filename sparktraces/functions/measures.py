"""Per-row derived measures: intensities, normalisations and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASELINE_FLOOR = 1e-6


def missing(value: Column) -> Column:
    """Double with NaN and unreadable text turned into NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def weighted_intensity(body: Column, body_area: Column, prot: Column, prot_area: Column) -> Column:
    area = body_area + prot_area
    return F.when(area > 0, (body * body_area + prot * prot_area) / F.nullif(area, F.lit(0.0))).otherwise(0.0)


def volume_normalised(intensity: Column, baseline: Column, volume: Column, mask_count: Column) -> Column:
    """(I - F0) / V, missing where the mask is empty or the volume is not positive."""
    return F.when((mask_count > 0) & (volume > 0), (intensity - baseline) / volume)


def total_volume_normalised(
    body_rise: Column, body_area: Column, body_count: Column,
    prot_rise: Column, prot_area: Column, prot_count: Column, volume: Column,
) -> Column:
    """Area-weighted rise of both regions over the total volume; empty masks weigh nothing."""
    wb = F.when(body_count > 0, body_area).otherwise(0.0)
    wp = F.when(prot_count > 0, prot_area).otherwise(0.0)
    rise = (F.coalesce(body_rise, F.lit(0.0)) * wb + F.coalesce(prot_rise, F.lit(0.0)) * wp) / (wb + wp)
    return F.when((wb + wp > 0) & (volume > 0), rise / volume)


def relative_change(rise: Column, baseline: Column) -> Column:
    """dF / F0, 0 when the baseline is at most the floor."""
    return F.when(baseline > BASELINE_FLOOR, rise / baseline).otherwise(0.0)


def over_baseline(value: Column, baseline: Column) -> Column:
    return value / F.greatest(baseline, F.lit(BASELINE_FLOOR))


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when the bottom is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def minmax(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def range_scaled(spread: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, spread / (high - low)).otherwise(0.0)
