"""Channel geometry, forward models and classification rules as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device geometry, model constant and classification cut-offs.
CHANNEL_WIDTH_UM = 6.7
CHANNEL_HEIGHT_UM = 5.0
SCALE_UM_PER_PX = 0.629
BEHAVIOUR_SLOPE = 0.02
GROWTH_UM = 0.5
EFFECT_CUTS = {"negligible": 0.147, "small": 0.330, "medium": 0.474}


def shape_factor(width: Column, height: Column) -> Column:
    """Rectangular channel factor f* (Son 2007, eq. 20) with eleven odd series terms."""
    x = F.least(width, height) / F.greatest(width, height)
    total = F.lit(0.0)
    for n in range(1, 22, 2):
        total = total + F.tanh(F.lit(math.pi * n) * x / 2) / F.lit(float(n**5))
    bracket = 1 - F.lit(192 / math.pi**5) / x * total
    return 1 / (F.pow(1 + 1 / x, F.lit(2.0)) * bracket)


def effective_radius(width: Column, height: Column) -> Column:
    low, high = F.least(width, height), F.greatest(width, height)
    top = F.lit(2 / (3 * math.pi)) * high * F.pow(low, F.lit(3.0))
    base = F.pow(1 + low / high, F.lit(2.0)) * shape_factor(width, height)
    return F.when(low > 0, F.pow(top / base, F.lit(0.25))).otherwise(
        F.raise_error(F.lit("channel sides must be positive")).cast("double")
    )


def shear(width: Column, height: Column, length: Column, pressure: Column, viscosity: Column) -> dict[str, Column]:
    """Wall stress, wall rate, flow and geometry; lengths in um, pressure in Pa."""
    h, w, run = F.least(width, height) * 1e-6, F.greatest(width, height) * 1e-6, length * 1e-6
    aspect = F.least(width, height) / F.greatest(width, height)
    f = shape_factor(width, height)
    stress = pressure * h / (2 * run) / (1 + aspect)
    flow = stress * w * h * h / (6 * viscosity * (1 + aspect) * f)
    rate = 6 * flow / (w * h * h) * (1 + aspect) * f
    return {
        "wall_stress_pa": stress,
        "wall_rate_per_s": rate,
        "flow_ul_per_min": flow * 1e9 * 60,
        "flow_m3_per_s": flow,
        "aspect": aspect,
        "fstar": f,
    }


def kelvin_voigt(t: Column, rise: Column, tau: Column) -> Column:
    return rise * (1 - F.exp(-t / tau))


def jeffreys(t: Column, rise: Column, tau: Column, slope: Column) -> Column:
    return kelvin_voigt(t, rise, tau) + slope * t


def burgers(t: Column, offset: Column, slope: Column, rise: Column, tau: Column) -> Column:
    return offset + jeffreys(t, rise, tau, slope)


def power_law(t: Column, scale: Column, exponent: Column, offset: Column | float = 0.0) -> Column:
    offset = F.lit(offset) if isinstance(offset, float) else offset
    return scale * F.pow(t, exponent) + offset


def line(t: Column, slope: Column, intercept: Column) -> Column:
    return slope * t + intercept


def two_rises(t: Column, a1: Column, tau1: Column, a2: Column, tau2: Column) -> Column:
    return kelvin_voigt(t, a1, tau1) + kelvin_voigt(t, a2, tau2)


def rise_to_modulus(rise: Column, radius_pressure: Column, c: float) -> Column:
    """Elastic modulus from the fitted plateau: r dP / (C a)."""
    return F.try_divide(radius_pressure, c * rise)


def tau_to_viscosity(tau: Column, modulus: Column, c: float) -> Column:
    return tau * c * modulus / (3 * math.pi)


def slope_to_viscosity(slope: Column, radius_pressure: Column) -> Column:
    return F.try_divide(radius_pressure, 3 * math.pi * slope)


def relaxation_time(model: Column, params: Mapping[str, Column], c: float) -> Column:
    """3 pi eta / (C E) of the winning model's solid element."""
    def tau(eta: str, e: str) -> Column:
        return F.try_divide(3 * math.pi * params[eta], c * params[e])

    return (
        F.when(model == "Kelvin-Voigt", tau("eta", "e"))
        .when(model == "Jeffreys", tau("eta1", "e"))
        .when(model == "Burgers", tau("burgers_eta2", "burgers_e2"))
    )


def rename_burgers(e1: Column, eta1: Column, e2: Column, eta2: Column) -> Column:
    """Burgers parameters under feature names: the solid element becomes E and eta1."""
    return F.struct(e2.alias("e"), e1.alias("e1"), eta2.alias("eta1"), eta1.alias("eta2"))


def pixel_sizes(count: Column, scale: Column) -> dict[str, Column]:
    area = count * scale * scale
    return {"area_um2": area, "linear_um": F.sqrt(count) * scale, "volume_um3": area * F.sqrt(area)}


def first_scale(scale: Column, frame: Column, default: float) -> Column:
    """Aggregate: the pixel scale of a trace's first row, or the default where that row has none."""
    return F.coalesce(F.min_by(scale, frame), F.lit(default))


def region_area(count: Column | None, legacy: Column | None, scale: Column) -> Column | None:
    """Area of a region from its pixel count, from the older area column, or None where a table has neither."""
    return count * scale * scale if count is not None else legacy


def sphere_volume(area: Column) -> Column:
    a = F.greatest(area, F.lit(0.0))
    return F.lit(4 / (3 * math.sqrt(math.pi))) * (a * F.sqrt(a))


def capped_cylinder_volume(length: Column, radius: Column | float) -> Column:
    r = F.lit(radius) if isinstance(radius, float) else radius
    return math.pi * r * r * F.coalesce(length, F.lit(0.0)) + (2 / 3) * math.pi * r * r * r


def winner_value(model: Column, linear: Column, power: Column) -> Column:
    return F.when(model == "Linear", linear).when(model == "Power-Law", power)


def behaviour_class(slope: Column, cut: float = BEHAVIOUR_SLOPE) -> Column:
    return F.when(slope > cut, "Extends").when(slope < -cut, "Retracts").when(slope.isNotNull(), "Stable")


def growth_class(before: Column, after: Column, cut: float = GROWTH_UM) -> Column:
    delta = after - before
    return F.when(delta > cut, "grows").when(delta < -cut, "retracts").when(delta.isNotNull(), "steady")


def plausibility(e: Column, eta1: Column, eta2: Column, ranges: Mapping[str, tuple[float, float]]) -> Column:
    """Struct (valid, warnings): outside a range warns, beyond ten times the range is invalid."""
    warnings, valid = [], F.lit(True)
    for name, value in (("e", e), ("eta1", eta1), ("eta2", eta2)):
        lo, hi = ranges[name]
        warnings.append(F.when(~value.between(lo, hi), F.lit(f"{name} outside {lo:g}..{hi:g}")))
        valid = valid & value.between(lo / 10, hi * 10)
    positive = (e > 0) & (eta1 > 0)
    tau = F.when(positive, 3 * math.pi * eta1 / e)
    ratio = F.when(positive, eta2 / eta1)
    warnings.append(F.when(~((tau > 0.1) & (tau < 100)), F.lit("relaxation time unusual")))
    warnings.append(F.when(~((ratio > 1.5) & (ratio < 50)), F.lit("viscosity ratio unusual")))
    return F.struct(valid.alias("valid"), F.array_compact(F.array(*warnings)).alias("warnings"))


def ordered_rises(a1: Column, tau1: Column, a2: Column, tau2: Column) -> Column:
    """Struct with the faster rise first and the amplitude-weighted time constant."""
    swap = tau1 > tau2
    return F.struct(
        F.when(swap, a2).otherwise(a1).alias("a1"),
        F.least(tau1, tau2).alias("tau1"),
        F.when(swap, a1).otherwise(a2).alias("a2"),
        F.greatest(tau1, tau2).alias("tau2"),
        F.when(a1 + a2 > 1e-9, (a1 * tau1 + a2 * tau2) / F.nullif(a1 + a2, F.lit(0.0))).alias("mean_tau"),
    )


def circularity(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * area / F.nullif(perimeter * perimeter, F.lit(0.0))


def log_floor(value: Column, floor: float = 1e-3) -> Column:
    return F.greatest(value, F.lit(floor))


def effect_class(delta: Column) -> Column:
    size = F.abs(delta)
    cuts = EFFECT_CUTS
    return (
        F.when(size < cuts["negligible"], "negligible")
        .when(size < cuts["small"], "small")
        .when(size < cuts["medium"], "medium")
        .when(size.isNotNull(), "large")
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def structure_class(edge_ratio: Column, edge_cv: Column, cv_threshold: float = 0.4) -> Column:
    return (
        F.when(edge_ratio < 0.9, "interior")
        .when(edge_ratio <= 1.1, "uniform")
        .when(edge_cv <= cv_threshold, "cortex")
        .when(edge_ratio.isNotNull(), "patches")
    )
