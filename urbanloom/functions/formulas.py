"""Domain formulae: telecom, terrain, hydrology, population and travel."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L
from .classify import map_class
from .geometry import _c


def eirp_dbm(watts, gain, fill: bool = False) -> Column:
    """10*log10(W*1000) + gain; ``fill`` takes W=1 and gain=0 for missing values."""
    w, g = _c(watts), _c(gain)
    if fill:
        w = F.when((w > 0), w).otherwise(1.0)
        g = F.coalesce(g, F.lit(0.0))
    return 10 * F.log10(w * 1000) + g


def coverage_radius_km(eirp, freq, area_type=None, sensitivity: float = -100.0, variant: str = "area") -> Column:
    """Free-space radius; ``area`` attenuates by area type and caps, ``plain`` caps at 50 km."""
    e = _c(eirp)
    if variant == "plain":
        f = F.coalesce(F.when(_c(freq) > 0, _c(freq)), F.lit(900.0))
        return F.least(F.pow(F.lit(10.0), (e - sensitivity - 32.44 - 20 * F.log10(f)) / 20), F.lit(50.0))
    f = _c(freq)
    base = F.pow(F.lit(10.0), (e - sensitivity - 32.44 - 20 * F.log10(f)) / 20)
    att = F.lit(18.0) if area_type is None else map_class(area_type, L.ATTENUATION, 18.0)
    cap = F.when(f > 0, F.least(F.lit(20.0), 25000.0 / f)).otherwise(10.0)
    return F.least(base / (1 + att / 10), cap)


def sector_area_km2(radius_km, opening: float = 120.0) -> Column:
    return math.pi * _c(radius_km) * _c(radius_km) * opening / 360


def travel_minutes(length_m, category) -> tuple[Column, Column]:
    """Speed in km/h by road category and minutes; missing or infinite time is 60."""
    speed = map_class(category, L.SPEED_KMH, 30)
    t = (_c(length_m) / 1000.0) / (speed / 60.0)
    return speed, F.coalesce(t, F.lit(60.0))


def stream_power_index(strahler, slope_pct) -> Column:
    return F.pow(F.lit(2.0), _c(strahler)) * F.tan(F.atan(_c(slope_pct) / 100))


def hypsometric_integral(mean, low, high) -> Column:
    m, lo, hi = _c(mean), _c(low), _c(high)
    return F.when(hi > lo, (m - lo) / (hi - lo)).when(m.isNotNull(), F.lit(0.5))


def topographic_wetness_index(area_m2, elevation_range, hi) -> Column:
    a, r, h = _c(area_m2), _c(elevation_range), _c(hi)
    beta = F.atan(r / (2 * F.sqrt(a / math.pi))) * (1 + h)
    return F.when((r != 0) & (h != 0), F.log(a / F.tan(F.greatest(beta, F.lit(0.001)))))


def terrain_profile(low, high, median) -> Column:
    """-1 concave, 0 mixed, 1 convex from the relative position of the median."""
    pos = (_c(median) - _c(low)) / (_c(high) - _c(low))
    return F.when(_c(high) > _c(low), F.when(pos < 0.4, -1.0).when(pos > 0.6, 1.0).otherwise(0.0))


def exposure_index(p10, p90, mean) -> Column:
    return F.when(_c(mean) > 0, (_c(p90) - _c(p10)) / _c(mean))


def hydrological_relevance(elev, roughness, profile, q25, max_elev, max_rough) -> Column:
    e, r, p = _c(elev), _c(roughness), _c(profile)
    low = F.when(e <= _c(q25), 0.5).otherwise(0.5 * (1 - (e - _c(q25)) / (_c(max_elev) - _c(q25))))
    rough = F.when(_c(max_rough) > 0, 0.25 * (1 - r / _c(max_rough))).otherwise(0.0)
    form = F.when(p == -1, 0.25).when(p == 0, 0.125).otherwise(0.0)
    return F.when(e.isNotNull(), low + rough + form)


def occupancy_units(area, height, population) -> dict[str, Column]:
    """Floors, dwelling units and occupancy; units use half-even rounding."""
    floors = F.greatest(F.lit(1), (_c(height) / 3).cast("int"))
    units = F.bround(_c(area) * floors / 60)
    units = F.when(units <= 0, F.lit(1.0)).otherwise(units)
    unit_area = _c(area) * floors / units
    bedrooms = F.when(unit_area < 40, 1).when(unit_area < 70, 2).when(unit_area < 100, 3).otherwise(4)
    per_bed = _c(population) / (bedrooms * units)
    return {
        "estimated_floors": floors,
        "estimated_units": units,
        "occupancy_per_unit": _c(population) / units,
        "unit_area": unit_area,
        "estimated_bedrooms": bedrooms,
        "occupancy_per_bedroom": F.when((per_bed > 0) & (per_bed <= 10), per_bed),
    }


def ratio(a, b, eps: float = 1e-6) -> Column:
    return _c(a) / (_c(b) + eps)


def building_volumetrics(area, perimeter, height) -> dict[str, Column]:
    a, p, h = _c(area), _c(perimeter), _c(height)
    return {
        "volume_m3": a * h,
        "facade_exposure": p * h,
        "area_height_ratio": F.when(h > 0, a / h),
        "roof_area_m2": a,
    }
