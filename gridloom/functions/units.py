"""Unit conversion: every unit is a factor (and for temperatures an offset) to its base unit."""

from __future__ import annotations

import math

from pyspark.sql import Column

from ..errors import DataError

_SLUG = 14.59390294  # kg
_KNOT = 1852.0 / 3600.0  # m/s

# Factors to the base unit of each quantity, which is listed first.
QUANTITIES: dict[str, dict[str, float]] = {
    "length": {"m": 1.0, "mm": 1e-3, "cm": 1e-2, "km": 1e3, "in": 0.0254, "ft": 0.3048, "nmi": 1852.0},
    "mass": {"kg": 1.0, "g": 1e-3, "lb": 0.45359237, "slug": _SLUG},
    "time": {"s": 1.0, "min": 60.0, "h": 3600.0},
    "angle": {"rad": 1.0, "deg": math.pi / 180.0, "rev": 2.0 * math.pi},
    "rotational speed": {"rad/s": 1.0, "deg/s": math.pi / 180.0, "rpm": 2.0 * math.pi / 60.0, "Hz": 2.0 * math.pi},
    "speed": {"m/s": 1.0, "km/h": 1.0 / 3.6, "ft/s": 0.3048, "knot": _KNOT, "mph": 0.44704},
    "force": {"N": 1.0, "kN": 1e3, "lbf": 4.4482216152605, "kgf": 9.80665},
    "pressure": {"Pa": 1.0, "hPa": 100.0, "kPa": 1e3, "bar": 1e5, "mbar": 100.0, "psi": 6894.757293168, "atm": 101325.0},
    "density": {"kg/m^3": 1.0, "slug/ft^3": _SLUG / 0.3048**3},
}
#: Kelvin = value * factor + offset.
TEMPERATURES = {"K": (1.0, 0.0), "C": (1.0, 273.15), "F": (5.0 / 9.0, 273.15 - 32.0 * 5.0 / 9.0)}


def coefficients(source: str, target: str) -> tuple[float, float]:
    """k and b of target = source * k + b."""
    if source in TEMPERATURES and target in TEMPERATURES:
        (k1, b1), (k2, b2) = TEMPERATURES[source], TEMPERATURES[target]
        return k1 / k2, (b1 - b2) / k2
    for units in QUANTITIES.values():
        if source in units and target in units:
            return units[source] / units[target], 0.0
    raise DataError(f"{source} -> {target}", "units of different quantities, or unknown", "Use units of one of: " + ", ".join([*QUANTITIES, "temperature"]))


def convert(value: Column | float, source: str, target: str):
    """The value in another unit; a column stays a column."""
    k, b = coefficients(source, target)
    return value * k + b
