"""Distances, severity classes and the cell scheme of the spatial joins."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope.constants import EARTH_RADIUS_KM, GREEN_BELOW_KM, PIN_REGION_FALLBACK, PIN_REGIONS, YELLOW_BELOW_KM


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance as SQL text. The term is held below 1: rounding can pass it near antipodes."""
    sq = lambda a, b: f"pow(sin(radians({b} - {a}) / 2), 2)"
    a = f"least(1D, {sq(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {sq(lon1, lon2)})"
    return f"{2 * EARTH_RADIUS_KM}D * atan2(sqrt({a}), sqrt(1D - {a}))"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """The same as a Column; arguments are column names or numbers."""
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2))


def severity(km: Column) -> Column:
    return F.when(km < GREEN_BELOW_KM, "green").when(km < YELLOW_BELOW_KM, "yellow").otherwise("red")


def severity_rank(label: Column) -> Column:
    return F.when(label == "red", 3).when(label == "yellow", 2).otherwise(1)


def severity_label(rank: Column) -> Column:
    return F.when(rank == 3, "red").when(rank == 2, "yellow").otherwise("green")


def pin_region_point(pin: Column) -> tuple[Column, Column]:
    """Approximate point of a postal code from its first digit."""
    lat, lon = F.lit(PIN_REGION_FALLBACK[0]), F.lit(PIN_REGION_FALLBACK[1])
    first = F.substring(pin, 1, 1)
    for digit, (y, x) in PIN_REGIONS.items():
        lat = F.when(first == digit, F.lit(y)).otherwise(lat)
        lon = F.when(first == digit, F.lit(x)).otherwise(lon)
    return lat, lon


def is_pin(pin: Column) -> Column:
    return pin.rlike("^[0-9]{6}$")


# --- Cells -------------------------------------------------------------------
# A point becomes a unit vector and a cell is a cube of side 2^-level around it.
# Straight-line (chord) length rises with the great-circle distance, and cubes
# have no poles and no date line, so one rule holds everywhere on the globe.

# These helpers return SQL text: a search builds hundreds of expressions, and one
# parsed string is far cheaper to build than a tree of Column calls.

LEVELS = (0, 3, 6, 9, 12, 15, 18)  # cube sides: 6371 km ... 24 m
_SPAN = 1 << 18


def unit_vector(lat: str, lon: str) -> tuple[str, str, str]:
    la, lo = f"radians({lat})", f"radians({lon})"
    return f"cos({la}) * cos({lo})", f"cos({la}) * sin({lo})", f"sin({la})"


def pack_cell(ix: str, iy: str, iz: str) -> str:
    """Three axis cells in one long."""
    return f"(shiftleft({ix} + {_SPAN}L, 40) | shiftleft({iy} + {_SPAN}L, 20) | ({iz} + {_SPAN}L))"


def cell_at(x: str, y: str, z: str, level: int) -> str:
    scale = f"{1 << level}D"
    return pack_cell(*[f"cast(floor({v} * {scale}) as bigint)" for v in (x, y, z)])


def chord(a: tuple, b: tuple) -> str:
    return "sqrt(" + " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b)) + ")"


def chord_of_km(km: float) -> float:
    return 2.0 * math.sin(min(km / (2.0 * EARTH_RADIUS_KM), math.pi / 2))


def cell_chord_bounds(p: tuple, member: tuple, side: str) -> tuple[str, str]:
    """Least and greatest chord from point ``p`` to the cube of ``side`` that holds ``member``."""
    near, far = [], []
    for a, m in zip(p, member):
        lo = f"floor({m} / {side}) * {side}"
        n = f"greatest(0D, {lo} - {a}, {a} - {lo} - {side})"
        f = f"greatest(abs({a} - {lo}), abs({a} - {lo} - {side}))"
        near.append(f"{n} * {n}")
        far.append(f"{f} * {f}")
    return f"sqrt({' + '.join(near)})", f"sqrt({' + '.join(far)})"
