"""Scalar column expressions; every choice that depends on names is made while planning."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a column name that decide its rounding, and the sentinel for "no estimate".
PERCENT_WORDS = ("rate", "pct", "percent", "ratio", "proportion")
WHOLE_WORDS = ("income", "cost", "price", "rent", "value", "median_h", "count", "total", "pop", "universe", "number")
SENTINEL = -666666666


def clean_name(name: str) -> str:
    """Trimmed, lower case, runs of other characters than letters and digits as ``_``."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def to_numeric(c: Column) -> Column:
    """A number, or null where the text is none."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def no_sentinel(c: Column, income: bool = False) -> Column:
    """The sentinel, and for income any negative value, as null."""
    c = F.nullif(c, F.lit(SENTINEL))
    return F.when(c >= 0, c) if income else c


def smart_round(c: Column, name: str) -> Column:
    """Half-to-even rounding of the binary value: by words in ``name``, else by magnitude."""

    def to(digits: int) -> Column:  # ``bround`` would round the shortest decimal text instead
        return F.rint(c * 10**digits) / 10**digits

    if any(w in name.lower() for w in PERCENT_WORDS):
        return to(2)
    if any(w in name.lower() for w in WHOLE_WORDS):
        return to(0)
    return F.when(F.abs(c) >= 1000, to(0)).when(F.abs(c) >= 1, to(1)).otherwise(to(2))


def geoid(*parts: tuple[Column, int]) -> Column:
    """Zero-padded parts of a geographic id in one string; null if a part is."""
    return F.concat(*(F.lpad(c.cast("string"), width, "0") for c, width in parts))


def break_label(low: Column, high: Column, percent: bool = False) -> Column:
    """Both ends with an en dash, digits by magnitude and thousands separators; ``percent`` adds one ``%``."""

    def one(c: Column) -> Column:
        return F.when(F.abs(c) >= 100, F.format_number(c, 0)).when(F.abs(c) >= 1, F.format_number(c, 1)).otherwise(F.format_number(c, 2))

    return F.concat(one(low), F.lit("\u2013"), one(high), F.lit("%" if percent else ""))


def full_address(full: Column | None, *parts: Column) -> Column:
    """The full address if there is one, else the parts that are not null."""
    joined = F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))
    return joined if full is None else F.coalesce(F.nullif(F.trim(full), F.lit("")), joined)


def two_sided_p(z: Column) -> Column:
    """``2 * (1 - Phi(|z|))`` by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return poly * F.exp(-x * x)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres; stretched by 1/cos(latitude)."""
    r = F.lit(6378137.0)
    return r * F.radians(lon), r * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326xx north, 327xx south."""
    zone = F.floor((lon + 180) / 6) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """WGS 84 to UTM metres by the Krueger series to the third order; ``zone`` is 1 to 60."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, dlam = F.radians(lat), F.radians(lon) - F.radians(zone * 6 - 183)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dlam)), F.atanh(F.sin(dlam) / F.sqrt(1 + t * t))
    x = eta + sum((F.lit(al) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, al in enumerate(alpha, 1)), F.lit(0.0))
    y = xi + sum((F.lit(al) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, al in enumerate(alpha, 1)), F.lit(0.0))
    return 500000 + F.lit(0.9996 * a) * x, F.lit(0.9996 * a) * y + F.when(lat < 0, 10000000.0).otherwise(0.0)


def travel_minutes(km: Column, mode: str) -> Column:
    """Minutes at the mode's fixed speed."""
    # km/h by mode.
    return km / F.lit({"drive": 40.0, "walk": 4.8, "bike": 15.0}[mode]) * 60
