"""Column functions of vehicle physics and of small statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens.functions import constants as k


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null, which least and greatest alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def scale01(x: Column, lo: float, hi: float) -> Column:
    return clip((x - lo) / (hi - lo), 0, 1)


def maf_residual(maf: Column, map_: Column, rpm: Column, iat: Column, p: dict = k.SPEED_DENSITY) -> Column:
    """Measured air flow less that of the speed-density model, its inputs clipped to the range it was fitted on."""
    load = map_ * rpm / (iat + 273.15)
    want = (
        F.lit(p["intercept"]) + p["air_load"] * clip(load, *p["clip_air_load"]) + p["map"] * clip(map_, *p["clip_map"])
        + p["rpm"] * clip(rpm, *p["clip_rpm"]) + p["iat"] * clip(iat, *p["clip_iat"])
    )
    return maf - want


def pedal_residual(d: Column, e: Column, p: dict = k.PEDAL_MAP) -> Column:
    return e - (p["slope"] * d + p["intercept"])


def vsp(v: Column, a: Column) -> Column:
    """Vehicle-specific power, kW per t, of speed in m/s and acceleration in m/s2."""
    return v * (1.1 * a + 0.132) + 0.000302 * v * v * v


def norm_cdf(z: Column) -> Column:
    """Normal distribution function by the error-function polynomial of Abramowitz and Stegun 7.1.26 (error below 2e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without trials."""
    n = F.when(n > 0, n)
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    d = 1 + z * z / n
    return F.when(n > 0, F.greatest((mid - half) / d, F.lit(0.0))), F.when(n > 0, F.least((mid + half) / d, F.lit(1.0)))


def risk_level(score: Column) -> Column:
    return F.when(score >= k.RISK_HIGH, "High").when(score >= k.RISK_MEDIUM, "Medium").when(score.isNotNull(), "Low")


def round_significant(x: Column, digits: int = 6) -> Column:
    power = F.lit(10.0) ** (digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * power) / power)


def percent_text(x: Column) -> Column:
    """As a whole percentage; small values stay visible."""
    p = x * 100
    return F.when((p > 0) & (p < 1), "<1%").when(p.isNotNull(), F.concat(F.round(p, 0).cast("int").cast("string"), F.lit("%")))


def parse_bool(x: Column) -> Column:
    """true/1/yes/t and false/0/no/f in any case; null for all else, which a gate then reports."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s.isin("true", "1", "1.0", "yes", "t"), True).when(s.isin("false", "0", "0.0", "no", "f"), False)


def draw(*parts: Column) -> Column:
    """A repeatable number in 0 .. 2**32 - 1 from a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def steady_mean(x: Column, digits: int = 9) -> Column:
    """Mean of ``x`` rounded to ``digits``, from an exact sum: the same to the last bit however rows are dealt out and ordered."""
    scaled = F.round(x * 10.0**digits).cast("decimal(38,0)")
    return F.sum(scaled).cast("double") / (F.count(scaled) * 10.0**digits)


def tidy(x: Column, digits: int) -> Column:
    """``x`` rounded half up to ``digits``, from its value to nine digits, so that noise in the last bits decides no tie."""
    return F.round(F.round(x, 9), digits)
