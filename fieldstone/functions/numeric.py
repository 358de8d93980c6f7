"""Column functions on numbers, dates and ordinal qualities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Ordinal qualities, lowest first.
QUALITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def prices_close(left: Column, right: Column, share: float = 0.05) -> Column:
    """Whether two prices are within a share of the larger; false if either is missing or both are 0."""
    top = F.greatest(left, right)
    return F.coalesce((top > 0) & (F.try_divide(F.abs(left - right).cast("double"), top.cast("double")) <= share), F.lit(False))


def dates_close(left: Column, right: Column, days: int) -> Column:
    return F.coalesce(F.abs(F.datediff(left, right)) <= days, F.lit(False))


def add_months(day: Column, months: int) -> Column:
    return F.add_months(day, months)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def comp_window_start(as_of: Column, months: int) -> Column:
    """First day of the as-of month, whole years back; months beyond whole years don't count."""
    return F.make_date(F.year(as_of) - months // 12, F.month(as_of), F.lit(1))


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def probability(x: Column) -> Column:
    return clip(x, 1e-6, 1 - 1e-6)


def round_half_up(x: Column, places: int) -> Column:
    """Rounding that agrees between engines on doubles of either sign."""
    scale = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def display_probability(p: Column) -> Column:
    """A percentage in steps of five, halves up, as text."""
    return F.concat(clip(F.floor(p * 100 / 5 + 0.5) * 5, 0, 100).cast("int").cast("string"), F.lit("%"))


def calibration_band(p: Column) -> Column:
    """The step of five per cent that a probability falls to, halves to the even step."""
    return (F.bround(p * 100 / 5, 0) * 5).cast("int")


def or_default(value: Column, default: Column | float) -> Column:
    """The value, or the default where it is missing or 0."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), default if isinstance(default, Column) else F.lit(default))


def quality_rank(quality: Column) -> Column:
    """1 to 3; missing and unknown qualities count as the lowest."""
    out = F.when(quality == "HIGH", QUALITY_RANK["HIGH"]).when(quality == "MEDIUM", QUALITY_RANK["MEDIUM"])
    return out.otherwise(QUALITY_RANK["LOW"])


def quality_name(rank: Column) -> Column:
    return F.when(rank >= 3, "HIGH").when(rank == 2, "MEDIUM").otherwise("LOW")


def lowest_quality(*qualities: Column) -> Column:
    ranks = [quality_rank(q) for q in qualities]
    return quality_name(F.least(*ranks) if len(ranks) > 1 else ranks[0])


def reasons(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(code)) for hit, code in rules]))


def first_that_holds(rules: list[tuple[Column, str]], other: str | None) -> Column:
    """The value of the first rule that holds."""
    start = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    return reduce(lambda out, rule: out.when(F.coalesce(rule[0], F.lit(False)), rule[1]), rules[1:], start).otherwise(F.lit(other))


def normalized_mix(mix: Column) -> Column:
    """A map of weights scaled to add up to 1; weights that are missing or below 0 count as 0."""
    clean = F.transform_values(mix, lambda _, v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(F.map_values(clean), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform_values(clean, lambda _, v: v / total))
