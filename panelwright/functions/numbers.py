"""Numeric, date and array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half up, towards plus infinity, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, to 1.5e-7."""
    t = 1 / (1 + F.abs(x) * 0.3275911)
    poly = reduce(lambda acc, c: acc * t + c, [-1.453152027, 1.421413741, -0.284496736, 0.254829592], F.lit(1.061405429))
    y = 1 - poly * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


#: Acklam's rational approximation of the inverse normal, fixed values: numerators and denominators of the
#: middle and of the tails.
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def polynomial(x: Column, coefficients) -> Column:
    """Coefficients from the highest power."""
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def probit(p: Column) -> Column:
    """Inverse normal, to 1.2e-9; minus and plus infinity at and beyond 0 and 1."""
    low = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.log(low))
    tail = polynomial(q, TAIL_TOP) / polynomial(q, TAIL_BOTTOM)
    r = (p - 0.5) * (p - 0.5)
    middle = polynomial(r, MIDDLE_TOP) * (p - 0.5) / polynomial(r, MIDDLE_BOTTOM)
    inside = F.when(low >= 0.02425, middle).when(p < 0.5, tail).otherwise(-tail)
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).otherwise(inside)


def expected_max_normals(n: Column) -> Column:
    """Blom's approximation of the mean of the largest of n standard normals; 0 for none."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(probit((n - 0.375) / (n + 0.25)))


def shrunk_ratio(x: Column, mean: Column, n: Column, k: float) -> Column:
    """1 + n / (n + k) * (x / mean - 1); 1 where the mean is missing or zero."""
    return F.coalesce(1 + n / (n + k) * (F.try_divide(x, mean) - 1), F.lit(1.0))


def implied_total(total: Column, spread: Column, home: Column) -> Column:
    """Half of the total, less half of the spread for the home side and plus it for the other."""
    return total / 2 - F.when(home == 1, spread / 2).otherwise(-spread / 2)


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it; else each use repeats x's whole expression."""
    return F.element_at(F.transform(F.array(x), f), 1)


def multiply32(a: Column, c: int) -> Column:
    """a * c modulo 2**32 for a below 2**32, in two halves, so that no product passes 63 bits."""
    low, high = c & 0xFFFF, c >> 16
    return let(a, lambda v: (v * low + F.shiftleft((v * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK)))


def mix32(x: Column) -> Column:
    """The finaliser of MurmurHash3, its fixed shifts and factors."""
    folded = lambda a, n: let(a, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))
    x = multiply32(folded(x.bitwiseAND(F.lit(MASK)), 16), 0x85EBCA6B)
    return folded(multiply32(folded(x, 13), 0xC2B2AE35), 16)


def keyed_draw(*keys: Column) -> Column:
    """A uniform number in [0, 1) of 53 bits that depends on its keys alone, not on order, partition or retry.
    The first key may name what the draw is for."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def keyed_normal(*keys: Column) -> Column:
    """A standard normal of two such draws (Box and Muller)."""
    far, turn = (keyed_draw(F.lit(part), *keys) for part in ("far", "turn"))
    return F.sqrt(-2 * F.log1p(-far)) * F.cos(2 * F.pi() * turn)


def interpolate(x: Column, knots: Column, values: Column) -> Column:
    """Piecewise linear through (knots, values), flat outside; knots ascend."""
    n = F.size(knots)
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(knots, lambda k: k <= x))))
    x0, x1 = F.element_at(knots, i), F.element_at(knots, i + 1)
    y0, y1 = F.element_at(values, i), F.element_at(values, i + 1)
    inside = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(x <= F.element_at(knots, 1), F.element_at(values, 1)).when(x >= F.element_at(knots, -1), F.element_at(values, -1)).otherwise(inside)


def trapezoid_mean(knots: Column, values: Column) -> Column:
    """The integral of the piecewise linear function over its knots, over their range."""
    n = F.size(knots)
    steps = F.sequence(F.lit(1), n - 1)
    area = F.aggregate(
        steps, F.lit(0.0), lambda acc, i: acc + (F.element_at(knots, i + 1) - F.element_at(knots, i)) * (F.element_at(values, i + 1) + F.element_at(values, i)) / 2
    )
    return area / (F.element_at(knots, -1) - F.element_at(knots, 1))


def tier_bonus(x: Column, tiers: list[tuple[float, float]]) -> Column:
    """The sum of the points of every threshold reached."""
    return reduce(lambda acc, t: acc + F.when(x >= t[0], F.lit(float(t[1]))).otherwise(0.0), tiers, F.lit(0.0))


def ladder(x: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """The points of the first step (upper limit, points) that x does not pass."""
    out = None
    for limit, points in steps:
        out = F.when(x <= limit, F.lit(float(points))) if out is None else out.when(x <= limit, F.lit(float(points)))
    return F.lit(beyond) if out is None else out.otherwise(F.lit(float(beyond)))


def scored(rules: dict[str, float]) -> Column:
    """Points by rules: the sum of each column, as a number, times its weight; what is no number counts zero."""
    return reduce(lambda acc, cw: acc + F.coalesce(F.col(cw[0]).try_cast("double"), F.lit(0.0)) * F.lit(float(cw[1])), rules.items(), F.lit(0.0))


def clamped_at(values: Column, rank: Column) -> Column:
    """values[rank], from 1, a rank beyond the end taking the last."""
    return F.element_at(values, F.greatest(F.lit(1), F.least(rank, F.size(values))).cast("int"))


def cyclic_at(values: Column, period: Column) -> Column:
    """values[period], from 1, starting over behind the end."""
    return F.element_at(values, (F.pmod(period - 1, F.size(values)) + 1).cast("int"))


def age_years(born: Column, at: Column, year: float = 365.25) -> Column:
    """Years of `year` days, kept within 15 and 50, to two digits."""
    return half_up(clamp(F.datediff(at, born) / year, 15.0, 50.0), 2)


def in_preseason(day: Column) -> Column:
    """From 1 August to 7 September."""
    return (F.month(day) == 8) | ((F.month(day) == 9) & (F.dayofmonth(day) <= 7))


def kickoff_wall_clock(at: Column, zone: str = "America/New_York") -> tuple[Column, Column]:
    """(day of week, hh:mm) of an instant in a zone."""
    local = F.from_utc_timestamp(at, zone)
    return F.date_format(local, "E"), F.date_format(local, "HH:mm")


def age_hours(at: Column, now: Column, date_only: Column) -> Column:
    """Hours since an instant; a bare date counts as the end of its day."""
    then = F.unix_timestamp(at) + F.when(date_only, 86400).otherwise(0)
    return F.greatest(F.lit(0.0), (F.unix_timestamp(now) - then) / 3600)
