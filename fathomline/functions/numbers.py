"""Number helpers shared by queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def micro(x: Column) -> Column:
    """To six decimals, halves up: the same in every engine, unlike round()."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def fixed(x: Column, digits: int) -> Column:
    """``x`` as a text of so many decimals, from the number's exact value, as C and Python print it.

    ``format_string`` rounds the shortest text that names the number instead:
    0.145, which lies a little below, would become 0.15. The product with the
    power of ten is taken in two parts that are exact, so what it leaves over
    the whole number is compared with one half without an error.
    """
    size, scale = F.abs(x), float(10**digits)
    wide = size * 134217729.0
    high = wide - (wide - size)
    whole = F.floor(size * scale).cast("double")
    over = (high * scale - whole - 0.5) + (size - high) * scale
    near = (whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0)) / scale
    return F.format_string(f"%.{digits}f", F.when(size < 1e12, F.when(x < 0, -near).otherwise(near)).otherwise(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def feature_map(*names: str) -> Column:
    """A map from feature to value at four decimals; what is not finite is 0."""
    finite = lambda c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf")), F.lit(0.0)).otherwise(F.bround(c, 4))
    return F.create_map(*[part for name in names for part in (F.lit(name), finite(name))])
