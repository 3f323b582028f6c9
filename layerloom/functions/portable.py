"""Expressions that give the same values on every engine and in every order of rows."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the keys alone: 52 bits of an MD5 digest."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(4503599627370496.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def wilson(p: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval, clipped to [0, 1]."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return clip01(centre - half), clip01(centre + half)
