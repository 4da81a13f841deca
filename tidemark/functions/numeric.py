"""Small column helpers shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Added before rounding: means of amounts in cents often end exactly on half a unit of the sixth
# decimal, where the last bit of a sum would decide.
NUDGE = 3.7e-9


def r6(c: Column | str) -> Column:
    """Six decimals, off the exact halves, with negative zero folded into zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), 6) + F.lit(0.0)


def sql6(expr: str) -> str:
    """The same rounding as oracle text."""
    return f"(round({expr} + {NUDGE}::DOUBLE, 6) + 0.0)"


def round_columns(df: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Round every double column to six decimals, keeping names and order."""
    skip = skip or []
    return df.select(*[
        r6(f"`{n}`").alias(n) if t == "double" and n not in skip else F.col(f"`{n}`") for n, t in df.dtypes
    ])


def ratio(a: Column, b: Column) -> Column:
    """`a / b`, NULL when `b` is 0."""
    return F.when(b != 0, a / b)


# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]; NULL for an empty group."""
    nn = F.when(n > 0, n.cast("double"))
    p = hits / nn
    scale = 1.0 + z * z / nn
    centre = (p + z * z / (2.0 * nn)) / scale
    half = z * F.sqrt(p * (1.0 - p) / nn + z * z / (4.0 * nn * nn)) / scale
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def bucket_left_closed(x: Column, inner: list[float]) -> Column:
    """Index of the [edge, next edge) interval; NULL stays NULL."""
    total = F.lit(0)
    for e in inner:
        total = total + F.when(x >= F.lit(float(e)), 1).otherwise(0)
    return F.when(x.isNotNull(), total)


def bucket_right_closed(x: Column, inner: list[float]) -> Column:
    """Index of the (edge, next edge] interval; NULL stays NULL."""
    total = F.lit(0)
    for e in inner:
        total = total + F.when(x > F.lit(float(e)), 1).otherwise(0)
    return F.when(x.isNotNull(), total)
