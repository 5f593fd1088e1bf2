"""Column expressions over vectors; one definition of each, used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Norms below this count as this, so a zero vector stays zero.
EPS = 1e-8


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(df: DataFrame, column: str = "v") -> DataFrame:
    """Rows divided by their norm; a zero row stays zero."""
    size = F.greatest(norm(F.col(column)), F.lit(EPS))
    rest = [c for c in df.columns if c != column]
    own = df.select(*rest, F.col(column), size.alias("__norm"))
    return own.select(*rest, F.transform(column, lambda x: x / F.col("__norm")).alias(column))


def sound(v: Column) -> Column:
    """Whether all components are finite numbers."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def exploded(df: DataFrame, *keys: str, column: str = "v") -> DataFrame:
    """keys, dim (from 0), x: a row for each component."""
    return df.select(*keys, F.posexplode(column).alias("dim", "x"))


def r6(c: Column) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def cell_of(dim: Column) -> tuple[Column, Column, Column]:
    """Row, column and orientation bin of a component of a 128-wide descriptor of 4 x 4 cells."""
    return (dim / 32).cast("int"), (dim / 8).cast("int") % 4, dim % 8
