"""Numeric helpers: ANSI-safe casts, exact sums and guarded shares.

Sums are plain double sums unless the caller names a ``scale``: then values
are taken as decimals with that many places, so that the result does not
depend on summation order (and so on partitioning), and the total is
converted back to double once, at the end. Values with more places are
rounded to them, and ``10^(38 - scale)`` is the largest one.

Each helper has a SQL-text form (``*_sql``) used by the operators to build
a whole projection in one call, and a Column form for callers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .states import q


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number_sql(x_sql: str, scale: int | None) -> str:
    """What to sum: the value itself, or an exact decimal of ``scale`` places."""
    return f"CAST({x_sql} AS {'double' if scale is None else f'decimal(38,{scale})'})"


def to_double_sql(x_sql: str) -> str:
    return f"try_cast({x_sql} AS double)"


def to_long_sql(x_sql: str) -> str:
    # through double only what is no integer: a double has 53 bits
    return f"coalesce(try_cast({x_sql} AS bigint), try_cast(try_cast({x_sql} AS double) AS bigint))"


def to_double(x: Column | str) -> Column:
    """String/number -> double; malformed or empty input becomes NULL."""
    return F.expr(to_double_sql(q(x))) if isinstance(x, str) else x.try_cast("double")


def mean_sql(x_sql: str, scale: int | None = None) -> str:
    return (f"try_divide(CAST(sum({number_sql(x_sql, scale)}) AS double), "
            f"CAST(count({x_sql}) AS double))")


def pct_sql(part_sql: str, whole_sql: str) -> str:
    return (f"coalesce(try_divide(CAST({part_sql} AS double) * 100.0D, "
            f"CAST({whole_sql} AS double)), 0.0D)")


def pct(part: Column | str, whole: Column | str) -> Column:
    """``part / whole * 100``; 0 when the whole is 0 or NULL."""
    if isinstance(part, str) and isinstance(whole, str):
        return F.expr(pct_sql(q(part), q(whole)))
    return F.coalesce(F.try_divide(_c(part).cast("double") * F.lit(100.0),
                                   _c(whole).cast("double")), F.lit(0.0))
