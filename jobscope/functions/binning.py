"""Fixed-width binning.

A ``BinSpec(lo, hi, width)`` describes bins ``[lo + i*w, lo + (i+1)*w)``
for ``i = 0 .. n-1``; the last bin also takes ``hi`` itself. A value above
``hi`` gets the overflow bin ``n`` if the spec names one (``">300"``),
otherwise NULL. NULL, negative-below-``lo`` and malformed values always
get a NULL bin, labelled ``Unknown``.

The bin is one arithmetic expression (constant-folded, codegen friendly)
instead of a chain of n range predicates; results are ordered by the
integer bin, never by the label text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .states import lit_sql, q

UNKNOWN_BIN = "Unknown"


@dataclass(frozen=True)
class BinSpec:
    lo: float
    hi: float
    width: float
    overflow_label: str | None = None

    def __post_init__(self):
        if self.width <= 0 or self.hi <= self.lo:
            raise ValueError(f"bad bin spec {self}")
        n = (self.hi - self.lo) / self.width
        if abs(n - round(n)) > 1e-9:
            raise ValueError(f"(hi - lo) must be a multiple of width: {self}")

    @property
    def nbins(self) -> int:
        return int(round((self.hi - self.lo) / self.width))

    def edge(self, i: int) -> float:
        return self.hi if i == self.nbins else self.lo + i * self.width

    def labels(self) -> list[str]:
        out = [f"{_fmt(self.edge(i))}-{_fmt(self.edge(i + 1))}" for i in range(self.nbins)]
        if self.overflow_label is not None:
            out.append(self.overflow_label)
        return out


def _fmt(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else repr(float(v))


def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def bin_index_sql(x_sql: str, spec: BinSpec) -> str:
    """SQL text of the bin index of ``x_sql`` under ``spec``."""
    n = spec.nbins
    x = f"CAST({x_sql} AS DOUBLE)"
    lo, w, hi = _d(spec.lo), _d(spec.width), _d(spec.hi)
    raw = f"CAST(floor(({x} - {lo}) / {w}) AS INT)"
    # One correction step against the exact edges, so a value that sits on
    # an edge lands where the comparisons ``edge_i <= x < edge_i+1`` put it
    # even when the division rounds across the edge.
    fixed = (f"CASE WHEN {x} < {lo} + CAST({raw} AS DOUBLE) * {w} THEN {raw} - 1 "
             f"WHEN {x} >= {lo} + CAST({raw} + 1 AS DOUBLE) * {w} THEN {raw} + 1 "
             f"ELSE {raw} END")
    over = str(n) if spec.overflow_label is not None else "CAST(NULL AS INT)"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} < {lo} THEN CAST(NULL AS INT) "
            f"WHEN {x} > {hi} THEN {over} WHEN {x} = {hi} THEN {n - 1} "
            f"ELSE least({fixed}, {n - 1}) END")


def bin_label_sql(index_sql: str, spec: BinSpec) -> str:
    labels = ", ".join(lit_sql(s) for s in spec.labels())
    return (f"coalesce(try_element_at(array({labels}), {index_sql} + 1), "
            f"{lit_sql(UNKNOWN_BIN)})")


def bin_index(x: Column | str, spec: BinSpec) -> Column:
    """Integer bin of ``x`` under ``spec`` (NULL when Unknown)."""
    if isinstance(x, str):
        return F.expr(bin_index_sql(q(x), spec))
    tmp = x.cast("double")
    n = spec.nbins
    raw = F.floor((tmp - F.lit(float(spec.lo))) / F.lit(float(spec.width))).cast("int")
    edge = lambda i: F.lit(float(spec.lo)) + i.cast("double") * F.lit(float(spec.width))
    fixed = (F.when(tmp < edge(raw), raw - 1)
             .when(tmp >= edge(raw + 1), raw + 1)
             .otherwise(raw))
    over = F.lit(n) if spec.overflow_label is not None else F.lit(None).cast("int")
    return (F.when(tmp.isNull() | F.isnan(tmp) | (tmp < F.lit(float(spec.lo))),
                   F.lit(None).cast("int"))
            .when(tmp > F.lit(float(spec.hi)), over)
            .when(tmp == F.lit(float(spec.hi)), F.lit(n - 1))
            .otherwise(F.least(fixed, F.lit(n - 1))))


def bin_label(index: Column | str, spec: BinSpec) -> Column:
    """Text label for a bin index; NULL index -> ``Unknown``."""
    if isinstance(index, str):
        return F.expr(bin_label_sql(q(index), spec))
    labels = F.array(*[F.lit(s) for s in spec.labels()])
    return F.coalesce(F.try_element_at(labels, index + 1), F.lit(UNKNOWN_BIN))


def with_bin(df, x: str, spec: BinSpec, bin_col: str = "bin", label_col: str = "label"):
    """Add ``bin_col`` and ``label_col`` for column ``x``."""
    return df.withColumns({bin_col: bin_index(x, spec)}) \
             .withColumns({label_col: bin_label(bin_col, spec)})


def bin_index_by_sql(x_sql: str, specs, key_sql: str) -> str:
    """Bin index with a different spec per key value (e.g. per cluster)."""
    arms = " ".join(f"WHEN {lit_sql(k)} THEN {bin_index_sql(x_sql, sp)}" for k, sp in specs.items())
    return f"CASE {key_sql} {arms} ELSE CAST(NULL AS INT) END"


def bin_label_by_sql(index_sql: str, specs, key_sql: str) -> str:
    arms = " ".join(f"WHEN {lit_sql(k)} THEN {bin_label_sql(index_sql, sp)}"
                    for k, sp in specs.items())
    return f"CASE {key_sql} {arms} ELSE {lit_sql(UNKNOWN_BIN)} END"
