"""GPU utilisation: long form, per-unit means, histogram and bands.

A wide table with thousands of unit columns is turned into long rows
``(time, unit, util)`` first (one ``posexplode``), so the mean per unit is an
ordinary grouped aggregate (partial aggregation per task, one small row
per unit and task in the shuffle) instead of one row with thousands of
aggregate columns that falls out of whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import BinSpec, bin_index, bin_label
from ..functions.states import lit_sql, q

# Utilisation zones named in the study, by band lower edge
# in percent; 60-70 is not named there and stays "unclassified".
UTIL_ZONES = (("low", 0, 20), ("mid", 20, 60), ("high", 70, 100))
UNCLASSIFIED = "unclassified"
UTIL_BANDS = BinSpec(0, 100, 10)


def wide_to_long(wide: DataFrame, time_col: str = "time", unit_col: str = "unit",
                 value_col: str = "util", names: Mapping[str, str] | None = None) -> DataFrame:
    """``time, c1 .. cn`` -> ``time, unit, util`` (one row per cell).

    ``names`` maps a positional column name back to its original header
    (as returned by ``sources.readers.rename_wide``). Cells are try_cast to
    double, so text cells from a CSV become numbers or NULL.

    The cells of a row go into one array that ``posexplode`` turns into rows;
    the unit name is looked up by position. That is one generator however
    many units there are — ``unpivot`` would plan one projection per column,
    which for thousands of GPUs is ~10x slower to plan and to run.
    """
    units = [c for c in wide.columns if c != time_col]
    cells = ", ".join(f"try_cast({q(c)} AS double)" for c in units)
    labels = ", ".join(lit_sql((names or {}).get(c, c)) for c in units)
    return (wide.selectExpr(q(time_col), f"posexplode(array({cells})) AS (_pos, {q(value_col)})")
            .selectExpr(q(time_col), f"element_at(array({labels}), _pos + 1) AS {q(unit_col)}",
                        q(value_col)))


def unit_means(long: DataFrame, unit: str = "unit", value: str = "util",
               by: Sequence[str] = (), digits: int | None = None,
               out: str = "mean_util") -> DataFrame:
    """Mean utilisation per unit (NULL samples ignored), as it is or rounded to ``digits``.

    Rounding makes the result independent of summation order, which in turn
    depends on partitioning.
    """
    m = F.avg(value)
    if digits is not None:
        m = F.round(m, digits)
    return long.groupBy(*by, unit).agg(m.alias(out))


def histogram(values: DataFrame, value: str = "mean_util", bins: int = 10,
              by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over ``[min, max]``, last bin closed — the
    binning rule of ``numpy.histogram`` (and so of ``plt.hist``).

    Output: ``*by, bin, bin_lo, bin_hi, n``; every bin is present (empty
    ones with 0). Edges are ``lo + i * (hi - lo) / bins``; a value goes to
    ``floor((x - lo) * (bins / (hi - lo)))``, corrected by one step against
    those edges. When all values are equal the range is widened by 0.5 on
    both sides, as numpy does.

    Without ``by`` the range comes from one scalar subquery (Catalyst merges
    the min and max), evaluated once, no join; with ``by`` it is a
    per-group aggregate joined back on the group keys, whose size is the
    number of groups.
    """
    by = list(by)
    n = int(bins)
    x = q(value)
    if not by:
        r = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        rng = {"_mn": r.select("lo").scalar(), "_mx": r.select("hi").scalar()}
        data = values.withColumns(rng)
    else:
        ranged = values.groupBy(*by).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
        data = _with_range(values, ranged, by)
    # each step is its own projection over named columns, so the range is
    # computed once and not re-inlined into every sub-expression
    widen = ["*", "CASE WHEN _mn = _mx THEN _mn - 0.5D ELSE _mn END AS _lo",
             "CASE WHEN _mn = _mx THEN _mx + 0.5D ELSE _mx END AS _hi"]

    def edge(i: str) -> str:
        return f"CASE WHEN {i} = {n} THEN _hi ELSE CAST({i} AS DOUBLE) * ((_hi - _lo) / {n}.0D) + _lo END"

    hits = (data.where(F.col(value).isNotNull()).selectExpr(*widen)
            .selectExpr("*", f"least(CAST(floor(({x} - _lo) * ({n}.0D / (_hi - _lo))) AS INT), "
                             f"{n - 1}) AS _raw")
            .selectExpr("*", f"CASE WHEN {x} < {edge('_raw')} THEN _raw - 1 ELSE _raw END AS _down")
            .selectExpr(*[q(b) for b in by],
                        f"CASE WHEN {x} >= {edge('_down + 1')} AND _down <> {n - 1} "
                        f"THEN _down + 1 ELSE _down END AS bin", "1 AS w"))
    if not by:
        zeros = values.sparkSession.range(n).selectExpr("CAST(id AS INT) AS bin", "0 AS w")
        counts = hits.unionByName(zeros).groupBy("bin").agg(F.sum("w").alias("n"))
        counts = counts.withColumns(rng)
    else:
        zeros = ranged.selectExpr(*[q(b) for b in by], f"explode(sequence(0, {n - 1})) AS bin",
                                  "0 AS w")
        counts = hits.unionByName(zeros).groupBy(*by, "bin").agg(F.sum("w").alias("n"))
        counts = _with_range(counts, ranged, by)
    return counts.selectExpr(*widen).selectExpr(
        *[q(b) for b in by], "bin", f"{edge('bin')} AS bin_lo", f"{edge('bin + 1')} AS bin_hi", "n")


def _with_range(df: DataFrame, ranged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with its group's range; a NULL group is a group like any other."""
    keys = ranged.toDF(*[f"_g{i}" for i in range(len(by))], "_mn", "_mx")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(keys, same).drop(*[f"_g{i}" for i in range(len(by))])


def zone_of(lower_edge) -> F.Column:
    expr = None
    for name, zlo, zhi in UTIL_ZONES:
        cond = (lower_edge >= zlo) & (lower_edge < zhi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(UNCLASSIFIED)


def util_bands(values: DataFrame, value: str = "mean_util", spec: BinSpec = UTIL_BANDS,
               by: Sequence[str] = ()) -> DataFrame:
    """Units per fixed band (10-point bands by default) with a zone name.

    Output: ``*by, bin, label, zone, n_units``; every band present, plus an
    ``Unknown`` row (NULL bin) when some mean falls outside the bands.
    """
    by = list(by)
    hits = values.select(*by, bin_index(value, spec).alias("bin"), F.lit(1).alias("w"))
    if by:
        zeros = (values.select(*by).distinct()
                 .select(*by, F.explode(F.sequence(F.lit(0), F.lit(spec.nbins - 1))).alias("bin"),
                         F.lit(0).alias("w")))
    else:
        zeros = values.sparkSession.range(spec.nbins).select(F.col("id").cast("int").alias("bin"),
                                                             F.lit(0).alias("w"))
    counts = hits.unionByName(zeros).groupBy(*by, "bin").agg(F.sum("w").alias("n_units"))
    lower = F.lit(float(spec.lo)) + F.col("bin").cast("double") * F.lit(float(spec.width))
    return counts.select(*by, "bin", bin_label(F.col("bin"), spec).alias("label"),
                         F.when(F.col("bin").isNull(), F.lit(UNCLASSIFIED))
                         .otherwise(zone_of(lower)).alias("zone"),
                         "n_units")
