"""End-state shares by count and by GPU time.

One aggregation pass: every report label becomes a conditional count
(and, with a weight, a conditional exact sum) in the same ``groupBy``, so
Spark does a partial aggregate per task and shuffles one small row per
group and task. Shares are arithmetic on that row — no window, no join,
no second scan — and the row is then turned into one row per label with
``inline``, so a label that never occurs still gets its zero (P16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import number_sql, pct_sql
from ..functions.states import KNOWN_LABELS, REPORT_LABELS, UNKNOWN, lit_sql, q


def _slot(label: str) -> str:
    return label.lower()


def state_shares(jobs: DataFrame, by: Sequence[str] = (), weight: str | None = None,
                 scale: int | None = None, label_col: str = "state_label") -> DataFrame:
    """Share of jobs (or of ``weight``) per end-state label.

    Output, one row per group and report label (Completed, Canceled,
    Failed, Unknown — zero when absent):
    ``*by, state, state_order, n_jobs[, <weight>], pct_of_all, pct_of_known``.
    ``pct_of_known`` renormalises over the known labels and is NULL for
    Unknown. Shares are by ``weight`` when one is given, else by count;
    ``scale`` sums it as exact decimals with that many places.
    """
    by = list(by)
    lab = q(label_col)
    aggs = [f"count_if({lab} = {lit_sql(n)}) AS n_{_slot(n)}" for n in REPORT_LABELS]
    if weight is not None:
        # decimals with a scale: the totals below are exact sums, converted once
        aggs += [f"coalesce(sum(CASE WHEN {lab} = {lit_sql(n)} THEN {number_sql(q(weight), scale)} "
                 f"END), {number_sql('0', scale)}) AS w_{_slot(n)}" for n in REPORT_LABELS]
    wide = jobs.groupBy(*by).agg(*[F.expr(a) for a in aggs])

    m = "w" if weight is not None else "n"
    total = " + ".join(f"{m}_{_slot(n)}" for n in REPORT_LABELS)
    known = " + ".join(f"{m}_{_slot(n)}" for n in KNOWN_LABELS)
    rows = []
    for i, name in enumerate(REPORT_LABELS):
        s = _slot(name)
        fields = [f"'state', {lit_sql(name)}", f"'state_order', {i}", f"'n_jobs', n_{s}"]
        if weight is not None:
            fields.append(f"{lit_sql(weight)}, CAST(w_{s} AS double)")
        fields.append(f"'pct_of_all', {pct_sql(f'{m}_{s}', f'({total})')}")
        fields.append("'pct_of_known', " + ("CAST(NULL AS double)" if name == UNKNOWN
                                            else pct_sql(f"{m}_{s}", f"({known})")))
        rows.append(f"named_struct({', '.join(fields)})")
    return wide.selectExpr(*[q(b) for b in by], f"inline(array({', '.join(rows)}))")


def unsuccessful_breakdown(jobs: DataFrame, by: Sequence[str] = (), weight: str = "gpu_time",
                           scale: int | None = None, label_col: str = "state_label") -> DataFrame:
    """Cancelled jobs as a share of all unsuccessful jobs, by count and weight.

    Unsuccessful = every label but Completed (Unknown included).
    """
    lab = q(label_col)
    bad = f"{lab} <> 'Completed'"
    cancel = f"{lab} = 'Canceled'"
    w, zero = number_sql(q(weight), scale), number_sql("0", scale)
    agg = jobs.groupBy(*by).agg(*[F.expr(a) for a in (
        "count(1) AS n_jobs",
        f"count_if({bad}) AS n_unsuccessful",
        f"count_if({cancel}) AS n_canceled",
        f"CAST(coalesce(sum({w}), {zero}) AS double) AS {q(weight + '_all')}",
        f"CAST(coalesce(sum(CASE WHEN {bad} THEN {w} END), {zero}) AS double) "
        f"AS {q(weight + '_unsuccessful')}",
        f"CAST(coalesce(sum(CASE WHEN {cancel} THEN {w} END), {zero}) AS double) "
        f"AS {q(weight + '_canceled')}",
    )])
    return agg.selectExpr(
        "*",
        f"{pct_sql('n_unsuccessful', 'n_jobs')} AS pct_unsuccessful",
        f"{pct_sql('n_canceled', 'n_unsuccessful')} AS pct_canceled_of_unsuccessful",
        f"{pct_sql(q(weight + '_canceled'), q(weight + '_unsuccessful'))} "
        f"AS {q('pct_' + weight + '_canceled_of_unsuccessful')}",
    )
