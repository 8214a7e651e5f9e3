"""End-state labels.

Relabelling happens on every row *before* grouping, so several raw states
that all map to ``Unknown`` fall into one group and the denominator of a
share is right.

Expressions are built as SQL text and handed to Spark in one call
(``F.expr``); Catalyst sees the same CASE either way, but plan
construction needs one JVM round trip instead of one per node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw end state -> report label, in report order.
RAW_TO_LABEL = (
    ("COMPLETED", "Completed"),
    ("CANCELED", "Canceled"),
    ("FAILED", "Failed"),
)
UNKNOWN = "Unknown"
KNOWN_LABELS = tuple(label for _, label in RAW_TO_LABEL)
REPORT_LABELS = KNOWN_LABELS + (UNKNOWN,)


def q(name: str) -> str:
    """Quote a column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def lit_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def state_label_sql(raw_sql: str) -> str:
    arms = " ".join(f"WHEN {lit_sql(v)} THEN {lit_sql(l)}" for v, l in RAW_TO_LABEL)
    return f"CASE {raw_sql} {arms} ELSE {lit_sql(UNKNOWN)} END"


def state_label(raw: Column | str) -> Column:
    """Map a raw state to its report label; anything else (NULL too) is Unknown."""
    if isinstance(raw, str):
        return F.expr(state_label_sql(q(raw)))
    expr = None
    for value, label in RAW_TO_LABEL:
        expr = (F.when(raw == value, label) if expr is None
                else expr.when(raw == value, label))
    return expr.otherwise(UNKNOWN)
