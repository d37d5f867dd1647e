"""Optional ledger columns and their neutral values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("input", "cached_input", "output", "reasoning_output", "total")

_TYPES = {
    "duration_ms": "long", "authoritative": "boolean", "output": "string",
    "input": "string", "metadata": "string",
    "error_text": "string", "aborted": "boolean", "errored": "boolean", "ttft_ms": "long",
    "model": "string", "in_context": "boolean", "first_user": "string", "has_total": "boolean",
    "persisted_start": "long", "label": "string", "specific": "boolean",
    **{f"last_{c}": "long" for c in COUNTERS}, **{f"cum_{c}": "long" for c in COUNTERS},
}


def with_defaults(rows: DataFrame, *names: str) -> DataFrame:
    """Add the named optional columns as typed nulls where the ledger lacks them."""
    missing = {n: F.lit(None).cast(_TYPES[n]) for n in names if n not in rows.columns}
    return rows.withColumns(missing) if missing else rows
