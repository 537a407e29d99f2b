"""Lookup backends written in Python, with failures kept to the lookup they hit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def python_backend(lookups: DataFrame, lookup: Callable[[Any, str, Mapping[str, Any]], float | None]) -> DataFrame:
    """Add ``status, reason, value`` from ``lookup(candidate_id, property, row)``.

    Arrow batches stream through; an exception becomes ``error`` with its class
    name, nothing returned is ``missing``, and neither stops other lookups.
    """

    def one(row: Mapping[str, Any]) -> tuple[str, str | None, float | None]:
        try:
            value = lookup(row["candidate_id"], row["property"], row)
        except Exception as exc:  # noqa: BLE001 - every failure of a backend is an answer
            return "error", type(exc).__name__, None
        return ("missing", "value_absent", None) if value is None else ("ok", None, float(value))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [one(row) for row in part.to_dict("records")]
            yield part.assign(**{name: [a[i] for a in answers] for i, name in enumerate(("status", "reason", "value"))})

    schema = ", ".join(f"`{name}` {kind}" for name, kind in lookups.dtypes)
    return lookups.mapInPandas(batches, f"{schema}, status string, reason string, value double")
