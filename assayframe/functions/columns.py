"""Column expressions for labels, identities, ranges and clocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings and formats that results depend on.
UNKNOWN_LABEL = "unknown"
CONTENT_ID_LENGTH = 16
CANDIDATE_ID_PATTERN = r"\A[0-9a-f]{16}\z"
BEAM_NAME_PATTERN = r"\A[a-z][a-z0-9_]*\z"
RUN_ID_PATTERN = r"\A[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}\z"
TIMESTAMP_PATTERN = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
RUN_ID_TIME_FORMAT = "yyyyMMdd'T'HHmmss'Z'"


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def case(branches: Iterable[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, NULL when none does."""
    (first, value), *rest = branches
    chosen = F.when(first, value)
    for condition, value in rest:
        chosen = chosen.when(condition, value)
    return chosen


def nan_to_null(value: str | Column) -> Column:
    """NaN means missing; Spark would otherwise sort and count it as a number."""
    return F.nanvl(as_column(value), F.lit(None).cast("double"))


def normalise_label(label: str | Column) -> Column:
    """A NULL or empty label is spelled ``unknown``."""
    return F.coalesce(F.nullif(as_column(label).cast("string"), F.lit("")), F.lit(UNKNOWN_LABEL))


def known_label(label: str | Column) -> Column:
    """The label, or NULL when it is ``unknown``."""
    return F.nullif(as_column(label), F.lit(UNKNOWN_LABEL))


def content_id(key: str | Column, label: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``key|label``."""
    text = F.concat_ws("|", as_column(key).cast("string"), normalise_label(label))
    return F.substring(F.sha2(text, 256), 1, CONTENT_ID_LENGTH)


def plain_structure_key(raw: str | Column) -> Column:
    """Default structure key: lower case, single spaces, words in order; NULL when nothing is left."""
    words = F.array_sort(F.filter(F.split(F.lower(F.trim(as_column(raw))), r"\s+"), lambda word: word != ""))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def in_range(value: str | Column, low: Column | float, high: Column | float) -> Column:
    """Inclusive range test; a missing value is outside."""
    return F.coalesce(as_column(value).between(low, high), F.lit(False))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded, 0.0 for an empty whole."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def spread_if_replicated(n: str | Column, std: str | Column) -> Column:
    """A spread exists only from two replicates on."""
    return F.when(as_column(n) >= 2, as_column(std))


def is_finite(value: str | Column) -> Column:
    value = as_column(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def ceil_div(value: str | Column, divisor: int) -> Column:
    """Integer ceiling of ``value / divisor``."""
    return F.floor((as_column(value) + F.lit(divisor - 1)) / F.lit(divisor)).cast("long")


def format_timestamp(ts: str | Column) -> Column:
    """UTC text to the second; the session time zone must be UTC."""
    return F.date_format(as_column(ts), TIMESTAMP_FORMAT)


def parse_timestamp(text: str | Column) -> Column:
    text = as_column(text)
    return F.when(text.rlike(TIMESTAMP_PATTERN), F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT)))


def make_run_id(ts: str | Column, token: str | Column) -> Column:
    """Run id: compact UTC timestamp, a dash and an 8-hex token; NULL for a bad token."""
    token = as_column(token)
    return F.when(
        token.rlike(r"\A[0-9a-f]{8}\z"),
        F.concat_ws("-", F.date_format(as_column(ts), RUN_ID_TIME_FORMAT), token),
    )


def matches(text: str | Column, pattern: str) -> Column:
    """Whole-text pattern test; NULL does not match."""
    return F.coalesce(as_column(text).rlike(pattern), F.lit(False))


def exact_sum(value: str | Column) -> Column:
    """A sum of doubles that does not depend on the order the rows arrive in."""
    return F.sum(as_column(value).cast("decimal(38,18)")).cast("double")


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "property", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)
