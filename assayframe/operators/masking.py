"""Masking of secrets by member name and by the shape of a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.columns import as_column

# The marker, the names and the value shapes that count as secrets.
MARKER = "***REDACTED***"
ANYWHERE_NAMES = (
    "secrets?", "passwords?", "passwd", "passphrases?", "credentials?", "private_?keys?", "authorization", "auth_header", "oauth",
)
LAST_NAMES = ("api_?keys?", "access_?keys?", "signing_?keys?", "encryption_?keys?", "token", "pwd", "auth", "bearer")
FIRST_NAME = "auth_"
# A value may not start in the middle of a word; this form needs no look-behind.
WORD_START = "(^|[^A-Za-z0-9_])"
VALUE_SHAPES = (
    WORD_START + "sk-[A-Za-z0-9_-]{20,}",
    WORD_START + "gh[pousr]_[A-Za-z0-9]{36,}",
    WORD_START + "github_pat_[A-Za-z0-9_]{20,}",
    WORD_START + "hf_[A-Za-z0-9]{30,}",
    WORD_START + "AIza[0-9A-Za-z_-]{35}",
    WORD_START + "A[KS]IA[0-9A-Z]{16}",
    WORD_START + "xox[bapsr]-[0-9A-Za-z-]{10,}",
    "-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----",
    WORD_START + r"(?i:bearer)\s+[A-Za-z0-9._~+/=-]{20,}",
    r"(^|[^A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*",
)
# Plain texts one of which every text of the shape at the same place contains.
SHAPE_MARKS = (
    ("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("hf_",), ("AIza",), ("AKIA", "ASIA"), ("xox",),
    ("PRIVATE KEY",), ("bearer",), ("eyJ",),
)


def is_secret_name(name: str | Column) -> Column:
    """The name reads as the name of a credential, whatever its case and style."""
    split = F.regexp_replace(as_column(name), "([a-z0-9])([A-Z])", "$1_$2")
    plain = F.lower(F.regexp_replace(split, r"[-\s.]+", "_"))
    return (
        plain.rlike("(^|_)(" + "|".join(ANYWHERE_NAMES) + ")(_|$)")
        | plain.rlike("(^|_)(" + "|".join(LAST_NAMES) + r")\z")
        | plain.startswith(FIRST_NAME)
    )


def is_secret_value(text: str | Column) -> Column:
    """The text holds something shaped like a credential; NULL does not.

    A pattern runs only on texts that contain its plain mark, so ordinary long
    texts cost a few substring searches.
    """
    text = as_column(text)
    found = F.lit(False)
    for shape, marks in zip(VALUE_SHAPES, SHAPE_MARKS, strict=True):
        searched = F.lower(text) if marks == ("bearer",) else text
        marked = F.lit(False)
        for mark in marks:
            marked = marked | searched.contains(mark)
        found = found | (marked & text.rlike(shape))
    return F.coalesce(found, F.lit(False))


def mask_text(text: str | Column) -> Column:
    return F.when(is_secret_value(text), F.lit(MARKER)).otherwise(as_column(text))


def mask_map(values: str | Column) -> Column:
    """Mask a map of texts by name and by value."""
    return F.transform_values(
        as_column(values), lambda name, value: F.when(is_secret_name(name), F.lit(MARKER)).otherwise(mask_text(value))
    )


def _masked(value: Column, kind: T.DataType) -> Column:
    """Follow nested types; names mask everything but booleans, shapes mask texts."""
    if isinstance(kind, T.StringType):
        return mask_text(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _masked(item, kind.elementType))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.BooleanType):
            return value
        if isinstance(kind.valueType, T.StringType):
            return mask_map(value)
        inner = F.transform_values(value, lambda name, item: F.when(~is_secret_name(name), _masked(item, kind.valueType)))
        return inner
    if isinstance(kind, T.StructType):
        return F.struct(*[_named(field, value[field.name]).alias(field.name) for field in kind.fields])
    return value


def _named(field: T.StructField, value: Column) -> Column:
    plain = field.name
    secret = is_secret_name(F.lit(plain))
    if isinstance(field.dataType, T.BooleanType):
        return value
    if isinstance(field.dataType, T.StringType):
        return F.when(secret, F.lit(MARKER)).otherwise(mask_text(value))
    # A typed column cannot hold the marker: a secret number or structure becomes NULL.
    return F.when(~secret, _masked(value, field.dataType))


def mask(df: DataFrame) -> DataFrame:
    """Mask every column of a table; the names are part of the plan, so constant tests fold away."""
    return df.select(*[_named(field, F.col(f"`{field.name}`")).alias(field.name) for field in df.schema.fields])
