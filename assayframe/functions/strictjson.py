"""Strict JSON as column expressions, and the canonical encoding."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.columns import as_column

# Fixed value: the longest integer a record may hold, in characters.
MAX_INTEGER_CHARS = 64
_STRING_LITERAL = r'"(?:[^"\\]|\\.)*"'
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def strict_json(text: str | Column) -> Column:
    """Valid JSON without repeated keys, non-finite numbers or very long integers; NULL is not valid."""
    text = as_column(text)
    bare = F.regexp_replace(text, _STRING_LITERAL, '""')
    numbers = F.regexp_extract_all(bare, F.lit(_NUMBER), F.lit(1))

    def refused(token: Column) -> Column:
        real = token.rlike("[.eE]")
        overflow = real & (F.abs(token.try_cast("double")) == F.lit(float("inf")))
        return overflow | (~real & (F.length(token) > MAX_INTEGER_CHARS))

    # The parser stops after the first value.  Only a text that is one value and
    # nothing else is valid both as an array element and as an object member.
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    shape = element & member
    return F.coalesce(shape & ~F.exists(numbers, refused), F.lit(False))


@F.pandas_udf(T.BooleanType())
def is_canonical_line(lines: pd.Series) -> pd.Series:
    """Whether each line equals the compact, key-sorted encoding of what it parses to.

    Number spelling matters here and Spark's own JSON writer respells numbers,
    so the encoder runs on Arrow batches.
    """

    def same(line: str | None) -> bool:
        try:
            text = json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            return text == line and text.encode("utf-8") is not None
        except (TypeError, ValueError, RecursionError):
            return False

    return lines.map(same)


def sorted_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and no spaces; NULL members are written as null."""
    members = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})
