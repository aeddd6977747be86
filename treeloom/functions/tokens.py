"""Identifiers in a line: the one under a caret, and whole-word occurrence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IDENT = r"\p{IsAlphabetic}\p{N}_"


WORD = re.compile(r"\w+")


def token_at(text: str, column: int) -> str | None:
    """The identifier at a byte column: the character right of the caret counts, and where a word ends, that left of it.

    A caret inside a character stands right of it.
    """
    before = text.encode()[: max(column, 0)]
    at = sum(byte & 0xC0 != 0x80 for byte in before)  # characters that begin left of the caret
    return next((m[0] for m in WORD.finditer(text) if m.start() <= at <= m.end()), None)


@F.pandas_udf(StringType())
def tokens_at(text: pd.Series, column: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or c is None else token_at(t, int(c)) for t, c in zip(text, column, strict=True)])


def has_token(text: Column, name: Column) -> Column:
    """Does name stand in text as a whole word? Not between letters, digits or underscores."""
    escaped = F.regexp_replace(name, r"([\\.*+?^${}()|\[\]])", r"\\$1")
    pattern = F.concat(F.lit(f"(?<![{IDENT}])"), escaped, F.lit(f"(?![{IDENT}])"))
    return (name != "") & F.contains(text, name) & F.regexp_like(text, pattern)


def identifiers(text: str) -> list[str]:
    return WORD.findall(text)
