"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_left(text: Column, width: int, fill: str = "0") -> Column:
    """Pad on the left to `width`; longer text is kept whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def dashed(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("-"))


def slice_text(text: Column, start: int, stop: int) -> Column:
    """Characters `start`..`stop`, counted from 1, both included."""
    return F.substring(text, start, stop - start + 1)


def character_from_end(text: Column, offset: int = 1) -> Column:
    """The one character `offset` places before the last."""
    return text.substr(F.length(text) - F.lit(offset), F.lit(1))


def mask_identifier(text: Column, pattern: str, replacement: str, width: int = 30) -> Column:
    """Rewrite an identifier by a caller's pattern and keep `width` characters.

    The masking rule itself belongs to the database that holds the identifiers,
    so the pattern is an argument.
    """
    return F.substring(F.regexp_replace(text, pattern, replacement), 1, width)


def glue(*parts: Column | str) -> Column:
    """Concatenate; a missing part counts as empty text."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]
    return F.concat(*columns)


def latin1_bytes(text: Column) -> Column:
    """Text as ISO-8859-1 bytes; null when a character has no such code."""
    return F.when(text.rlike(r"^[\x00-\xFF]*$"), F.encode(text, "ISO-8859-1"))
