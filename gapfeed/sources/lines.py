"""Captured output as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_lines(raw: DataFrame, text: str = "raw") -> DataFrame:
    """One row for each line, with its position from 0; the other columns stay. Null texts have no lines."""
    keep = [c for c in raw.columns if c != text]
    return raw.select(*keep, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line"))
