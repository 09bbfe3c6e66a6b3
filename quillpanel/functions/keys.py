"""Key clean-up and hashing as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may surround a key.
BLANKS = " \t\n\r ​　﻿"


def clean_ticker(col: Column | str) -> Column:
    """Upper case without surrounding blanks."""
    return F.upper(F.trim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def clean_uid(col: Column | str) -> Column:
    """Lower case without surrounding blanks."""
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def day(col: Column | str) -> Column:
    """A date as ``yyyy-MM-dd`` text."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """128 bits as two longs: xxhash64 under two seeds, with each field's null marked."""
    marked = [c for col in cols for c in (col.isNull(), col)]
    return F.xxhash64(F.lit(17), *marked), F.xxhash64(F.lit(7_046_029_254), *marked)


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a naive UTC timestamp (the session time zone is UTC)."""
    return F.unix_micros(col.cast("timestamp"))
