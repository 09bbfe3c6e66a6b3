"""Headline text: parsing, clean-up and the content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ways a timestamp may be written, tried in order.
TIMESTAMPS = ("yyyy-MM-dd HH:mm:ss VV", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")


def parse_utc(text: Column, formats: Sequence[str] = TIMESTAMPS) -> Column:
    """A naive UTC timestamp out of text in any of ``formats``, null where none fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def one_line(title: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(title, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def iso_time(moment: Column) -> Column:
    """ISO text, with microseconds only where there are any."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(moment, "SSSSSS") == "000000", whole).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def record_uid(ticker: Column, published_at: Column, title: Column) -> Column:
    """The content hash that names a headline: SHA-1 of ticker, time and title with bars between."""
    return F.sha1(F.concat_ws("|", ticker, iso_time(published_at), stripped(title)))
