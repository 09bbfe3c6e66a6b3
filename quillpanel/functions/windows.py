"""Row-frame windows with a least number of values, as expressions over one window spec.

All of one spec share a single exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from quillpanel.functions.numbers import ratio


def rolling_mean(x: Column, w: WindowSpec, rows: int, least: int) -> Column:
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))


def rolling_std(x: Column, w: WindowSpec, rows: int, least: int) -> Column:
    """Sample standard deviation."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) >= least, F.stddev_samp(x).over(frame))


def rolling_z(x: Column, w: WindowSpec, rows: int, least: int) -> Column:
    return (x - rolling_mean(x, w, rows, least)) / (rolling_std(x, w, rows, least) + 1e-9)


def change(x: Column, w: WindowSpec, rows: int = 1) -> Column:
    """Relative change against the value ``rows`` rows before."""
    return ratio(x, F.lag(x, rows).over(w)) - 1


def forward_change(x: Column, w: WindowSpec) -> Column:
    return ratio(F.lead(x).over(w), x) - 1


def ewma(x: Column, w: WindowSpec, span: int = 3, rows: int = 60) -> Column:
    """Exponentially weighted mean over the values up to here, nulls skipped.

    Weights halve (span 3) per value, so what lies more than 60 rows back is
    below the precision of a double; the frame is that long. Meant for a window
    over the rows that have a value.
    """
    keep = 1 - 2.0 / (span + 1)
    values = F.collect_list(x).over(w.rowsBetween(1 - rows, 0))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["n"] * keep + v).alias("n"), (a["d"] * keep + 1).alias("d")), lambda a: ratio(a["n"], a["d"]))
