"""Implausible readings, judged by each source's own usual behaviour.

Peaks over threshold: per source and column, changes between successive
readings less their weekday's median are residuals; the exceedances of usual
ones over a high quantile get a generalised Pareto tail, whose cutoff at a fixed
risk tells what may be implausible from what the source does anyway. Only runs
entered by a reading over the cutoff are looked at for spikes. Beside it stand
rules for stuck and impossible readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest spike, in readings.
SPIKE = 3
#: Peaks that the shape of a tail is fitted to, at least.
LEAST_PEAKS = 10


def readings(rows: DataFrame, source: Column, day: Column, columns: Sequence[str]) -> DataFrame:
    """``(source, day, column, value)``: one reading per source, day and column.

    Repeated rows count once (the largest value of a day counts; map-side
    combined). Null, NaN and infinite readings, and rows without source or day, are none.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    long = rows.select(source.alias("source"), day.alias("day"), F.explode(pairs).alias("r")).select("source", "day", "r.column", "r.value")
    long = long.where("source is not null and day is not null and value is not null and not isnan(value) and abs(value) < double('infinity')")
    return long.groupBy("source", "day", "column").agg(F.max("value").alias("value"))


def judged(reading: DataFrame, tail_share: float = 0.05, risk: float = 0.01, distance: float = 10.0, stuck: int = 6) -> DataFrame:
    """Every reading with what is known of it.

    Columns: ``source, day, column, value``; ``impossible`` (zero or less);
    ``change`` and ``residual`` against the reading before (impossible ones set
    aside); ``usual`` (the median absolute change); ``threshold``, ``shape``,
    ``scale`` of the tail; its ``cutoff`` at ``risk``; ``peak`` (the residual
    exceeds the cutoff); ``rule``; ``spike``; ``stuck``.

    The tail is fitted to residuals of at most ``distance`` times ``usual``: those
    farther off, faulty readings and the returns from them, would be taken for the
    source's own behaviour. Shape and scale come from probability-weighted moments,
    with fewer than ten peaks the scale of an exponential tail. A source of which
    half the changes are nothing, or with no peaks, has no tail and no cutoff: all
    its readings are peaks.

    ``rule`` holds for one to three successive readings that lie, in log terms
    and to one side, more than ``distance`` times ``usual`` away from the reading
    before and the one after them, while these two lie within that distance of
    each other. ``spike`` holds where the first of such a run is a peak: a move
    that the source's own tail makes likely is none.
    ``stuck`` holds from the second on of ``stuck`` or more equal readings.

    All windows share one exchange by (source, column); a source has one reading
    a day, so a group is bounded by the calendar.
    """
    whole = Window.partitionBy("source", "column")
    inorder = whole.orderBy("day")
    seq = reading.where("value > 0").withColumn("y", F.log("value"))
    seq = seq.withColumns({f"y_{'m' if k < 0 else 'p'}{abs(k)}": F.lag("y", -k).over(inorder) for k in range(-SPIKE, SPIKE + 1) if k} | {"same": (F.lag("value").over(inorder) == F.col("value"))})
    at = lambda k: F.col("y") if k == 0 else F.col(f"y_{'m' if k < 0 else 'p'}{abs(k)}")
    # A reading is stuck when it equals the one before it and so many in a row around it do.
    equal = F.coalesce("same", F.lit(False)).cast("int")
    seq = seq.withColumns({"change": F.col("y") - F.col("y_m1"), "weekday": F.weekday("day"), "from_here": F.sum(equal).over(inorder.rowsBetween(0, stuck - 2)) == stuck - 1})
    seq = seq.withColumn("stuck", F.coalesce("same", F.lit(False)) & F.coalesce(F.max("from_here").over(inorder.rowsBetween(2 - stuck, 0)), F.lit(False)))
    seq = seq.withColumns({f"season_{k}": F.median(F.when(F.col("weekday") == k, F.col("change"))).over(whole) for k in range(7)})
    seq = seq.withColumn("season", F.coalesce(*[F.when(F.col("weekday") == k, F.col(f"season_{k}")) for k in range(7)])).drop(*[f"season_{k}" for k in range(7)])
    seq = seq.withColumn("residual", F.col("change") - F.col("season"))
    far = distance * F.col("usual")
    seq = seq.withColumn("usual", F.median(F.abs("change")).over(whole))
    seq = seq.withColumn("_r", F.when(F.abs("residual") <= far, F.abs("residual")))
    seq = seq.withColumns({"threshold": F.percentile("_r", F.lit(1 - tail_share)).over(whole), "_n": F.count("_r").over(whole)})
    seq = seq.withColumn("_excess", F.when((F.col("_r") > F.col("threshold")) & (F.col("usual") > 0), F.col("_r") - F.col("threshold")))
    seq = seq.withColumns({"_place": F.row_number().over(whole.orderBy(F.asc_nulls_last("_excess"))), "_peaks": F.count("_excess").over(whole)})
    # Probability-weighted moments of the generalised Pareto distribution.
    seq = seq.withColumns({"_a0": F.avg("_excess").over(whole), "_a1": F.avg(F.col("_excess") * (1 - (F.col("_place") - 0.35) / F.col("_peaks"))).over(whole)})
    ratio = F.when(F.col("_peaks") >= LEAST_PEAKS, F.try_divide(F.col("_a0"), F.col("_a0") - 2 * F.col("_a1")))
    seq = seq.withColumn("shape", F.when(F.col("_peaks") > 0, F.coalesce(2 - ratio, F.lit(0.0))))
    seq = seq.withColumn("scale", F.coalesce(2 * F.col("_a1") * ratio, F.col("_a0")))
    over_risk = F.try_divide(F.col("_peaks").cast("double"), F.col("_n") * F.lit(risk))
    growth = F.when(F.abs("shape") < 1e-6, F.log(over_risk)).otherwise(F.try_divide(F.pow(over_risk, F.col("shape")) - 1, F.col("shape")))
    seq = seq.withColumn("cutoff", F.col("threshold") + F.col("scale") * growth)
    seq = seq.withColumn("peak", F.abs("residual") > F.coalesce("cutoff", F.lit(-1.0)))
    seq = seq.withColumns({"peak": F.coalesce("peak", F.lit(False))} | {f"peak_m{k}": F.coalesce(F.lag("peak", k).over(inorder), F.lit(False)) for k in range(1, SPIKE)})

    rule = spike = F.lit(False)
    for length in range(1, SPIKE + 1):
        for offset in range(length):
            before, after = at(-offset - 1), at(length - offset)
            entered = F.col("peak") if offset == 0 else F.col(f"peak_m{offset}")
            back = F.abs(before - after) <= far
            above = below = back
            for k in range(-offset, length - offset):
                above = above & (at(k) - before > far) & (at(k) - after > far)
                below = below & (before - at(k) > far) & (after - at(k) > far)
            met = F.coalesce(above | below, F.lit(False))
            rule, spike = rule | met, spike | (entered & met)
    known = ["change", "residual", "usual", "threshold", "shape", "scale", "cutoff"]
    judged_ = seq.select("source", "day", "column", "value", F.lit(False).alias("impossible"), *known, "peak", rule.alias("rule"), spike.alias("spike"), "stuck")
    no = F.lit(False)
    impossible = reading.where("value <= 0").select(
        "source", "day", "column", "value", F.lit(True).alias("impossible"), *[F.lit(None).cast("double").alias(c) for c in known], no.alias("peak"), no.alias("rule"), no.alias("spike"), no.alias("stuck")
    )
    return judged_.unionByName(impossible)


def implausible(judgement: DataFrame) -> DataFrame:
    """The days of a source on which any column's reading is impossible, a spike or stuck."""
    return judgement.where("impossible or spike or stuck").select("source", "day").distinct()
