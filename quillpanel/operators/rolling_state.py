"""Rolling totals kept as a versioned daily state.

One state row per entity and day holds the day's own amounts and the totals of
each trailing period. Three ways to a state row, all the same recurrence:

    total(day) = total(day - 1) + arrived(day) - arrived(day - period)

``bootstrap`` runs it over the history that is there when a state is set up,
``advance`` does one further day by a join of yesterday's totals, today's
arrivals and the amounts that expire, ``correct`` adds the difference that a
late or changed amount makes to the dates it touches. Amounts are decimals, so
adding and taking away leaves nothing behind and the three agree to the last
digit. ``RollingState`` keeps the rows in the shared folder, a version for each
load, step or correction, with the days that steps still look at as partitions
of their own.

A state is sparse: an entity has rows from an amount's day to the last day whose
longest period holds it. Where there is no row all totals are nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillpanel.runtime import new_folder

#: Digits of an amount, those behind the point included; a total has ten more, so no sum over a period overflows.
DIGITS = 28
#: What an amount that cannot be added counts among the days with a value, beside one.
BEYOND = 1 << 32


def daily_amounts(tables: Sequence[tuple[DataFrame, Column, Column, Mapping[str, Column]]], scales: Mapping[str, int], anchor: str) -> DataFrame:
    """One row per entity and day out of several tables: ``(entity, day, <measure>..., <measure>_n..., anchored)``.

    ``tables`` gives of each its entity, day and measures, ``scales`` the decimals
    kept of each measure. Of several rows for a day the largest value counts, so
    repeated rows count once; the aggregate is map-side combined, and an entity
    repeated without end is still one row per day. Rows without entity or day are
    left out; null and NaN are no amount. ``<measure>_n`` is 1 for a day with an
    amount and ``BEYOND`` more for an infinite one or one too large for ``DIGITS``:
    that makes the totals it belongs to unknown.
    ``anchored`` marks days on which the table holding measure ``anchor`` has a
    row, whatever its values.
    """
    parts = None
    for rows, entity, day, values in tables:
        number = lambda m: F.when(~F.isnan(values[m].cast("double")), values[m].cast("double")) if m in values else F.lit(None).cast("double")  # noqa: B023, E731
        part = rows.select(entity.alias("entity"), day.alias("day"), F.lit(anchor in values).alias("anchored"), *[number(m).alias(m) for m in scales]).where("entity is not null and day is not null")
        parts = part if parts is None else parts.unionByName(part)
    daily = parts.groupBy("entity", "day").agg(*[F.max(m).alias(m) for m in scales], F.max("anchored").alias("anchored"))
    exact = {m: F.col(m).try_cast(f"decimal({DIGITS},{s})") for m, s in scales.items()}
    return daily.select(
        "entity", "day", *[c.alias(m) for m, c in exact.items()],
        *[F.when(c.isNotNull(), 1).when(F.col(m).isNotNull(), 1 + BEYOND).otherwise(0).cast("long").alias(f"{m}_n") for m, c in exact.items()], "anchored",
    )


def _own(measures: Sequence[str]) -> list[str]:
    return [c for m in measures for c in (m, f"{m}_n")]


def _lanes(measures: Sequence[str], of=F.col) -> dict[str, Column]:
    """What is added up of each measure: the amount, and the days with one."""
    none = F.lit(0).cast("long")
    return {k: v for m in measures for k, v in ((f"{m}_total", F.coalesce(of(m), none)), (f"{m}_days", F.coalesce(of(f"{m}_n"), none)))}


def bootstrap(daily: DataFrame, measures: Sequence[str], periods: Sequence[int], through: Column | None = None) -> DataFrame:
    """State rows of a whole history, up to ``through`` where that is later than an entity's last row.

    One exchange by entity; days per entity are bounded by the calendar, not by
    the number of input rows.
    """
    longest = max(periods)
    by_day = Window.partitionBy("entity").orderBy("day")
    held = F.date_add("day", longest - 1)  # the last day whose longest period holds this one
    last = F.col("day") if through is None else F.greatest(F.col("day"), F.least(through, held))
    upto = F.least(held, F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), last))
    row = daily.withColumn("_upto", upto)
    there = F.col("_quiet") == 0
    dense = row.select("entity", F.posexplode(F.sequence("day", "_upto")).alias("_quiet", "_on"), *[F.when(there, F.col(c)).alias(c) for c in _own(measures)], (there & F.col("anchored")).alias("anchored"))
    dense = dense.withColumnRenamed("_on", "day").drop("_quiet")
    # Rows of an entity follow each other day by day, but for gaps before which everything has expired: so many rows back is so many days back.
    sofar = by_day.rowsBetween(Window.unboundedPreceding, 0)
    lanes = _lanes(measures)
    steps = dense.select("*", *[c.alias(f"_{k}") for k, c in lanes.items()])
    steps = steps.select("*", *[(F.col(f"_{k}") - F.coalesce(F.lag(f"_{k}", p).over(by_day), F.lit(0).cast("long"))).alias(f"_{k}_{p}") for k in lanes for p in periods])
    return steps.select("entity", "day", "anchored", *_own(measures), *[_sized(F.sum(f"_{k}_{p}").over(sofar), k, measures, daily).alias(f"{k}_{p}") for k in lanes for p in periods])


def _sized(c: Column, lane: str, measures: Sequence[str], amounts: DataFrame) -> Column:
    """Totals as decimals with the measure's decimals, counts as longs."""
    m = lane.removesuffix("_total")
    return c.cast(f"decimal(38,{amounts.schema[m].dataType.scale})") if lane.endswith("_total") and m in measures else c.cast("long")


def advance(state: DataFrame, arrivals: DataFrame, day: dt.date, measures: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """The rows of ``day``: yesterday's totals joined with the day's arrivals and the amounts that expire.

    Of ``state``, rows with a ``version``, only the day before and the days that
    expire are looked at, of each its newest version. An entity that nothing is
    left of has no row.
    """
    # As text: a step is a small job, and a plan put together column by column would take longer than it.
    on = lambda n: f"day = date'{day - dt.timedelta(n)}'"
    own = _own(measures)
    lanes = {f"{m}_{lane}": c for m in measures for lane, c in (("total", m), ("days", f"{m}_n"))}
    newest = lambda cols, n: f"max_by(struct({', '.join(cols)}), if({on(n)}, version, null))"
    held = state.where(" or ".join(on(n) for n in sorted({1, *periods}))).groupBy("entity").agg(
        F.expr(newest([f"{k}_{p}" for k in lanes for p in periods], 1)).alias("_held"), *[F.expr(newest(own, p)).alias(f"_old_{p}") for p in periods]
    )
    today = arrivals.where(on(0)).select("entity", F.struct("anchored", *own).alias("_new"))
    totals = []
    for m in measures:
        for k, kind in ((f"{m}_total", f"decimal(38,{arrivals.schema[m].dataType.scale})"), (f"{m}_days", "bigint")):
            totals += [f"cast(coalesce(_held.{k}_{p}, 0L) + coalesce(_new.{lanes[k]}, 0L) - coalesce(_old_{p}.{lanes[k]}, 0L) as {kind}) as {k}_{p}" for p in periods]
    rows = held.join(today, "entity", "full").selectExpr(
        "entity", f"date'{day}' as day", "coalesce(_new.anchored, false) as anchored", *[f"coalesce(_new.{c}, 0L) as {c}" if c.endswith("_n") else f"_new.{c} as {c}" for c in own], *totals
    )
    return rows.where(" or ".join(["anchored", *[f"{m}_days_{max(periods)} > 0" for m in measures]]))


def correct(versions: DataFrame, corrections: DataFrame, measures: Sequence[str], periods: Sequence[int], through: Column) -> DataFrame:
    """New versions of the rows that ``corrections`` (rows as of ``daily_amounts``) touch, and of no others.

    A correction states a day's amounts as they should have been, for any entity
    and day up to ``through``, the state's last; where the state has no row, one
    is made. Of ``versions`` the newest of each entity and day counts, and only the
    dates from a corrected day to the end of its longest period matter.
    """
    longest = max(periods)
    key = Window.partitionBy("entity", "day").orderBy(F.desc("version"))

    def with_newest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``rows``, one an entity and day, with ``columns`` of the newest version; what is not asked for is not sorted."""
        both = rows.join(versions.select("entity", "day", "version", *columns), ["entity", "day"], "left")
        return both.withColumn("_place", F.row_number().over(key)).where("_place = 1").drop("_place", "version")

    fixed = corrections.select("entity", "day", F.struct("anchored", *_own(measures)).alias("_fixed"))
    new, old = _lanes(measures, lambda c: F.col(f"_fixed.{c}")), _lanes(measures)
    spread = with_newest(fixed, _own(measures)).select(
        "entity", F.posexplode(F.sequence("day", F.greatest(F.col("day"), F.least(through, F.date_add("day", longest - 1))))).alias("_after", "_on"),
        F.col("_fixed"), *[(new[k] - old[k]).alias(f"_{k}") for k in new],
    )
    # The row of the corrected day itself carries what the day is now.
    shift = spread.groupBy("entity", F.col("_on").alias("day")).agg(
        F.max(F.col("_after") == 0).alias("_is_fixed"), *[F.max(F.when(F.col("_after") == 0, F.col(f"_fixed.{c}"))).alias(f"_fixed_{c}") for c in ("anchored", *_own(measures))], *[F.sum(F.when(F.col("_after") < p, F.col(f"_{k}"))).alias(f"_{k}_{p}") for k in new for p in periods]
    )
    touched = with_newest(shift, ["anchored", *_own(measures), *[f"{k}_{p}" for k in new for p in periods]])
    none = F.lit(0).cast("long")
    own = lambda c: F.when(F.col("_is_fixed"), F.col(f"_fixed_{c}")).otherwise(F.col(c))
    return touched.select(
        "entity", "day", F.coalesce(own("anchored"), F.lit(False)).alias("anchored"), *[F.coalesce(own(c), none).alias(c) if c.endswith("_n") else own(c).alias(c) for c in _own(measures)],
        *[_sized(F.coalesce(f"{k}_{p}", none) + F.coalesce(f"_{k}_{p}", none), k, measures, corrections).alias(f"{k}_{p}") for k in new for p in periods],
    )


def publish(versions: DataFrame, measures: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Totals, averages over the days with a value, and their number, for every day from the first anchored day to the last.

    Takes the newest version of each day. Without a value in the period the total
    is 0 and the average null; with an amount beyond what can be added both are null.
    One exchange by entity and one sort.
    """
    lanes = _lanes(measures)
    totals = [f"{k}_{p}" for k in lanes for p in periods]
    whole = Window.partitionBy("entity")
    by_day = whole.orderBy("day")
    newest = versions.repartition("entity").withColumn("_prior", F.lag("day").over(whole.orderBy("day", F.desc("version")))).where("_prior is null or _prior <> day")
    on = F.when(F.col("anchored"), F.col("day"))
    span = newest.select("entity", "day", *totals, F.lead("day").over(by_day).alias("_next"), F.min(on).over(whole).alias("_first"), F.max(on).over(whole).alias("_last")).where("day between _first and _last")
    # Days without a row follow days whose amounts have all expired after them.
    dense = span.select("entity", F.posexplode(F.sequence("day", F.greatest(F.col("day"), F.least(F.col("_last"), F.date_sub(F.coalesce("_next", F.date_add("day", 1)), 1))))).alias("_gap", "_on"), *totals)
    out = [F.col("entity"), F.col("_on").alias("day")]
    for m in measures:
        for p in periods:
            n, total = F.when(F.col("_gap") == 0, F.col(f"{m}_days_{p}")).otherwise(0), F.when(F.col("_gap") == 0, F.col(f"{m}_total_{p}")).otherwise(F.lit(0).cast("long"))
            total, days = F.when(n < BEYOND, total).cast("double"), F.pmod(n, F.lit(BEYOND))
            out += [total.alias(f"{m}_total_{p}"), F.when(days > 0, total / days).alias(f"{m}_avg_{p}"), days.alias(f"{m}_days_{p}")]
    return dense.select(*out)


class RollingState:
    """A state in the shared folder: ``version=<n>/kept=<part>/``.

    ``kept`` is the day itself for the days that steps and corrections still look
    at one by one, those of the longest period before the load and all after it;
    older ones lie together by year. A filter on it prunes what a step reads to
    the few days it needs. Versions are only added, so a lost job leaves none half
    read: what it wrote is read again only under the version that follows.
    """

    def __init__(self, spark: SparkSession, measures: Sequence[str], periods: Sequence[int], path: str | None = None):
        self.spark, self.measures, self.periods = spark, list(measures), list(periods)
        self.path = path or new_folder(spark, "rolling-state")
        self.version, self.through, self.open_from, self.schema = -1, None, None, None

    def _kept(self) -> Column:
        return F.when(F.col("day") >= F.lit(self.open_from), F.col("day")).otherwise(F.trunc("day", "year"))

    def _write(self, rows: DataFrame) -> None:
        self.version += 1
        self.schema = self.schema or rows.schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        rows.withColumn("kept", self._kept()).write.partitionBy("kept").mode("overwrite").parquet(f"{self.path}/version={self.version}")

    def read(self) -> DataFrame:
        """All rows of all versions, with ``version`` and ``kept``."""
        fields = [T.StructField(f.name, f.dataType) for f in self.schema] + [T.StructField("version", T.IntegerType()), T.StructField("kept", T.DateType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)

    def load(self, daily: DataFrame, through: dt.date) -> None:
        """The first version: everything in ``daily`` up to ``through``."""
        self.through, self.open_from = through, through - dt.timedelta(max(self.periods))
        upto = F.lit(through)
        rows = bootstrap(daily.where(F.col("day") <= upto), self.measures, self.periods, through=upto)
        # Rebalanced: a part's rows lie in few files, and a large part is not one task.
        self._write(rows.withColumn("_kept", self._kept()).hint("rebalance", F.col("_kept")).drop("_kept"))

    def advance(self, arrivals: DataFrame) -> None:
        """One day further; ``arrivals`` may hold rows of other days, which are not looked at."""
        day = self.through + dt.timedelta(1)
        needed = [day - dt.timedelta(n) for n in sorted({1, *self.periods})]
        self._write(advance(self.read().where(F.col("kept").isin(needed)), arrivals, day, self.measures, self.periods))
        self.through = day

    def correct(self, corrections: DataFrame) -> None:
        """A version with the rows that late or changed amounts touch; days after the state's last are an error."""
        on = corrections.select("day", F.explode(F.sequence("day", F.date_add("day", max(self.periods) - 1))).alias("on"))
        last = on.agg(F.max("day")).first()[0]
        if last is None:
            return
        if last > self.through:
            raise ValueError(f"{last} is not in the state yet: its rows are arrivals")
        # Parts are years and the days of the open period: as many as the calendar has.
        parts = [r[0] for r in on.select(F.when(F.col("on") >= F.lit(self.open_from), F.col("on")).otherwise(F.trunc("on", "year"))).distinct().collect()]
        self._write(correct(self.read().where(F.col("kept").isin(parts)), corrections, self.measures, self.periods, F.lit(self.through)))

    def published(self) -> DataFrame:
        return publish(self.read(), self.measures, self.periods)
