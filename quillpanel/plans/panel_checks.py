"""Queries of the general problems (1, 3, 5, 7) over their tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel.functions.keys import clean_ticker, clean_uid, day
from quillpanel.operators import orphans, rolling_state, salted, spikes
from quillpanel.plans.base import R, r6
from quillpanel.runtime import prepare, read, write_table

PERIODS = (7, 30)
#: Decimals kept of an amount.
SCALES = {"adj_close": 12, "volume": 4, "sent_mean": 15}
#: Decimals of published totals and averages.
PLACES = {"adj_close": 6, "volume": 2, "sent_mean": 6}
#: Days done one by one: more than the longest period, so that steps take off amounts that steps have put on.
STEPS = 32


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    text = lambda c: F.coalesce(c, F.lit(""))
    features, removals = read(spark, sf_dir, "features"), read(spark, sf_dir, "headline_removals")
    on_day = [clean_ticker("ticker"), F.col("date")]
    parents = [
        orphans.Parents("headline", read(spark, sf_dir, "headlines"), [clean_uid("headline_uid")]),
        orphans.Parents("headline", removals.where("restored_at is null"), [clean_uid("headline_uid")], withdrawn=F.lit(True), only_withdraws=True),
        orphans.Parents("feature", features, on_day),
        orphans.Parents("outcome", features.where("target_next_up is not null"), on_day),
    ]
    references = [
        orphans.References(
            "sentiment", read(spark, sf_dir, "sentiment"), F.lit("headline"), [clean_uid("headline_uid")],
            F.concat(text(F.col("headline_uid")), F.lit("|"), text(F.col("model"))), F.date_format("scored_at", "yyyy-MM"),
        ),
        orphans.References(
            "predictions", read(spark, sf_dir, "predictions"), F.when(F.col("realized_up").isNull(), "feature").otherwise("outcome"), on_day,
            F.concat(text(F.col("model")), F.lit("|"), text(F.col("ticker")), F.lit("|"), text(day("date"))), F.date_format("date", "yyyy-MM"),
        ),
    ]
    return orphans.find_orphans(parents, references)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "record_key").distinct()


def p1_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir)).withColumnRenamed("period", "month")


_P1 = """
WITH live AS (
  SELECT DISTINCT lower(trim(headline_uid)) AS uid FROM headlines
  WHERE lower(trim(headline_uid)) NOT IN (SELECT lower(trim(headline_uid)) FROM headline_removals WHERE restored_at IS NULL AND headline_uid IS NOT NULL)
), f AS (
  SELECT upper(trim(ticker)) AS ticker, date, max(target_next_up) AS t FROM features GROUP BY 1, 2
), o AS (
  SELECT 'sentiment' AS table_name, coalesce(s.headline_uid, '') || '|' || coalesce(s.model, '') AS record_key, strftime(s.scored_at, '%Y-%m') AS month
  FROM sentiment s LEFT JOIN live l ON lower(trim(s.headline_uid)) = l.uid WHERE l.uid IS NULL
  UNION
  SELECT 'predictions', coalesce(p.model, '') || '|' || coalesce(p.ticker, '') || '|' || coalesce(strftime(p.date, '%Y-%m-%d'), ''), strftime(p.date, '%Y-%m')
  FROM predictions p LEFT JOIN f ON upper(trim(p.ticker)) = f.ticker AND p.date = f.date
  WHERE f.ticker IS NULL OR (p.realized_up IS NOT NULL AND f.t IS NULL)
)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, features = read(spark, sf_dir, "prices"), read(spark, sf_dir, "features")
    return rolling_state.daily_amounts(
        [
            (prices, clean_ticker("ticker"), F.col("date"), {"adj_close": F.col("adj_close"), "volume": F.col("volume")}),
            (features, clean_ticker("ticker"), F.col("date"), {"sent_mean": F.col("sent_mean")}),
        ],
        SCALES, anchor="adj_close",
    )


def _maintained(spark: SparkSession, sf_dir: str, corrected_after: int, late_months: Sequence[int]) -> rolling_state.RollingState:
    """The state as a running service would have it: a first load without the last ``STEPS`` days and without the
    rows of the 15th of some months, daily steps, and after so many of them the missing rows as corrections."""
    prepare(spark)
    state = rolling_state.RollingState(spark, list(SCALES), PERIODS)
    daily = _daily(spark, sf_dir)
    dates = read(spark, sf_dir, "prices").select("date").unionByName(read(spark, sf_dir, "features").select("date"))
    end = dates.agg(F.max("date").cast("date")).first()[0]
    loaded = (end or dt.date(2000, 1, 1)) - dt.timedelta(STEPS)
    late = (F.dayofmonth("day") == 15) & F.month("day").isin(list(late_months)) & (F.col("day") <= F.lit(loaded))
    # Arrivals lie by day, so that a step reads its own.
    part = F.when(late, F.lit("late")).when(F.col("day") <= F.lit(loaded), "history").otherwise(day("day"))
    spread = F.when(F.col("inbox") == "history", F.xxhash64("entity")).otherwise(0)  # one file a day, many for the history
    inbox = write_table(daily.withColumn("inbox", part).repartition("inbox", spread), "inbox", ["inbox"])
    state.load(inbox.where("inbox = 'history'"), loaded)
    for n in range(1, STEPS + 1):
        state.advance(inbox.where(F.col("inbox") == str(loaded + dt.timedelta(n))))
        if n == corrected_after:
            state.correct(inbox.where("inbox = 'late'"))
    return state


def _rounded(state: rolling_state.RollingState) -> DataFrame:
    out = state.published()
    places = lambda c: next(n for m, n in PLACES.items() if c.startswith(m))
    return out.select(F.col("entity").alias("ticker"), day("day").alias("date"), *[F.col(c) if "_days_" in c else (F.round(F.col(c) + 1e-10, places(c)) + 0.0).alias(c) for c in out.columns if c not in ("entity", "day")])


def p3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, averages and days with a value over trailing 7 and 30 days, for each ticker and day from its first price to its last."""
    return _rounded(_maintained(spark, sf_dir, STEPS // 2, (2, 5, 8, 11)))


def p3_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with corrections of every month after the last step."""
    return _rounded(_maintained(spark, sf_dir, STEPS, range(1, 13)))


def _p3_sql() -> str:
    out = []
    for m, n in PLACES.items():
        for p in PERIODS:
            w = f"OVER (PARTITION BY d.ticker ORDER BY d.day RANGE BETWEEN INTERVAL {p - 1} DAYS PRECEDING AND CURRENT ROW)"
            out += [
                f"round(coalesce(sum(a.{m}) {w}, 0) + 1e-10, {n}) + 0.0 AS {m}_total_{p}",
                f"round(sum(a.{m}) {w} / count(a.{m}) {w} + 1e-10, {n}) + 0.0 AS {m}_avg_{p}",
                f"count(a.{m}) {w} AS {m}_days_{p}",
            ]
    return f"""
WITH u AS (
  SELECT upper(trim(ticker)) AS ticker, CAST(date AS DATE) AS day, adj_close, volume, NULL::DOUBLE AS sent_mean FROM prices
  UNION ALL SELECT upper(trim(ticker)), CAST(date AS DATE), NULL, NULL, sent_mean FROM features
), a AS (SELECT ticker, day, max(adj_close) AS adj_close, max(volume) AS volume, max(sent_mean) AS sent_mean FROM u GROUP BY 1, 2),
span AS (SELECT upper(trim(ticker)) AS ticker, min(CAST(date AS DATE)) AS lo, max(CAST(date AS DATE)) AS hi FROM prices GROUP BY 1),
firsts AS (SELECT ticker, min(day) AS lo, max(day) AS hi FROM a GROUP BY 1),
d AS (SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM firsts),
r AS (SELECT d.ticker, d.day, {", ".join(out)} FROM d LEFT JOIN a ON a.ticker = d.ticker AND a.day = d.day)
SELECT r.* EXCLUDE (day), strftime(r.day, '%Y-%m-%d') AS date FROM r JOIN span s ON s.ticker = r.ticker AND r.day BETWEEN s.lo AND s.hi"""


def p5_per_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines per ticker: rows, first and last published_at, distinct titles and publishers."""
    prepare(spark)
    out = salted.salted_summary(
        read(spark, sf_dir, "headlines"), clean_ticker("ticker"), F.col("published_at"),
        {"n_titles": F.col("title"), "n_publishers": F.col("publisher")},
    )
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.select(F.col("key").alias("ticker"), F.col("n").alias("n_headlines"), F.date_format("first", stamp).alias("first_published"), F.date_format("last", stamp).alias("last_published"), "n_titles", "n_publishers")


_P5 = """
WITH h AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, headline_uid, published_at, trade_date, title, publisher, url FROM headlines)
SELECT ticker, count(*) AS n_headlines, strftime(min(published_at), '%Y-%m-%d %H:%M:%S') AS first_published, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS last_published,
  count(DISTINCT title) AS n_titles, count(DISTINCT publisher) AS n_publishers
FROM h GROUP BY ticker"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spikes.judged(spikes.readings(read(spark, sf_dir, "prices"), clean_ticker("ticker"), F.col("date"), ["close", "adj_close"]))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(_judged(spark, sf_dir)).select(F.col("source").alias("ticker"), day("day").alias("date"))


def p7_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ticker and column: the fitted tail, its cutoff against the spike distance, and how many readings each rule flags.

    ``n_rule`` readings meet the spike rule whatever the tail says, ``n_spike`` of them in runs the tail's cutoff lets in.
    """
    j = _judged(spark, sf_dir)
    n = lambda c: F.sum(F.col(c).cast("long")).alias(f"n_{c}")
    known = j.groupBy(F.col("source").alias("ticker"), "column").agg(
        F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("usual", "threshold", "shape", "scale", "cutoff")], *[n(c) for c in ("peak", "rule", "spike", "stuck", "impossible")]
    )
    out = known.withColumn("cutoff_to_distance", F.try_divide(F.col("cutoff"), 10 * F.col("usual")))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _p7_steps(c: str) -> str:
    """CTEs up to ``g``: every positive reading of a column with its tail and whether the spike rule and the stuck rule hold."""
    y = lambda k: "y" if k == 0 else f"lag(y, {-k}) OVER w" if k < 0 else f"lead(y, {k}) OVER w"
    rule, spike = [], []
    for length in range(1, 4):
        for off in range(length):
            b, a = y(-off - 1), y(length - off)
            up = " AND ".join(f"{y(k)} - {b} > far AND {y(k)} - {a} > far" for k in range(-off, length - off))
            down = " AND ".join(f"{b} - {y(k)} > far AND {a} - {y(k)} > far" for k in range(-off, length - off))
            met = f"(abs({b} - {a}) <= far AND (({up}) OR ({down})))"
            rule.append(met)
            spike.append(f"({'peak' if not off else f'lag(peak, {off}) OVER w'} AND {met})")
    return f"""
v AS (SELECT ticker, date, {c} AS x, ln({c}) AS y FROM q WHERE {c} > 0),
ch AS (SELECT *, y - lag(y) OVER w AS c, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS nw FROM v WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f AS (SELECT *, median(abs(c)) OVER (PARTITION BY ticker) AS usual, abs(c - median(c) OVER (PARTITION BY ticker, dayofweek(date))) AS r, sum(nw) OVER (PARTITION BY ticker ORDER BY date) AS run FROM ch),
th AS (SELECT ticker, quantile_cont(r, 0.95) FILTER (r <= 10 * usual) AS threshold, count(*) FILTER (r <= 10 * usual) AS n FROM f GROUP BY 1),
e AS (SELECT ticker, r - threshold AS e FROM f JOIN th USING (ticker) WHERE r <= 10 * usual AND usual > 0 AND r > threshold),
o AS (SELECT ticker, e, row_number() OVER (PARTITION BY ticker ORDER BY e) AS i, count(*) OVER (PARTITION BY ticker) AS m FROM e),
mo AS (SELECT ticker, max(m) AS m, avg(e) AS a0, avg(e * (1 - (i - 0.35) / m)) AS a1 FROM o GROUP BY 1),
sh AS (SELECT ticker, m, CASE WHEN m >= 10 AND a0 <> 2 * a1 THEN 2 - a0 / (a0 - 2 * a1) ELSE 0.0 END AS shape, CASE WHEN m >= 10 AND a0 <> 2 * a1 THEN 2 * a1 * a0 / (a0 - 2 * a1) ELSE a0 END AS scale FROM mo),
t AS (SELECT ticker, threshold, shape, scale, threshold + scale * CASE WHEN abs(shape) < 1e-6 THEN ln(m / (n * 0.01)) ELSE (pow(m / (n * 0.01), shape) - 1) / shape END AS cutoff FROM th LEFT JOIN sh USING (ticker)),
pk AS (SELECT f.*, threshold, shape, scale, cutoff, 10 * usual AS far, coalesce(r > coalesce(cutoff, -1), false) AS peak,
  count(*) OVER (PARTITION BY ticker, run) AS len, row_number() OVER (PARTITION BY ticker, run ORDER BY date) AS place FROM f JOIN t USING (ticker)),
g AS (SELECT *, coalesce({" OR ".join(rule)}, false) AS rule, coalesce({" OR ".join(spike)}, false) AS spike, len >= 6 AND place > 1 AS stuck FROM pk WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


_P7 = """
WITH q AS (SELECT upper(trim(ticker)) AS ticker, date, max(close) AS close, max(adj_close) AS adj_close FROM prices GROUP BY 1, 2)"""


def _p7_sql() -> str:
    """The statement alone: the tail plays no part in it."""
    parts = [
        f"""
  SELECT ticker, date FROM q WHERE {c} <= 0
  UNION SELECT ticker, date FROM (WITH {_p7_steps(c)} SELECT ticker, date FROM g WHERE rule OR stuck)"""
        for c in ("close", "adj_close")
    ]
    return f"{_P7} SELECT ticker, strftime(date, '%Y-%m-%d') AS date FROM ({' UNION '.join(parts)})"


def _p7_tails_sql() -> str:
    real = ", ".join(f"{R(f'max({e})')} AS {c}" for c, e in {"usual": "usual", "threshold": "threshold", "shape": "shape", "scale": "scale", "cutoff": "cutoff", "cutoff_to_distance": "CASE WHEN usual > 0 THEN cutoff / (10 * usual) END"}.items())
    number = ", ".join(f"CAST(coalesce(sum({c}::INT), 0) AS BIGINT) AS n_{c}" for c in ("peak", "rule", "spike", "stuck"))
    parts = [
        f"""
  SELECT * FROM (
    WITH {_p7_steps(c)}, bad AS (SELECT ticker, count(*) AS n_impossible FROM q WHERE {c} <= 0 GROUP BY 1)
    SELECT coalesce(s.ticker, bad.ticker) AS ticker, '{c}' AS "column", coalesce(n, 0) + coalesce(n_impossible, 0) AS n, usual, threshold, shape, scale, cutoff, cutoff_to_distance,
      coalesce(n_peak, 0) AS n_peak, coalesce(n_rule, 0) AS n_rule, coalesce(n_spike, 0) AS n_spike, coalesce(n_stuck, 0) AS n_stuck, coalesce(n_impossible, 0) AS n_impossible
    FROM (SELECT ticker, count(*) AS n, {real}, {number} FROM g GROUP BY 1) s FULL JOIN bad ON s.ticker = bad.ticker)"""
        for c in ("close", "adj_close")
    ]
    return _P7 + " UNION ALL ".join(parts)


QUERIES = {
    "p1_found": p1_found, "p1_by_month": p1_by_month, "p3_rolling": p3_rolling, "p3_maintained": p3_maintained,
    "p5_per_ticker": p5_per_ticker, "p7_found": p7_found, "p7_tails": p7_tails,
}
ORACLE = {
    "p1_found": _P1 + " SELECT DISTINCT table_name, record_key FROM o",
    "p1_by_month": _P1 + " SELECT table_name, month, count(*) AS n_orphans FROM o GROUP BY 1, 2",
    "p3_rolling": _p3_sql(), "p3_maintained": _p3_sql(), "p5_per_ticker": _P5, "p7_found": _p7_sql(), "p7_tails": _p7_tails_sql(),
}
