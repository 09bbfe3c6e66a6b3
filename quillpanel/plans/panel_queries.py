"""Windows, composite operators, models, monitor, service and figures: one query each, with an independent SQL version."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.functions.keys import day
from quillpanel.operators import cross_section as XS
from quillpanel.operators import experiments as EX
from quillpanel.operators import features as FT
from quillpanel.operators import headlines as HL
from quillpanel.operators import models as M
from quillpanel.operators import monitor as MO
from quillpanel.operators import scoring
from quillpanel.plans import figures, pipeline, service
from quillpanel.plans import reference_queries as RQ
from quillpanel.plans.base import MODEL, Base, R, r6
from quillpanel.plans.reference_queries import _ACC, _ATTRIBUTED, _DAILY, CUT, NAMES, D, T, stamp
from quillpanel.runtime import release
from quillpanel.sources import readers
from quillpanel.sources.schema import FEATURES, SENTIMENT_FEATURES

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None, base: bool = True):
    done = RQ.query(name, sql, base)

    def register(f):
        done(f)
        QUERIES[name] = RQ.QUERIES.pop(name)
        if sql is not None:
            ORACLE[name] = RQ.ORACLE.pop(name)
        return f

    return register


# ---- the feature panel ---------------------------------------------------------

_W = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)".format


def _roll(f: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_W(n - 1)} >= {least} THEN {f}({x}) OVER {_W(n - 1)} END"


def _z(x: str) -> str:
    return f"({x} - {_roll('avg', x, 20, 5)}) / ({_roll('stddev_samp', x, 20, 5)} + 1e-9)"


_PANEL = f"""
pn0 AS (SELECT p.ticker, p.date, p.adj_close, p.volume, coalesce(d.n_headlines, 0.0) AS n_headlines, d.sent_mean, d.sent_std, d.sent_pos_frac, d.sent_neg_frac, d.sent_pos_frac - d.sent_neg_frac AS sent_net
  FROM px p LEFT JOIN daily d ON d.ticker = p.ticker AND d.date = p.date),
pn1 AS (SELECT *, adj_close / nullif(lag(adj_close) OVER w, 0) - 1 AS ret_1d, adj_close / nullif(lag(adj_close, 5) OVER w, 0) - 1 AS ret_5d, {_roll('avg', 'adj_close', 10, 5)} AS sma10, {_roll('avg', 'adj_close', 30, 10)} AS sma30,
  sent_mean - {_roll('avg', 'sent_mean', 10, 3)} AS sent_surprise, {_z('n_headlines')} AS news_vol_z, {_z('volume')} AS volume_z, lead(adj_close) OVER w / nullif(adj_close, 0) - 1 AS fwd_ret_1d
  FROM pn0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
nr AS (SELECT ticker, date, sent_mean, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM pn0 WHERE sent_mean IS NOT NULL),
ew AS (SELECT a.ticker, a.date, sum(b.sent_mean * pow(0.5, a.k - b.k)) / sum(pow(0.5, a.k - b.k)) AS sent_ewma3 FROM nr a JOIN nr b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 59 AND a.k GROUP BY 1, 2),
pn AS (SELECT pn1.*, {_roll('stddev_samp', 'ret_1d', 5, 3)} AS vol_5d, adj_close / nullif(sma10, 0) - 1 AS ma_gap, (sma10 - sma30) / nullif(sma30, 0) AS ma_cross, CASE WHEN fwd_ret_1d > 0 THEN 1 WHEN fwd_ret_1d IS NOT NULL THEN 0 END AS target_next_up, ew.sent_ewma3
  FROM pn1 LEFT JOIN ew USING (ticker, date))"""


def _panel_sql(source: str = "hl") -> str:
    return f"{_DAILY(source).strip()}, {_PANEL.strip()}"


def _panel(b: Base) -> DataFrame:
    return FT.with_windows(FT.panel(b.px, FT.daily_sentiment(b.hl, b.sen, MODEL)))


#: Columns compared to five places: differences of large sums keep fewer.
_LOOSE = ("sent_std", "vol_5d", "news_vol_z", "volume_z")


def _sql_cols(cols: list[str]) -> str:
    return ", ".join(f"(round({c} + 1e-9, 4) + 0.0) AS {c}" if c in _LOOSE else f"{R(c)} AS {c}" for c in cols)


def _cols(cols: list[str]):
    return [(F.round(F.col(c) + 1e-9, 4) + 0.0).alias(c) if c in _LOOSE else r6(c).alias(c) for c in cols]


def _window_query(name: str, columns: list[str]) -> None:
    @query(name, f"WITH {_panel_sql()} SELECT ticker, {D('date')} AS date, {_sql_cols(columns)} FROM pn")
    def _(b: Base) -> DataFrame:
        return _panel(b).select("ticker", day("date").alias("date"), *_cols(columns))


for _name, _columns in {
    "j2_panel_with_sentiment": ["adj_close", "n_headlines", "sent_mean"], "w1_sent_ewma3": ["sent_ewma3"], "w2_sent_surprise": ["sent_surprise"], "w3_news_vol_z": ["news_vol_z"],
    "w4_returns": ["ret_1d", "ret_5d"], "w5_vol_5d": ["vol_5d"], "w6_ma_gap": ["ma_gap"], "w7_ma_cross": ["ma_cross"], "w8_volume_z": ["volume_z"], "w9_forward_return": ["fwd_ret_1d", "target_next_up"],
}.items():
    _window_query(_name, _columns)

_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*FEATURES, "target_next_up"))


@query("d6_features", f"WITH {_ATTRIBUTED.strip()}, {_panel_sql('att')} SELECT ticker, {D('date')} AS date, {_sql_cols([*FEATURES, 'fwd_ret_1d'])}, target_next_up FROM pn WHERE n_headlines >= 1 AND {_COMPLETE}")
def d6_features(b: Base) -> DataFrame:
    """Attribution with one session of lag, daily sentiment, windows, complete rows."""
    rows = EX.features_at(b.hl, b.sen, b.px, 1, MODEL)
    return rows.select("ticker", day("date").alias("date"), *_cols([*FEATURES, "fwd_ret_1d"]), "target_next_up")


@query("c20_universe_after_windows", f"WITH {_ATTRIBUTED.strip()}, {_panel_sql('att')} SELECT ticker, count(*) AS n FROM pn WHERE ticker IN ('XELV', 'VZXNP') AND date >= DATE '2023-07-01' AND n_headlines >= 2 AND {_COMPLETE} GROUP BY 1")
def _(b: Base) -> DataFrame:
    settings = dataclasses.replace(SETTINGS, tickers=("XELV", "VZXNP"), start_date="2023-07-01", min_headlines_per_day=2)
    return EX.features_at(b.hl, b.sen, b.px, 1, MODEL, settings).groupBy("ticker").agg(F.count("*").alias("n"))


_CLEAN = rf"""
c0 AS (SELECT upper(trim(ticker)) AS ticker, published_at, trim(regexp_replace(title, '{RQ.WS}', ' ', 'g')) AS title, substring(coalesce(publisher, ''), 1, 128) AS publisher, coalesce(url, '') AS url FROM headlines),
cl AS (SELECT ticker, published_at, title, min((publisher, url)) AS pu FROM c0 WHERE length(title) >= 15 AND published_at IS NOT NULL GROUP BY 1, 2, 3)"""


@query("d1_clean", f"WITH {_CLEAN.strip()} SELECT ticker, {T('published_at')} AS published_at, title, pu[1] AS publisher, pu[2] AS url FROM cl")
def _(b: Base) -> DataFrame:
    raw = readers.load_raw(b.spark, [f"{b.dir}/headlines.parquet"], (), RQ._RAW)
    return HL.clean(raw).select("ticker", stamp("published_at").alias("published_at"), "title", "publisher", "url")


_UID = "sha1(ticker || '|' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(published_at) % 1000000 <> 0 THEN strftime(published_at, '.%f') ELSE '' END || '|' || title)"


@query("d2_ingest", f"WITH {_CLEAN.strip()}, clc AS (SELECT *, {RQ._CAND} AS cday FROM cl), sn AS (SELECT clc.*, coalesce(c.idx, (SELECT count(*) FROM cal)) AS at FROM clc ASOF LEFT JOIN cal c ON clc.cday <= c.session) SELECT {_UID} AS headline_uid, {D('c.session')} AS trade_date FROM sn JOIN cal c ON c.idx = sn.at + 1")
def _(b: Base) -> DataFrame:
    raw = readers.load_raw(b.spark, [f"{b.dir}/headlines.parquet"], (), RQ._RAW)
    return HL.ingest(raw, b.px).select("headline_uid", day("trade_date").alias("trade_date"))


@query("d4_wide_to_long", f"SELECT ticker, {D('date')} AS date, {R('close')} AS close, {R('volume')} AS volume FROM px WHERE ticker IS NOT NULL AND (close IS NOT NULL OR volume IS NOT NULL)")
def _(b: Base) -> DataFrame:
    names = [r[0] for r in b.px.where("ticker is not null").select("ticker").distinct().orderBy("ticker").collect()]  # the universe
    wide = b.px.groupBy("date").pivot("ticker", names).agg(F.max("close").alias("close"), F.max("volume").alias("volume"))
    wide = wide.select("date", *[F.col(f"`{t}_{f}`").alias(f"{f}_{t}") for t in names for f in ("close", "volume")])
    return readers.wide_to_long(wide, ["close", "volume"]).select("ticker", day("date").alias("date"), r6("close").alias("close"), r6("volume").alias("volume"))


_UP, _DOWN = (" + ".join(f"len(list_filter(w, x -> x = '{x}'))" for x in sorted(s)) for s in (scoring.LexiconScorer.UP, scoring.LexiconScorer.DOWN))


@query("d5_score_headlines", rf"""
WITH u AS (SELECT h.headline_uid, regexp_extract_all(lower(h.title), '\p{{L}}+') AS w FROM hl h LEFT JOIN sen s ON s.headline_uid = h.headline_uid AND s.model = '{MODEL}' WHERE s.headline_uid IS NULL),
k AS (SELECT headline_uid, {_UP} AS up, {_DOWN} AS down FROM u)
SELECT headline_uid, {R('(exp(up) - exp(down)) / (exp(up) + exp(1) + exp(down))')} AS score, CASE WHEN (exp(up) - exp(down)) / (exp(up) + exp(1) + exp(down)) > 0.15 THEN 'pos' WHEN (exp(up) - exp(down)) / (exp(up) + exp(1) + exp(down)) < -0.15 THEN 'neg' ELSE 'neu' END AS label FROM k""".replace("x -> x", "lambda x: x"))
def _(b: Base) -> DataFrame:
    return scoring.score(HL.unscored(b.hl, b.sen, MODEL), "lexicon").select("headline_uid", r6("score").alias("score"), "label")


# ---- cross-section -------------------------------------------------------------

_XS = f"""
xp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS names FROM ft WHERE fwd_ret_1d IS NOT NULL) WHERE names >= {NAMES}),
xr AS (SELECT *, fwd_ret_1d - median(fwd_ret_1d) OVER (PARTITION BY date) AS fwd_ret_rel, row_number() OVER (PARTITION BY date ORDER BY fwd_ret_1d, ticker) AS rn FROM xp),
xt AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY fwd_ret_1d, ticker) > count(*) OVER (PARTITION BY date) / 2.0 THEN 1 ELSE 0 END AS target_rel FROM xr WHERE names % 2 = 0 OR rn <> (names + 1) / 2)"""


def _xs(b: Base) -> DataFrame:
    return XS.with_relative_target(XS.panel(b.ft.where("fwd_ret_1d is not null"), NAMES))


@query("w12_full_days", f"WITH {_XS.strip()} SELECT {D('date')} AS date, count(*) AS n FROM xp GROUP BY xp.date")
def _(b: Base) -> DataFrame:
    return XS.panel(b.ft.where("fwd_ret_1d is not null"), NAMES).groupBy("date").agg(F.count("*").alias("n")).select(day("date").alias("date"), "n")


def _zs(c: str) -> str:
    return f"coalesce(({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_samp({c}) OVER (PARTITION BY date), 0), 0.0)"


@query("w13_day_z_scores", f"WITH {_XS.strip()} SELECT ticker, {D('date')} AS date, {', '.join(f'(round({_zs(c)} + 1e-9, 5) + 0.0) AS {c}' for c in ('sent_mean', 'ret_1d', 'volume_z'))} FROM xp")
def _(b: Base) -> DataFrame:
    cols = ["sent_mean", "ret_1d", "volume_z"]
    return XS.zscored(XS.panel(b.ft.where("fwd_ret_1d is not null"), NAMES), cols).select("ticker", day("date").alias("date"), *[(F.round(F.col(c) + 1e-9, 5) + 0.0).alias(c) for c in cols])


_COMP = f"zc AS (SELECT *, ({' + '.join(_zs(c) for c in SETTINGS.composite)}) / {float(len(SETTINGS.composite))} AS m, {', '.join(f'{_zs(c)} AS z_{c}' for c in ('news_vol_z', 'ret_1d', 'volume_z'))} FROM xt), zd AS (SELECT *, {_zs('m')} AS comp FROM zc)"


@query("w14_composite", f"WITH {_XS.strip()}, {_COMP} SELECT ticker, {D('date')} AS date, (round(comp + 1e-9, 5) + 0.0) AS sent_composite FROM zd")
def _(b: Base) -> DataFrame:
    return XS.with_composite(XS.zscored(_xs(b), FEATURES)).select("ticker", day("date").alias("date"), (F.round(F.col("sent_composite") + 1e-9, 5) + 0.0).alias("sent_composite"))


@query("w15_relative_return", f"WITH {_XS.strip()} SELECT ticker, {D('date')} AS date, {R('fwd_ret_rel')} AS fwd_ret_rel FROM xt")
def _(b: Base) -> DataFrame:
    return _xs(b).select("ticker", day("date").alias("date"), r6("fwd_ret_rel").alias("fwd_ret_rel"))


@query("w16_half_label", f"WITH {_XS.strip()} SELECT ticker, {D('date')} AS date, target_rel FROM xt")
def _(b: Base) -> DataFrame:
    return _xs(b).select("ticker", day("date").alias("date"), "target_rel")


@query("d7_prior_score", f"WITH {_XS.strip()}, {_COMP} SELECT ticker, {D('date')} AS date, (round(comp - z_news_vol_z - z_ret_1d - z_volume_z + 1e-9, 5) + 0.0) AS prior FROM zd")
def _(b: Base) -> DataFrame:
    out = XS.prior_score(XS.with_composite(XS.zscored(_xs(b), FEATURES)))
    return out.select("ticker", day("date").alias("date"), (F.round(F.col("prior") + 1e-9, 5) + 0.0).alias("prior"))


_LS = f"""
{_XS.strip()},
lr AS (SELECT date, ticker, fwd_ret_1d AS ret, row_number() OVER (PARTITION BY date ORDER BY sent_mean, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM xp WHERE sent_mean IS NOT NULL),
lk AS (SELECT *, greatest(2, n // 4) AS k FROM lr),
lw AS (SELECT date, ticker, ret, CASE WHEN rn <= k THEN -1.0 / k ELSE 1.0 / k END AS w FROM lk WHERE n >= 2 * k AND (rn <= k OR rn > n - k)),
ld AS (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM lw)),
li AS (SELECT d, lw.* FROM lw JOIN ld USING (date)),
lt AS (SELECT d, sum(abs(dw)) / 2 AS turnover FROM (SELECT coalesce(a.d, b.d + 1) AS d, coalesce(a.w, 0) - coalesce(b.w, 0) AS dw FROM li a FULL JOIN li b ON a.ticker = b.ticker AND a.d = b.d + 1) GROUP BY 1),
lg AS (SELECT date, avg(ret) FILTER (w > 0) - avg(ret) FILTER (w < 0) AS gross FROM lw GROUP BY 1),
bt AS (SELECT lg.date, gross, CASE WHEN ld.d = 1 THEN 1.0 ELSE lt.turnover END AS turnover FROM lg JOIN ld USING (date) JOIN lt ON lt.d = ld.d),
bs AS (SELECT *, turnover * 2.0 / 1e4 * 2 AS cost, gross - turnover * 2.0 / 1e4 * 2 AS net FROM bt)"""


def _ls(b: Base) -> DataFrame:
    return XS.long_short(XS.panel(b.ft.where("fwd_ret_1d is not null"), NAMES), "sent_mean")


@query("w19_legs", f"WITH {_LS.strip()} SELECT {D('date')} AS date, ticker, {R('w')} AS w FROM lw")
def _(b: Base) -> DataFrame:
    return XS.legs(XS.panel(b.ft.where("fwd_ret_1d is not null"), NAMES), "sent_mean").select(day("date").alias("date"), "ticker", r6("w").alias("w"))


@query("j9_turnover", f"WITH {_LS.strip()} SELECT {D('date')} AS date, {R('turnover')} AS turnover FROM bs")
def _(b: Base) -> DataFrame:
    return _ls(b).select(day("date").alias("date"), r6("turnover").alias("turnover"))


@query("d8_long_short", f"WITH {_LS.strip()} SELECT {D('date')} AS date, {', '.join(f'{R(c)} AS {c}' for c in ('gross', 'turnover', 'cost', 'net'))} FROM bs")
def _(b: Base) -> DataFrame:
    return _ls(b).select(day("date").alias("date"), *[r6(c).alias(c) for c in ("gross", "turnover", "cost", "net")])


@query("g15_backtest_stats", f"WITH {_LS.strip()} SELECT count(*) AS n_days, {R('1e4 * avg(gross)')} AS gross_bps_per_day, {R('1e4 * avg(net)')} AS net_bps_per_day, {R('avg(gross) / stddev_samp(gross) * sqrt(252.0)')} AS gross_sharpe, {R('avg(net) / stddev_samp(net) * sqrt(252.0)')} AS net_sharpe, {R('avg(turnover)')} AS avg_turnover, {R('1e4 * avg(gross - net)')} AS cost_bps_day, 2.0::DOUBLE AS cost_bps_per_side, {R('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate FROM bs")
def _(b: Base) -> DataFrame:
    out = XS.backtest_stats(_ls(b))
    return out.select("n_days", *[r6(c).alias(c) if c != "cost_bps_per_side" else F.col(c) for c in out.columns if c != "n_days"])


@query("w21_cumulative", f"WITH {_LS.strip()} SELECT {D('date')} AS date, {R('product(1 + gross) OVER (ORDER BY date) - 1')} AS cum_gross, {R('product(1 + net) OVER (ORDER BY date) - 1')} AS cum_net FROM bs")
def _(b: Base) -> DataFrame:
    return XS.cumulative(_ls(b)).select(day("date").alias("date"), r6("cum_gross").alias("cum_gross"), r6("cum_net").alias("cum_net"))


@query("w17_average_rank", f"SELECT ticker, {D('date')} AS date, CAST(rank() OVER (PARTITION BY date ORDER BY sent_mean) + (count(*) OVER (PARTITION BY date, sent_mean) - 1) / 2.0 AS DOUBLE) AS r FROM ft WHERE sent_mean IS NOT NULL")
def _(b: Base) -> DataFrame:
    from quillpanel.functions.stats import average_rank

    return b.ft.where("sent_mean is not null").select("ticker", day("date").alias("date"), average_rank(F.col("sent_mean"), ["date"]).alias("r"))


@query("w18_first_rank", f"SELECT ticker, {D('date')} AS date, row_number() OVER (PARTITION BY date ORDER BY fwd_ret_1d, ticker) AS r FROM ft WHERE fwd_ret_1d IS NOT NULL")
def _(b: Base) -> DataFrame:
    return b.ft.where("fwd_ret_1d is not null").select("ticker", day("date").alias("date"), F.row_number().over(Window.partitionBy("date").orderBy("fwd_ret_1d", "ticker")).cast("long").alias("r"))


@query("d16_accuracy_variants", f"WITH {_XS.strip()} SELECT {R('avg(CASE WHEN CAST(sent_mean >= 0 AS INT) = target_rel THEN 1.0 ELSE 0.0 END)')} AS by_sign, {R('avg(CASE WHEN CAST(sent_mean >= (SELECT median(sent_mean) FROM xt) AS INT) = target_rel THEN 1.0 ELSE 0.0 END)')} AS by_median FROM xt WHERE sent_mean IS NOT NULL")
def _(b: Base) -> DataFrame:
    rows = _xs(b)
    return XS.accuracy(rows, "sent_mean", cut=0.0).select(r6("accuracy").alias("by_sign")).crossJoin(F.broadcast(XS.accuracy(rows, "sent_mean", cut=None).select(r6("accuracy").alias("by_median"))))


# ---- monitor -------------------------------------------------------------------

_ROLL = f"{_ACC}, rr AS (SELECT *, CASE WHEN count(*) OVER w >= 5 THEN avg(accuracy) OVER w END AS rolling_accuracy, CASE WHEN count(*) OVER w >= 5 THEN avg(up_rate) OVER w END AS rolling_baseline FROM acc WINDOW w AS (PARTITION BY model ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


@query("w10_rolling_accuracy", f"WITH {_ROLL} SELECT model, {D('date')} AS date, {R('rolling_accuracy')} AS rolling_accuracy, {R('rolling_baseline')} AS rolling_baseline, {R('rolling_accuracy - rolling_baseline')} AS edge FROM rr")
def _(b: Base) -> DataFrame:
    return MO.rolling_report(b.pr, 20).select("model", day("date").alias("date"), *[r6(c).alias(c) for c in ("rolling_accuracy", "rolling_baseline", "edge")])


@query("d9_rolling_report", f"WITH {_ROLL} SELECT model, {D('date')} AS date, n, {R('accuracy')} AS accuracy, {R('up_rate')} AS up_rate, {R('mean_prob')} AS mean_prob, {R('rolling_accuracy')} AS rolling_accuracy FROM rr")
def _(b: Base) -> DataFrame:
    return MO.rolling_report(b.pr, 20).select("model", day("date").alias("date"), "n", *[r6(c).alias(c) for c in ("accuracy", "up_rate", "mean_prob", "rolling_accuracy")])


_DRIFT = """
ld AS (SELECT DISTINCT model, date FROM (SELECT model, date, dense_rank() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM pr WHERE realized_up IS NOT NULL) WHERE k <= 20),
e AS (SELECT sent_mean AS x FROM ft WHERE date < DATE '2023-09-01' AND sent_mean IS NOT NULL), a AS (SELECT model, sent_mean AS x FROM ft JOIN ld USING (date) WHERE sent_mean IS NOT NULL),
edges AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS v FROM e),
bins AS (SELECT unnest(range(0, len(v) - 1)) AS bin FROM edges),
he AS (SELECT len(list_filter(v[2:len(v) - 1], lambda t: t <= x)) AS bin, count(*) AS c FROM e, edges GROUP BY 1),
ha AS (SELECT model, len(list_filter(v[2:len(v) - 1], lambda t: t <= x)) AS bin, count(*) AS c FROM a, edges GROUP BY 1, 2), na AS (SELECT model, count(*) AS n FROM a GROUP BY 1),
sh AS (SELECT na.model, na.n, greatest(coalesce(he.c, 0) / (SELECT count(*) * 1.0 FROM e), 1e-6) AS pe, greatest(coalesce(ha.c, 0) / (na.n * 1.0), 1e-6) AS pa
  FROM na CROSS JOIN bins b LEFT JOIN he ON he.bin = b.bin LEFT JOIN ha ON ha.bin = b.bin AND ha.model = na.model),
dr AS (SELECT model, CASE WHEN max(n) >= 10 THEN sum((pa - pe) * ln(pa / pe)) END AS psi FROM sh GROUP BY 1)"""


@query("d10_drift_psi", f"WITH {_DRIFT.strip()} SELECT model, {R('psi')} AS psi FROM dr")
def _(b: Base) -> DataFrame:
    """For every model."""
    return MO.drift_psi(b.ft, b.pr, test_start=CUT, window=20).select("model", r6("psi").alias("psi"))


def _checks(b: Base) -> DataFrame:
    out = MO.check_drift(b.pr, b.ft, window=20, test_start=CUT)
    return out.select("model", F.col("n_obs").cast("long").alias("n_obs"), r6("rolling_accuracy").alias("rolling_accuracy"), r6("baseline_accuracy").alias("baseline_accuracy"), r6("psi_sent_mean").alias("psi"), "status", "note")


_CHECKS = f"""{_ROLL}, {_DRIFT.strip()},
ck AS (SELECT m.model, l.date, l.n_obs, l.acc, l.base, dr.psi FROM (SELECT DISTINCT model FROM pr) m LEFT JOIN (
    SELECT model, max(date) AS date, sum(n) AS n_obs, max_by(rolling_accuracy, date) AS acc, max_by(rolling_baseline, date) AS base FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM rr) WHERE k <= 20 GROUP BY 1
  ) l ON l.model = m.model LEFT JOIN dr ON dr.model = m.model),
nt AS (SELECT *, concat_ws(', ', CASE WHEN acc < 0.5 THEN printf('accuracy %.3f is under the floor of 0.50', acc) END, CASE WHEN acc < base THEN printf('accuracy %.3f is under the baseline of %.3f', acc, base) END, CASE WHEN psi > 0.2 THEN printf('PSI %.3f is over 0.20', psi) END) AS t FROM ck)"""


@query("d11_monitor_run", f"""WITH {_CHECKS} SELECT model, CAST(coalesce(n_obs, 0) AS BIGINT) AS n_obs, {R('acc')} AS rolling_accuracy, {R('base')} AS baseline_accuracy, {R('psi')} AS psi,
  CASE WHEN date IS NULL THEN 'NO_DATA' WHEN coalesce(acc < 0.5, false) OR coalesce(psi > 0.2, false) THEN 'DRIFT' WHEN coalesce(acc < base, false) THEN 'WARN' ELSE 'OK' END AS status,
  CASE WHEN date IS NULL THEN 'nothing has an outcome yet' WHEN t = '' THEN 'all rules hold' ELSE t END AS note FROM nt""")
def _(b: Base) -> DataFrame:
    return _checks(b)


# ---- models --------------------------------------------------------------------


def _complete(b: Base) -> DataFrame:
    return b.ft.dropna(subset=[*FEATURES, "target_next_up", "fwd_ret_1d"])


_COMPLETE_FT = f"cf AS (SELECT * FROM ft WHERE {_COMPLETE} AND fwd_ret_1d IS NOT NULL)"


@query("m1_chronological_split", f"WITH {_COMPLETE_FT} SELECT CASE WHEN date < DATE '{CUT}' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM cf GROUP BY 1")
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    return train.agg(F.lit("train").alias("part"), F.count("*").alias("n")).unionByName(test.agg(F.lit("test").alias("part"), F.count("*").alias("n"))).select("part", "n")


@query("m2_scaler", f"WITH {_COMPLETE_FT}, s AS (SELECT avg(sent_mean) AS m, stddev_pop(sent_mean) AS d FROM cf WHERE date < DATE '{CUT}') SELECT ticker, {D('date')} AS date, {R('(sent_mean - m) / d')} AS sent_mean FROM cf, s WHERE date >= DATE '{CUT}'")
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    return M.Scaler.fit(train, ["sent_mean"]).apply(test).select("ticker", day("date").alias("date"), r6("sent_mean").alias("sent_mean"))


@query("m3_logistic", None)
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    return test.select("ticker", day("date").alias("date"), M.logistic(train, FEATURES).probability().alias("prob_up"))


@query("m4_boosted_trees", None)
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    model, _ = M.boosted(train, SENTIMENT_FEATURES)
    return M.boosted_probability(model, test).select("ticker", day("date").alias("date"), "prob_up")


@query("m5_folds", f"WITH {_COMPLETE_FT}, o AS (SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS k, count(*) OVER () AS n FROM cf), g AS (SELECT unnest(range(0, 4)) AS fold) SELECT fold, count(*) FILTER (k < n - (4 - fold) * (n // 5)) AS n_train, count(*) FILTER (k >= n - (4 - fold) * (n // 5) AND k < n - (3 - fold) * (n // 5)) AS n_test, {R('avg(sent_mean) FILTER (k >= n - (4 - fold) * (n // 5) AND k < n - (3 - fold) * (n // 5))')} AS test_mean FROM o, g GROUP BY 1")
def _(b: Base) -> DataFrame:
    out = None
    for k, (train, test) in enumerate(M.folds(_complete(b))):
        one = train.agg(F.lit(k).cast("long").alias("fold"), F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test"), r6(F.avg("sent_mean")).alias("test_mean")))
        out = one if out is None else out.unionByName(one)
    return out


@query("m5_tuned_strength", None)
def _(b: Base) -> DataFrame:
    """The mean AUC of each strength over the folds of the training rows, per block of features."""
    train, _ = M.split(_complete(b), CUT)
    train = train.persist()
    names = F.array(*map(F.lit, M.BLOCKS))
    return M.tunings(train, list(M.BLOCKS.values())).select(names[F.col("block")].alias("block"), "c", "auc")


_BASELINES = f"""
{_COMPLETE_FT}, te AS (SELECT * FROM cf WHERE date >= DATE '{CUT}'),
bl AS (
  SELECT 'baseline_always_up' AS model, ticker, date, (SELECT avg(target_next_up) FROM cf WHERE date < DATE '{CUT}') AS prob_up, 1 AS pred_up, target_next_up, fwd_ret_1d FROM te
  UNION ALL SELECT 'baseline_ma_cross', ticker, date, 1 / (1 + exp(-10 * ma_cross)), CAST(ma_cross > 0 AS INT), target_next_up, fwd_ret_1d FROM te
  UNION ALL SELECT 'baseline_sentiment_sign', ticker, date, 1 / (1 + exp(-2 * sent_mean)), CAST(sent_mean > 0 AS INT), target_next_up, fwd_ret_1d FROM te)"""


@query("m6_m8_baselines", f"WITH {_BASELINES.strip()} SELECT model, ticker, {D('date')} AS date, {R('prob_up')} AS prob_up, pred_up FROM bl")
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    return M.baselines(train, test).select("model", "ticker", day("date").alias("date"), r6("prob_up").alias("prob_up"), "pred_up")


_BALANCED = "(avg(pred_up) FILTER (target_next_up = 1) + avg(1 - pred_up) FILTER (target_next_up = 0)) / 2"


@query("s4_best_model", f"WITH {_BASELINES.strip()} SELECT model, {R(_BALANCED)} AS balanced_accuracy FROM bl GROUP BY 1 ORDER BY {R(_BALANCED)} DESC, model LIMIT 1")
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    metrics = M.evaluate(M.baselines(train, test), by="model")
    return M.champion(metrics.withColumn("balanced_accuracy", r6("balanced_accuracy"))).select("model", "balanced_accuracy")


@query("m9_shrunk_ranker", f"WITH {_COMPLETE_FT}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in ('sent_mean', 'ret_1d', 'volume_z'))} FROM cf WHERE date < DATE '{CUT}') SELECT ticker, {D('date')} AS date, {R('0.5 * 0.6 * (sent_mean - m_sent_mean) / d_sent_mean + (0.5 * 0.8 - 0.5 / sqrt(2.0)) * (ret_1d - m_ret_1d) / d_ret_1d - 0.5 / sqrt(2.0) * (volume_z - m_volume_z) / d_volume_z')} AS score FROM cf, s WHERE date >= DATE '{CUT}'")
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    fit = {"sent_mean": 3.0, "ret_1d": 4.0, "volume_z": 0.0}
    weights = M.blended(fit, SETTINGS.sign_prior, 0.5)
    return M.shrunk_score(test, M.Scaler.fit(train, list(fit)), weights).select("ticker", day("date").alias("date"), r6("score").alias("score"))


@query("m10_walk_forward_blend", None)
def _(b: Base) -> DataFrame:
    """The blend chosen over the years there are; with fewer than two years of enough history the first of the grid."""
    rows = XS.zscored(_xs(b), FEATURES)
    best = M.walk_forward_blend(rows, FEATURES, least_names=NAMES)
    return b.spark.createDataFrame([(best,)], "blend double")


@query("m11_ablation", None)
def _(b: Base) -> DataFrame:
    return M.ablation(_complete(b), CUT)


@query("m13_predict_one", None)
def _(b: Base) -> DataFrame:
    train, _ = M.split(_complete(b), CUT)
    answer = M.predict_one(M.logistic(train, FEATURES), {"sent_mean": 0.3, "ret_1d": 0.01})
    return b.spark.createDataFrame([(answer["prob_up"], answer["pred_up"], len(answer["missing_features"]))], "prob_up double, pred_up int, n_missing int")


@query("m14_stored_predictions", f"WITH {_BASELINES.strip()} SELECT model, ticker, {D('date')} AS date, {R('prob_up')} AS prob_up, CAST(prob_up >= 0.5 AS INT) AS pred_up FROM bl")
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    scored, out = M.baselines(train, test), None
    for name in ("baseline_always_up", "baseline_ma_cross", "baseline_sentiment_sign"):
        rows = M.predictions(scored.where(F.col("model") == name), name)
        out = rows if out is None else out.unionByName(rows)
    return out.select("model", "ticker", day("date").alias("date"), r6("prob_up").alias("prob_up"), "pred_up")


@query("d12_leakage_comparison", None)
def _(b: Base) -> DataFrame:
    return EX.leakage_comparison(b.hl, b.sen, b.px, test_start=CUT, model=MODEL)


@query("d13_same_day_leak", None)
def _(b: Base) -> DataFrame:
    return EX.same_day_leak(_complete(b), CUT)


@query("d15_cross_sectional_run", None)
def _(b: Base) -> DataFrame:
    return M.cross_sectional_run(_complete(b), CUT, NAMES)


# ---- sort, limit, service, figures ------------------------------------------------


@query("s1_newest_rows", f"SELECT ticker, {D('date')} AS date, {R('sent_mean')} AS sent_mean FROM (SELECT f.* FROM ft f JOIN px p ON f.ticker = p.ticker AND f.date = p.date ORDER BY f.date DESC, f.ticker LIMIT 200)")
def _(b: Base) -> DataFrame:
    return service.signal(b.ft, b.px).select("ticker", day("date").alias("date"), r6("sent_mean").alias("sent_mean"))


@query("s3_resumable_batch", f"SELECT h.headline_uid FROM hl h LEFT JOIN sen s ON s.headline_uid = h.headline_uid AND s.model = '{MODEL}' WHERE s.headline_uid IS NULL ORDER BY 1 LIMIT 100")
def _(b: Base) -> DataFrame:
    return HL.unscored(b.hl, b.sen, MODEL, 100).select("headline_uid")


@query("e1_health", "SELECT (SELECT count(*) FROM hl) AS n_headlines, (SELECT count(*) FROM ft) AS n_features")
def _(b: Base) -> DataFrame:
    return service.health(b.hl, b.ft)


@query("e3_signal", f"SELECT {D('f.date')} AS date, {R('f.sent_mean')} AS sent_mean, {R('p.adj_close')} AS adj_close FROM ft f JOIN px p ON f.ticker = p.ticker AND f.date = p.date WHERE f.ticker = 'XELV' ORDER BY f.date DESC LIMIT 50")
def _(b: Base) -> DataFrame:
    return service.signal(b.ft, b.px, " xelv ", 50).select(day("date").alias("date"), r6("sent_mean").alias("sent_mean"), r6("adj_close").alias("adj_close"))


@query("e4_predictions", f"SELECT model, ticker, {D('date')} AS date, {R('prob_up')} AS prob_up FROM (SELECT * FROM pr ORDER BY date DESC, ticker, model LIMIT 200)")
def _(b: Base) -> DataFrame:
    return service.newest_predictions(b.pr).select("model", "ticker", day("date").alias("date"), r6("prob_up").alias("prob_up"))


@query("e7_monitor_history", f"WITH {_ROLL} SELECT model, {D('date')} AS date, n, {R('rolling_accuracy')} AS rolling_accuracy FROM rr")
def _(b: Base) -> DataFrame:
    return service.monitor_history(b.pr, window=20).select("model", "date", "n", r6("rolling_accuracy").alias("rolling_accuracy"))


_SERIES = "se AS (SELECT p.date, 100 * p.adj_close / first_value(p.adj_close) OVER (ORDER BY p.date) AS indexed, f.sent_mean AS sent FROM px p LEFT JOIN ft f ON f.ticker = p.ticker AND f.date = p.date WHERE p.ticker = 'QYKPI' AND p.adj_close IS NOT NULL AND p.date BETWEEN DATE '2023-04-01' AND DATE '2023-12-31')"


_WHOLE_SERIES = "se AS (SELECT p.date, 100 * p.adj_close / first_value(p.adj_close) OVER (ORDER BY p.date) AS indexed, f.sent_mean AS sent FROM px p LEFT JOIN ft f ON f.ticker = p.ticker AND f.date = p.date WHERE p.ticker = 'QYKPI' AND p.adj_close IS NOT NULL)"


def _whole_series(b: Base) -> DataFrame:
    return figures.price_and_sentiment(b.px, b.ft, "QYKPI", SETTINGS.start_date, SETTINGS.end_date)


@query("w22_smoothed_sentiment", f"WITH {_WHOLE_SERIES} SELECT {D('date')} AS date, {R('indexed')} AS indexed, {R('sent')} AS sent, {R('CASE WHEN count(sent) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 3 THEN avg(sent) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END')} AS smoothed FROM se")
def _(b: Base) -> DataFrame:
    return _whole_series(b).select(day("date").alias("date"), *[r6(c).alias(c) for c in ("indexed", "sent", "smoothed")])


@query("w23_gaps", f"WITH {_WHOLE_SERIES}, g AS (SELECT date, sent IS NULL AS none, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY sent IS NULL ORDER BY date) AS run FROM se) SELECT {D('min(date)')} AS start, {D('max(date)')} AS \"end\", count(*) AS n_rows FROM g WHERE none GROUP BY run HAVING count(*) > 1")
def _(b: Base) -> DataFrame:
    return figures.gaps(_whole_series(b), 1).select(day("start").alias("start"), day("end").alias("end"), "n_rows")


@query("f4_model_ranking", f"WITH {_BASELINES.strip()}, a AS (SELECT model, avg(CASE WHEN pred_up = target_next_up THEN 1.0 ELSE 0.0 END) AS accuracy FROM bl GROUP BY 1) SELECT model, {R('accuracy')} AS accuracy, {R('(SELECT max(accuracy) FROM a)')} AS baseline_accuracy, true AS is_baseline FROM a")
def _(b: Base) -> DataFrame:
    train, test = M.split(_complete(b), CUT)
    out = figures.ranking(M.evaluate(M.baselines(train, test), by="model"))
    return out.select("model", r6("accuracy").alias("accuracy"), r6("baseline_accuracy").alias("baseline_accuracy"), "is_baseline")


@query("r1_pipeline", None)
def _(b: Base) -> DataFrame:
    """Prices, headlines, scores, features, studies, predictions, the cross-section and the monitor through a store, stage by stage.

    Row counts of what is stored and of what the studies give.
    """
    from quillpanel.plans.reference_queries import _store

    store, settings = _store(b), dataclasses.replace(SETTINGS, test_start=CUT, min_names_per_day=NAMES)
    pipeline.init(store)
    pipeline.ingest_prices(store, b.px)
    tickers = [r[0] for r in b.px.select("ticker").distinct().orderBy("ticker").collect()]
    raw = readers.load_raw(b.spark, [f"{b.dir}/headlines.parquet"], (), RQ._RAW)
    pipeline.ingest_headlines(store, raw, tickers)
    pipeline.score(store)
    release(b.spark)
    pipeline.build_features(store)
    release(b.spark)
    found = {}

    def keep(made: dict[str, DataFrame]) -> None:  # whole, not only counted
        for name, df in made.items():
            found[name] = store.write(name, df.coalesce(1))
        release(b.spark)

    keep({f"analyse_{name}": df for name, df in pipeline.analyse(store, settings).items()})
    keep({"train_metrics": pipeline.train(store, settings)})
    keep({"xs_models": M.cross_sectional_run(store.read("features"), CUT, NAMES)})
    pipeline.monitor(store, settings=settings)
    release(b.spark)
    out = None
    for t, df in (found | {t: store.read(t) for t in ("prices", "headlines", "sentiment", "features", "predictions", "monitor_log")}).items():
        one = df.agg(F.lit(t).alias("table_name"), F.count("*").alias("n")).select("table_name", "n")
        out = one if out is None else out.unionByName(one)
    return out
