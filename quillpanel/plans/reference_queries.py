"""One query per operator of the inventory (named by its id there), each with an independent SQL version."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.functions import numbers as N
from quillpanel.functions import stats, text
from quillpanel.functions.keys import clean_ticker, day
from quillpanel.operators import analysis as AN
from quillpanel.operators import cross_section as XS
from quillpanel.operators import features as FT
from quillpanel.operators import headlines as HL
from quillpanel.operators import sessions as S
from quillpanel.plans.base import BASE, MODEL, Base, R, r6
from quillpanel.runtime import shared_dir
from quillpanel.sources import readers, schema, writers
from quillpanel.sources.schema import FEATURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, base: bool = True):
    """Registers a function of ``Base`` under ``name`` with its SQL, given the clean tables unless ``base`` is off."""
    def register(f: Callable[[Base], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Base(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            ORACLE[name] = body if not base else f"WITH {BASE}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {BASE} {body}"
        return f

    return register


D = "strftime({}, '%Y-%m-%d')".format
T = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
WS = r"[\s\p{Z}\x{85}]+"
CUT = "2023-09-01"
#: Names a day must have in the cross-sectional queries: the smallest tables have few.
NAMES = 5

# ---- sources -----------------------------------------------------------------


@query("a2_projected_scan", f"SELECT ticker, {T('published_at')} AS published_at, title, publisher, url FROM headlines WHERE published_at >= TIMESTAMP '2023-06-01'", base=False)
def _(b: Base) -> DataFrame:
    df = readers.scan(b.spark, f"{b.dir}/headlines.parquet", ["ticker", "published_at", "title", "publisher", "url"], "published_at >= timestamp_ntz'2023-06-01 00:00:00'")
    return df.withColumn("published_at", stamp("published_at"))


_RAW = {"published_at": "published_at", "ticker": "ticker", "title": "title", "publisher": "publisher", "url": "url"}


@query("a3_universe_scan", "SELECT upper(trim(ticker)) AS ticker, count(*) AS n FROM headlines WHERE upper(trim(ticker)) IN ('XELV', 'VZXNP', 'QYKPI') GROUP BY 1", base=False)
def _(b: Base) -> DataFrame:
    return readers.load_raw(b.spark, [f"{b.dir}/headlines.parquet"], ["XELV", "VZXNP", "QYKPI"], _RAW).groupBy("ticker").agg(F.count("*").alias("n"))


@query("a4_shard_union", "SELECT upper(trim(ticker)) AS ticker, 2 * count(*) AS n FROM headlines GROUP BY 1", base=False)
def _(b: Base) -> DataFrame:
    return readers.load_raw(b.spark, [f"{b.dir}/headlines.parquet"] * 2, (), _RAW).groupBy("ticker").agg(F.count("*").alias("n"))


@query("a5_price_window", "SELECT ticker, count(*) AS n FROM px WHERE date BETWEEN DATE '2023-07-01' - 90 AND DATE '2023-09-30' + 10 GROUP BY 1")
def _(b: Base) -> DataFrame:
    return readers.price_window(b.px, "2023-07-01", "2023-09-30").groupBy("ticker").agg(F.count("*").alias("n"))


@query("a6_csv_prices", f"SELECT ticker, {D('date')} AS date, {R('close')} AS close, {R('close')} AS adj_close FROM px WHERE ticker IS NOT NULL AND date IS NOT NULL")
def _(b: Base) -> DataFrame:
    """Every ticker's file, written in one pass, and one that is missing; the settings' whole range of dates."""
    folder = f"{shared_dir(b.spark)}/csv-{uuid.uuid4().hex}"
    rows = b.px.where("ticker is not null").select("ticker", F.col("date").alias("Date"), *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")])
    rows.repartition("ticker").write.partitionBy("ticker").csv(folder, header=True)
    names = [r[0] for r in b.px.where("ticker is not null").select("ticker").distinct().orderBy("ticker").collect()]  # the universe
    paths = {t: f"{folder}/ticker={t}" for t in [*names, "MISSING"]}
    return readers.csv_prices(b.spark, paths, SETTINGS.start_date, SETTINGS.end_date).select("ticker", day("date").alias("date"), r6("close").alias("close"), r6("adj_close").alias("adj_close"))


@query("a7_source_fallback", "SELECT ticker, count(*) AS n FROM px GROUP BY 1")
def _(b: Base) -> DataFrame:
    missing = lambda: b.spark.read.parquet(f"{b.dir}/no_such_table.parquet")
    return readers.first_source(missing, lambda: b.px.where("false"), lambda: b.px).groupBy("ticker").agg(F.count("*").alias("n"))


@query("a8_sql_parameters", "SELECT ticker, count(*) AS n FROM px WHERE date >= DATE '2023-08-01' AND adj_close > 100 GROUP BY 1")
def _(b: Base) -> DataFrame:
    return readers.read_sql(b.spark, "SELECT ticker, count(*) AS n FROM {px} WHERE date >= to_date(:since) AND adj_close > :least GROUP BY ticker", {"since": "2023-08-01", "least": 100}, px=b.px)


@query("a9_ordered_scan", f"SELECT {D('date')} AS date, ticker, {R('sent_mean')} AS sent_mean FROM ft ORDER BY ft.date, ticker")
def _(b: Base) -> DataFrame:
    return b.ft.orderBy("date", "ticker").select(day("date").alias("date"), "ticker", r6("sent_mean").alias("sent_mean"))


@query("a10_column_parameter", f"SELECT ticker, {D('date')} AS date, {R('ma_gap')} AS ma_gap, {R('fwd_ret_1d')} AS fwd_ret_1d FROM ft")
def _(b: Base) -> DataFrame:
    df = readers.pick(b.ft, ["ticker", "date", "fwd_ret_1d", *FEATURES], "ticker", "date", "ma_gap", "fwd_ret_1d")
    return df.select("ticker", day("date").alias("date"), r6("ma_gap").alias("ma_gap"), r6("fwd_ret_1d").alias("fwd_ret_1d"))


# ---- sinks -------------------------------------------------------------------

_UPSERTED = f"SELECT ticker, {D('date')} AS date, {R('close')} AS close, {R('''CASE WHEN ticker = 'XELV' THEN 2 * adj_close ELSE adj_close END''')} AS adj_close FROM px UNION ALL SELECT 'NEWCO', {D('date')}, NULL, 7.0 FROM px WHERE ticker = 'XELV'"


def _changes(b: Base) -> DataFrame:
    own = b.px.where("ticker = 'XELV'").select("ticker", "date", (2 * F.col("adj_close")).alias("adj_close"))
    return own.unionByName(own.select(F.lit("NEWCO").alias("ticker"), "date", F.lit(7.0).alias("adj_close")))


_prices_out = lambda df: df.select("ticker", day("date").alias("date"), r6("close").alias("close"), r6("adj_close").alias("adj_close"))


@query("b1_upsert", _UPSERTED)
def _(b: Base) -> DataFrame:
    return _prices_out(writers.upserted(b.px, _changes(b), ["ticker", "date"]))


def _store(b: Base) -> writers.Store:
    return writers.Store(b.spark, f"{shared_dir(b.spark)}/store-{uuid.uuid4().hex}")


@query("b2_stored_upsert", _UPSERTED)
def _(b: Base) -> DataFrame:
    store = _store(b)
    store.write("prices", b.px)
    store.upsert("prices", _changes(b), ["ticker", "date"])
    return _prices_out(store.upsert("prices", _changes(b), ["ticker", "date"]))


@query("b3_replace_by_key", f"SELECT ticker, count(*) AS n FROM hl WHERE ticker NOT IN ('XELV', 'VZXNP') OR (ticker = 'XELV' AND published_at >= TIMESTAMP '{CUT}') GROUP BY 1")
def _(b: Base) -> DataFrame:
    new = b.hl.where((F.col("ticker") == "XELV") & (F.col("published_at") >= F.lit(CUT).cast("timestamp_ntz")))
    return writers.replaced(b.hl, new, "ticker", ["XELV", "VZXNP"]).groupBy("ticker").agg(F.count("*").alias("n"))


@query("b4_truncate_load", "SELECT ticker, count(*) AS n FROM ft WHERE target_next_up IS NOT NULL GROUP BY 1")
def _(b: Base) -> DataFrame:
    store = _store(b)
    store.write("features", b.ft)
    return store.write("features", b.ft.where("target_next_up is not null")).groupBy("ticker").agg(F.count("*").alias("n"))


@query("b5_append_log", "SELECT k * 10000 + row_number() OVER (PARTITION BY k ORDER BY model) + (SELECT count(DISTINCT model) FROM pr) * k - k * 10000 AS id, model FROM (SELECT DISTINCT model FROM pr), (VALUES (0), (1)) AS v(k)")
def _(b: Base) -> DataFrame:
    store = _store(b)
    fields = "id bigint, model string"
    log = store.create("log", fields=b.spark.createDataFrame([], fields).schema)
    for _ in range(2):
        log = store.append("log", writers.numbered(b.pr.select("model").distinct(), store.read("log"), ["model"]).select("id", "model"))
    return log


@query("b6_backfill_outcomes", f"SELECT p.model, p.ticker, {D('p.date')} AS date, {R('CASE WHEN p.realized_up IS NULL THEN f.fwd_ret_1d ELSE p.realized_ret END')} AS realized_ret, CASE WHEN p.realized_up IS NULL THEN f.target_next_up ELSE p.realized_up END AS realized_up FROM pr p LEFT JOIN ft f ON p.ticker = f.ticker AND p.date = f.date")
def _(b: Base) -> DataFrame:
    out = writers.backfilled(b.pr, b.ft)
    return out.select("model", "ticker", day("date").alias("date"), r6("realized_ret").alias("realized_ret"), "realized_up")


@query("b7_empty_tables", "SELECT table_name, CAST(n AS BIGINT) AS n FROM (VALUES ('headlines', 0), ('sentiment', 0), ('prices', 0), ('features', 0), ('predictions', 0), ('monitor_log', 0)) AS v(table_name, n)", base=False)
def _(b: Base) -> DataFrame:
    store = _store(b)
    out = None
    for t in schema.KEYS:
        one = store.create(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("b9_integrity", "SELECT 'primary key' AS rule, CAST(count(*) - count(DISTINCT (ticker, date)) AS BIGINT) AS n FROM prices HAVING count(*) > count(DISTINCT (ticker, date))", base=False)
def _(b: Base) -> DataFrame:
    return schema.violations(b.raw("prices"), "prices").select("rule", F.col("n").cast("long").alias("n"))


# ---- projections, filters, scalar functions ------------------------------------

_TEXTS = "CASE length(title) % 4 WHEN 0 THEN strftime(published_at, '%Y-%m-%d %H:%M:%S') || ' UTC' WHEN 1 THEN strftime(published_at, '%Y-%m-%d') WHEN 2 THEN strftime(published_at, '%m/%d/%Y %H:%M') ELSE 'soon' END"


@query("c3_parse_timestamps", f"SELECT headline_uid, CASE length(title) % 4 WHEN 0 THEN strftime(published_at, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(published_at, '%Y-%m-%d 00:00:00') WHEN 2 THEN strftime(published_at, '%Y-%m-%d %H:%M:00') END AS parsed FROM hl")
def _(b: Base) -> DataFrame:
    k = F.length("title") % 4
    written = F.when(k == 0, F.concat(stamp("published_at"), F.lit(" UTC"))).when(k == 1, day("published_at")).when(k == 2, F.date_format("published_at", "MM/dd/yyyy HH:mm")).otherwise("soon")
    return b.hl.select("headline_uid", stamp(text.parse_utc(written)).alias("parsed"))


@query("c4_one_line_titles", f"SELECT lower(trim(headline_uid)) AS headline_uid, trim(regexp_replace(title, '{WS}', ' ', 'g')) AS title FROM headlines", base=False)
def _(b: Base) -> DataFrame:
    return b.raw("headlines").select(F.lower(F.trim("headline_uid")).alias("headline_uid"), text.one_line(F.col("title")).alias("title"))


@query("c5_least_length", "SELECT headline_uid FROM hl WHERE length(title) >= 60")
def _(b: Base) -> DataFrame:
    return b.hl.where(F.length("title") >= 60).select("headline_uid")


@query("c6_first_of_record", f"SELECT upper(trim(ticker)) AS ticker, {T('published_at')} AS published_at, title, min(coalesce(publisher, '')) AS publisher FROM headlines GROUP BY upper(trim(ticker)), headlines.published_at, title", base=False)
def _(b: Base) -> DataFrame:
    rows = b.raw("headlines").select(clean_ticker("ticker").alias("ticker"), "published_at", "title", F.coalesce("publisher", F.lit("")).alias("publisher"))
    return HL.first_of(rows, ["ticker", "published_at", "title"], ["publisher"]).withColumn("published_at", stamp("published_at"))


@query("c7_first_of_uid", f"SELECT lower(trim(headline_uid)) AS headline_uid, {D('min(trade_date)')} AS trade_date FROM headlines GROUP BY 1", base=False)
def _(b: Base) -> DataFrame:
    rows = b.raw("headlines").select(F.lower(F.trim("headline_uid")).alias("headline_uid"), "trade_date")
    return HL.first_of(rows, ["headline_uid"], ["trade_date"]).withColumn("trade_date", day("trade_date"))


@query("c8_fill_and_cut", "SELECT lower(trim(headline_uid)) AS headline_uid, substring(coalesce(publisher, ''), 1, 128) AS publisher, coalesce(url, '') AS url FROM headlines", base=False)
def _(b: Base) -> DataFrame:
    return b.raw("headlines").select(F.lower(F.trim("headline_uid")).alias("headline_uid"), F.substring(F.coalesce("publisher", F.lit("")), 1, 128).alias("publisher"), F.coalesce("url", F.lit("")).alias("url"))


@query("c9_date_clamp", "SELECT ticker, count(*) AS n FROM px WHERE date BETWEEN DATE '2023-06-01' AND DATE '2023-08-31' GROUP BY 1")
def _(b: Base) -> DataFrame:
    return b.px.where(F.col("date").between(F.lit("2023-06-01").cast("date"), F.lit("2023-08-31").cast("date"))).groupBy("ticker").agg(F.count("*").alias("n"))


@query("c10_record_uid", rf"SELECT headline_uid AS stored, sha1(ticker || '|' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(published_at) % 1000000 <> 0 THEN strftime(published_at, '.%f') ELSE '' END || '|' || regexp_replace(regexp_replace(title, '^{WS}', ''), '{WS}$', '')) AS uid FROM headlines", base=False)
def _(b: Base) -> DataFrame:
    return b.raw("headlines").select(F.col("headline_uid").alias("stored"), text.record_uid(F.col("ticker"), F.col("published_at"), F.col("title")).alias("uid"))


_LOCAL = "timezone('America/New_York', timezone('UTC', published_at))"


@query("c11_exchange_time", f"SELECT headline_uid, {T(_LOCAL)} AS local FROM hl")
def _(b: Base) -> DataFrame:
    return b.hl.select("headline_uid", stamp(S.exchange_time(F.col("published_at"))).alias("local"))


@query("c12_after_cutoff", f"SELECT ticker, count(*) AS n FROM hl WHERE hour({_LOCAL}) * 60 + minute({_LOCAL}) >= 960 GROUP BY 1")
def _(b: Base) -> DataFrame:
    return b.hl.where(S.after_cutoff(S.exchange_time(F.col("published_at")))).groupBy("ticker").agg(F.count("*").alias("n"))


_CAND = f"(CAST({_LOCAL} AS DATE) + CASE WHEN hour({_LOCAL}) * 60 + minute({_LOCAL}) >= 960 THEN 1 ELSE 0 END)"


@query("c13_candidate_day", f"SELECT headline_uid, {D(_CAND)} AS day FROM hl")
def _(b: Base) -> DataFrame:
    return b.hl.select("headline_uid", day(S.candidate_day(F.col("published_at"))).alias("day"))


@query("c14_news_date", f"SELECT {D('CAST(published_at AS DATE)')} AS news_date, count(*) AS n FROM hl GROUP BY 1")
def _(b: Base) -> DataFrame:
    return b.hl.groupBy(day(F.to_date("published_at")).alias("news_date")).agg(F.count("*").alias("n"))


@query("c15_year_and_month", f"SELECT year(date) AS year, {D('''date_trunc('month', date)''')} AS month, count(*) AS n FROM px GROUP BY 1, 2")
def _(b: Base) -> DataFrame:
    return b.px.groupBy(F.year("date").cast("long").alias("year"), day(F.trunc("date", "month")).alias("month")).agg(F.count("*").alias("n"))


@query("c16_score_and_label", f"SELECT headline_uid, model, {R('p_pos - p_neg')} AS score, CASE WHEN p_pos - p_neg > 0.15 THEN 'pos' WHEN p_pos - p_neg < -0.15 THEN 'neg' ELSE 'neu' END AS label FROM sen")
def _(b: Base) -> DataFrame:
    s = F.col("p_pos") - F.col("p_neg")
    return b.sen.select("headline_uid", "model", r6(s).alias("score"), N.score_label(s).alias("label"))


@query("c18_net_fraction", f"SELECT ticker, {D('date')} AS date, {R('sent_pos_frac - sent_neg_frac')} AS net FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.select("ticker", day("date").alias("date"), r6(F.col("sent_pos_frac") - F.col("sent_neg_frac")).alias("net"))


@query("c19_up_label", f"SELECT ticker, {D('date')} AS date, CASE WHEN fwd_ret_1d IS NULL THEN NULL WHEN fwd_ret_1d > 0 THEN 1 ELSE 0 END AS up FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.select("ticker", day("date").alias("date"), N.up_label(F.col("fwd_ret_1d")).alias("up"))


@query("c21_complete_rows", f"SELECT count(*) AS n FROM ft WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} AND target_next_up IS NOT NULL")
def _(b: Base) -> DataFrame:
    return b.ft.dropna(subset=[*FEATURES, "target_next_up"]).agg(F.count("*").alias("n"))


@query("c22_threshold_class", "SELECT model, CASE WHEN prob_up >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM pr GROUP BY 1, 2")
def _(b: Base) -> DataFrame:
    return b.pr.groupBy("model", N.at_least(F.col("prob_up")).alias("pred")).agg(F.count("*").alias("n"))


@query("c23_squash", f"SELECT ticker, {D('date')} AS date, {R('1 / (1 + exp(-10 * ma_cross))')} AS ma, {R('1 / (1 + exp(-2 * sent_mean))')} AS tone FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.select("ticker", day("date").alias("date"), r6(N.squash(F.col("ma_cross"), 10.0)).alias("ma"), r6(N.squash(F.col("sent_mean"), 2.0)).alias("tone"))


@query("c24_signed_return", f"SELECT model, {R('avg((2 * pred_up - 1) * realized_ret)')} AS mean_ret FROM pr WHERE realized_ret IS NOT NULL GROUP BY 1")
def _(b: Base) -> DataFrame:
    return b.pr.where("realized_ret is not null").groupBy("model").agg(r6(F.avg((2 * F.col("pred_up") - 1) * F.col("realized_ret"))).alias("mean_ret"))


@query("c25_finite_and_clip", f"SELECT ticker, {D('date')} AS date, {R('greatest(sent_mean, 0.0)')} AS clipped FROM ft WHERE sent_mean IS NOT NULL")
def _(b: Base) -> DataFrame:
    x = N.finite(F.col("sent_mean"))
    return b.ft.where(x.isNotNull()).select("ticker", day("date").alias("date"), r6(F.greatest(x, F.lit(0.0))).alias("clipped"))


@query("c26_safe_ratio", f"SELECT ticker, {D('date')} AS date, {R('CASE WHEN sent_std <> 0 THEN sent_mean / sent_std END')} AS ratio FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.select("ticker", day("date").alias("date"), r6(N.ratio(F.col("sent_mean"), F.col("sent_std"))).alias("ratio"))


@query("c27_zero_for_null", f"SELECT ticker, {D('date')} AS date, {R('coalesce(sent_surprise, 0.0)')} AS surprise FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.select("ticker", day("date").alias("date"), r6(F.coalesce("sent_surprise", F.lit(0.0))).alias("surprise"))


_PARTS = ("sent_mean", "sent_net", "sent_surprise")


@query("c28_row_mean", f"SELECT ticker, {D('date')} AS date, {R('(' + ' + '.join(f'coalesce({c}, 0)' for c in _PARTS) + ') / nullif(' + ' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in _PARTS) + ', 0)')} AS mean FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.select("ticker", day("date").alias("date"), r6(N.row_mean([F.col(c) for c in _PARTS])).alias("mean"))


@query("c29_weighted_sum", f"SELECT ticker, {D('date')} AS date, {R('-news_vol_z - ret_1d - volume_z')} AS s FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.select("ticker", day("date").alias("date"), r6(N.weighted_sum(SETTINGS.sign_prior, b.ft.columns)).alias("s"))


@query("c30_prefix", "SELECT model, count(*) AS n FROM pr WHERE starts_with(model, 'logit') GROUP BY 1")
def _(b: Base) -> DataFrame:
    return b.pr.where(F.col("model").startswith("logit")).groupBy("model").agg(F.count("*").alias("n"))


@query("c31_map_with_default", f"SELECT ticker, {D('date')} AS date, {R('CASE WHEN n_headlines >= 2 THEN sent_mean ELSE 0.0 END')} AS sent_mean, {R('coalesce(ret_1d, 0.0)')} AS ret_1d, CASE WHEN n_headlines >= 2 THEN 'volume_z' ELSE 'sent_mean,volume_z' END AS missing FROM ft WHERE sent_mean IS NOT NULL")
def _(b: Base) -> DataFrame:
    request = F.map_filter(F.create_map(F.lit("sent_mean"), "sent_mean", F.lit("ret_1d"), "ret_1d"), lambda k, v: (k != "sent_mean") | (F.col("n_headlines") >= 2))
    rows = b.ft.where("sent_mean is not null").withColumn("request", request)
    names = ["sent_mean", "ret_1d", "volume_z"]
    sent, ret, _ = N.from_map(F.col("request"), names)
    return rows.select("ticker", day("date").alias("date"), r6(sent).alias("sent_mean"), r6(ret).alias("ret_1d"), F.array_join(N.missing_names(F.col("request"), names), ",").alias("missing"))


@query("c32_scaled", f"SELECT ticker, {R('1e4 * avg(fwd_ret_1d)')} AS bps, {R('avg(ln(1 + abs(fwd_ret_1d)))')} AS log_abs, {R('sqrt(252.0) * avg(fwd_ret_1d)')} AS yearly FROM ft WHERE fwd_ret_1d IS NOT NULL GROUP BY 1")
def _(b: Base) -> DataFrame:
    f = F.col("fwd_ret_1d")
    return b.ft.where(f.isNotNull()).groupBy("ticker").agg(r6(1e4 * F.avg(f)).alias("bps"), r6(F.avg(F.log(1 + F.abs(f)))).alias("log_abs"), r6(F.sqrt(F.lit(252.0)) * F.avg(f)).alias("yearly"))


@query("c33_indexed_price", f"SELECT ticker, {D('date')} AS date, {R('100 * adj_close / first_value(adj_close) OVER (PARTITION BY ticker ORDER BY date)')} AS indexed FROM px WHERE adj_close > 0 AND date >= DATE '2023-06-01'")
def _(b: Base) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    rows = b.px.where("adj_close > 0 and date >= date'2023-06-01'")
    return rows.select("ticker", day("date").alias("date"), r6(100 * F.col("adj_close") / F.first("adj_close").over(w)).alias("indexed"))


@query("c35_literal_columns", "SELECT DISTINCT model, 1 AS extra_lag, 'all' AS block FROM pr")
def _(b: Base) -> DataFrame:
    return b.pr.select("model").distinct().withColumns({"extra_lag": F.lit(1), "block": F.lit("all")})


# ---- joins -------------------------------------------------------------------


@query("j1_scored_headlines", f"SELECT h.ticker, count(*) AS n, {R('avg(s.score)')} AS score FROM hl h JOIN sen s ON s.headline_uid = h.headline_uid AND s.model = '{MODEL}' GROUP BY 1")
def _(b: Base) -> DataFrame:
    return b.hl.join(b.sen.where(F.col("model") == MODEL), "headline_uid").groupBy("ticker").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("score"))


@query("j3_unscored", f"SELECT h.headline_uid FROM hl h LEFT JOIN sen s ON s.headline_uid = h.headline_uid AND s.model = '{MODEL}' WHERE s.headline_uid IS NULL")
def _(b: Base) -> DataFrame:
    return HL.unscored(b.hl, b.sen, MODEL).select("headline_uid")


_IDX = "(SELECT count(*) FROM cal c WHERE c.session < {})"
_ATTRIBUTED = f"""
cand AS (SELECT *, {_CAND} AS cday FROM hl),
snap AS (SELECT cand.*, coalesce(c.idx, (SELECT count(*) FROM cal)) AS at FROM cand ASOF LEFT JOIN cal c ON cand.cday <= c.session),
att AS (SELECT s.* EXCLUDE (trade_date), c.session AS trade_date FROM snap s LEFT JOIN cal c ON c.idx = s.at + 1)"""


@query("j4_session_snap", f"WITH {_ATTRIBUTED.strip()} SELECT headline_uid, {D('trade_date')} AS trade_date FROM att")
def _(b: Base) -> DataFrame:
    return S.attribute(b.hl.drop("trade_date"), S.calendar(b.px), lag=1).select("headline_uid", day("trade_date").alias("trade_date"))


_LEADLAG = f"""
ret AS (SELECT ticker, CAST(date AS DATE) AS session, adj_close / nullif(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM px),
news AS (SELECT h.ticker, CAST(h.published_at AS DATE) AS nd, round(avg(s.score), 12) AS sent, count(*) AS n FROM hl h JOIN sen s ON s.headline_uid = h.headline_uid AND s.model = '{MODEL}' GROUP BY 1, 2 HAVING count(*) >= 3),
placed AS (SELECT n.*, coalesce(c.idx, (SELECT count(*) FROM cal)) AS at FROM news n ASOF LEFT JOIN cal c ON n.nd <= c.session),
pairs AS (SELECT k.k AS lag_k, p.sent, r.ret FROM placed p, (SELECT unnest(range(-3, 4)) AS k) k JOIN cal c ON c.idx = p.at + k.k JOIN ret r ON r.ticker = p.ticker AND r.session = c.session WHERE r.ret IS NOT NULL)"""


@query("j5_shifted_returns", f"WITH {_LEADLAG.strip()} SELECT lag_k, count(*) AS n, {R('avg(sent)')} AS sent, {R('avg(ret)')} AS ret FROM pairs GROUP BY 1")
def _(b: Base) -> DataFrame:
    pairs = AN.lead_lag_pairs(AN.daily_news(b.hl, b.sen, MODEL), b.px)
    return pairs.groupBy(F.col("lag_k").cast("long").alias("lag_k")).agg(F.count("*").alias("n"), r6(F.avg("sent")).alias("sent"), r6(F.avg("ret")).alias("ret"))


@query("j6_recent_rows", "SELECT l.model, ft.ticker, count(*) AS n FROM ft JOIN (SELECT model, date FROM (SELECT DISTINCT model, date, dense_rank() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM pr WHERE realized_up IS NOT NULL) WHERE k <= 20) l ON l.date = ft.date GROUP BY 1, 2")
def _(b: Base) -> DataFrame:
    from quillpanel.operators import monitor as MO

    return b.ft.join(MO.last_dates(b.pr, 20), "date").groupBy("model", "ticker").agg(F.count("*").alias("n"))


@query("j8_features_with_prices", f"SELECT f.ticker, {D('f.date')} AS date, {R('f.sent_mean')} AS sent_mean, {R('p.adj_close')} AS adj_close FROM ft f JOIN px p ON f.ticker = p.ticker AND f.date = p.date")
def _(b: Base) -> DataFrame:
    return b.ft.join(b.px, ["ticker", "date"]).select("ticker", day("date").alias("date"), r6("sent_mean").alias("sent_mean"), r6("adj_close").alias("adj_close"))


@query("j10_on_price_calendar", f"SELECT p.ticker, {D('p.date')} AS date, {R('f.sent_mean')} AS sent_mean FROM px p LEFT JOIN ft f ON f.ticker = p.ticker AND f.date = p.date")
def _(b: Base) -> DataFrame:
    return b.px.join(b.ft.select("ticker", "date", "sent_mean"), ["ticker", "date"], "left").select("ticker", day("date").alias("date"), r6("sent_mean").alias("sent_mean"))


@query("j11_label_check", "SELECT count(*) AS n, CAST(sum(CASE WHEN f.fwd_ret_1d > 0 THEN 1 ELSE 0 END <> f.target_next_up) AS BIGINT) AS wrong FROM ft f JOIN px p ON f.ticker = p.ticker AND f.date = p.date WHERE f.fwd_ret_1d IS NOT NULL AND f.target_next_up IS NOT NULL")
def _(b: Base) -> DataFrame:
    rows = b.ft.where("fwd_ret_1d is not null and target_next_up is not null").join(b.px.select("ticker", "date"), ["ticker", "date"])
    return rows.agg(F.count("*").alias("n"), F.sum((N.up_label(F.col("fwd_ret_1d")) != F.col("target_next_up")).cast("long")).alias("wrong"))


@query("u1_union_all", "SELECT ticker, count(*) AS n FROM (SELECT ticker FROM px UNION ALL SELECT ticker FROM ft) GROUP BY 1")
def _(b: Base) -> DataFrame:
    return b.px.select("ticker").unionByName(b.ft.select("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))


# ---- aggregates --------------------------------------------------------------

_DAILY = f"""
daily AS (
  SELECT h.ticker, h.trade_date AS date, CAST(count(*) AS DOUBLE) AS n_headlines, avg(s.score) AS sent_mean, sqrt(greatest(avg(s.score * s.score) - avg(s.score) * avg(s.score), 0)) AS sent_std,
    avg(CASE WHEN s.label = 'pos' THEN 1.0 ELSE 0.0 END) AS sent_pos_frac, avg(CASE WHEN s.label = 'neg' THEN 1.0 ELSE 0.0 END) AS sent_neg_frac
  FROM {{}} h JOIN sen s ON s.headline_uid = h.headline_uid AND s.model = '{MODEL}' WHERE h.trade_date IS NOT NULL GROUP BY 1, 2
)""".format


def _rounded(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*[day(k).alias(k) if k == "date" else F.col(k) for k in keys], *[r6(c).alias(c) for c in cols])


@query("g1_daily_sentiment", f"WITH {_DAILY('hl').strip()} SELECT ticker, {D('date')} AS date, {', '.join(f'{R(c)} AS {c}' for c in ('n_headlines', 'sent_mean', 'sent_pos_frac', 'sent_neg_frac'))}, {R('sent_pos_frac - sent_neg_frac')} AS sent_net FROM daily")
def _(b: Base) -> DataFrame:
    return _rounded(FT.daily_sentiment(b.hl, b.sen, MODEL), ["ticker", "date"], ["n_headlines", "sent_mean", "sent_pos_frac", "sent_neg_frac", "sent_net"])


@query("g2_population_std", f"WITH {_DAILY('hl').strip()} SELECT ticker, {D('date')} AS date, (round(sent_std, 5) + 0.0) AS sent_std FROM daily")
def _(b: Base) -> DataFrame:
    return FT.daily_sentiment(b.hl, b.sen, MODEL).select("ticker", day("date").alias("date"), (F.round("sent_std", 5) + 0.0).alias("sent_std"))


@query("g3_daily_news", f"WITH {_LEADLAG.strip()} SELECT ticker, {D('nd')} AS news_date, {R('sent')} AS sent, n FROM news")
def _(b: Base) -> DataFrame:
    return AN.daily_news(b.hl, b.sen, MODEL).select("ticker", day("news_date").alias("news_date"), r6("sent").alias("sent"), "n")


@query("g4_calendar", f"SELECT {D('session')} AS session, idx FROM cal")
def _(b: Base) -> DataFrame:
    return S.calendar(b.px).select(day("session").alias("session"), F.col("idx").cast("long").alias("idx"))


@query("g6_table_summary", f"SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, {D('min(date)')} AS first, {D('max(date)')} AS last, {R('avg(CASE WHEN target_next_up = 1 THEN 1.0 WHEN target_next_up = 0 THEN 0.0 END)')} AS up_rate FROM ft")
def _(b: Base) -> DataFrame:
    return b.ft.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), day(F.min("date")).alias("first"), day(F.max("date")).alias("last"), r6(F.avg("target_next_up")).alias("up_rate"))


def _spearman(source: str, by: str, x: str, y: str) -> str:
    rank = lambda c: f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"
    return f"SELECT {by}, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) AS rho, count(*) AS n FROM (SELECT {by}, {rank(x)} AS rx, {rank(y)} AS ry FROM {source}) GROUP BY {by}"


@query("g10_lead_lag", f"WITH {_LEADLAG.strip()} SELECT lag_k, {R('rho')} AS spearman, n FROM ({_spearman('pairs', 'lag_k', 'sent', 'ret')})")
def _(b: Base) -> DataFrame:
    return AN.lead_lag(b.hl, b.sen, b.px, MODEL).select(F.col("lag_k").cast("long").alias("lag_k"), r6("spearman").alias("spearman"), "n")


@query("g8_p_values", None)
def _(b: Base) -> DataFrame:
    return AN.information_coefficient(b.ft).select("period", "p_value")


_IC = f"ps AS (SELECT unnest(['ALL', CAST(year(date) AS VARCHAR)]) AS period, sent_mean AS x, fwd_ret_1d AS y FROM ft WHERE sent_mean IS NOT NULL AND fwd_ret_1d IS NOT NULL)"


@query("g9_information_coefficient", f"WITH {_IC} SELECT period, {R('rho')} AS ic, n FROM ({_spearman('ps', 'period', 'x', 'y')})")
def _(b: Base) -> DataFrame:
    return AN.information_coefficient(b.ft).select("period", r6("ic").alias("ic"), "n")


@query("g11_peak_lag", f"WITH {_LEADLAG.strip()} SELECT lag_k, CASE WHEN lag_k = 0 THEN 'CONTEMPORANEOUS' ELSE 'predictive' END AS verdict FROM ({_spearman('pairs', 'lag_k', 'sent', 'ret')}) ORDER BY rho DESC LIMIT 1")
def _(b: Base) -> DataFrame:
    return AN.peak(AN.lead_lag(b.hl, b.sen, b.px, MODEL)).select(F.col("lag_k").cast("long").alias("lag_k"), "verdict")


@query("g12_quantile_buckets", f"""
WITH o AS (SELECT sent_mean, fwd_ret_1d, target_next_up, row_number() OVER (ORDER BY sent_mean, date, ticker) AS r, count(*) OVER () AS n FROM ft WHERE sent_mean IS NOT NULL AND fwd_ret_1d IS NOT NULL)
SELECT 'Q' || greatest(1, ((r - 1) * 5 + n - 2) // (n - 1)) AS bucket, count(*) AS n, {R('1e4 * avg(fwd_ret_1d)')} AS mean_fwd_ret_bps, {R('avg(target_next_up)')} AS hit_rate, {R('avg(sent_mean)')} AS mean_sentiment FROM o GROUP BY 1""")
def _(b: Base) -> DataFrame:
    out = AN.buckets(b.ft)
    return out.select("bucket", "n", *[r6(c).alias(c) for c in ("mean_fwd_ret_bps", "hit_rate", "mean_sentiment")])


_DAYIC = f"""
dp AS (SELECT date, sent_mean AS s, fwd_ret_1d AS f FROM ft WHERE sent_mean IS NOT NULL AND fwd_ret_1d IS NOT NULL),
dc AS (SELECT date, count(*) AS n, count(DISTINCT f) AS d FROM dp GROUP BY 1),
ic AS (SELECT r.date, r.rho AS ic FROM ({_spearman('dp', 'date', 's', 'f')}) r JOIN dc ON r.date = dc.date WHERE dc.n >= {NAMES} AND dc.d >= 2 AND r.rho IS NOT NULL)"""


@query("g13_daily_ic", f"WITH {_DAYIC.strip()} SELECT {D('date')} AS date, {R('ic')} AS ic FROM ic")
def _(b: Base) -> DataFrame:
    return XS.daily_ic(b.ft, "sent_mean", least=NAMES).select(day("date").alias("date"), r6("ic").alias("ic"))


@query("g14_ic_summary", f"WITH {_DAYIC.strip()} SELECT {R('avg(ic)')} AS mean_ic, {R('stddev_samp(ic)')} AS ic_std, {R('avg(ic) / (stddev_samp(ic) / sqrt(count(*)))')} AS ic_t, {R('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS share_positive, count(*) AS n_days FROM ic")
def _(b: Base) -> DataFrame:
    out = XS.ic_summary(XS.daily_ic(b.ft, "sent_mean", least=NAMES))
    return out.select(*[r6(c).alias(c) for c in ("mean_ic", "ic_std", "ic_t", "share_positive")], "n_days")


_EVAL = f"""
e AS (SELECT model, realized_up AS y, pred_up AS p, prob_up AS q, realized_ret AS f, rank() OVER (PARTITION BY model ORDER BY prob_up) + (count(*) OVER (PARTITION BY model, prob_up) - 1) / 2.0 AS r FROM pr WHERE realized_up IS NOT NULL)
SELECT model, count(*) AS n, {R('avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)')} AS accuracy,
  {R('(avg(CASE WHEN y = 1 THEN p * 1.0 END) + avg(CASE WHEN y = 0 THEN 1.0 - p END)) / 2')} AS balanced_accuracy,
  {R('(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)) * 1.0)')} AS roc_auc,
  {R('2.0 * sum(y * p) / (sum(y) + sum(p))')} AS f1_up, {R('avg(p * 1.0)')} AS pred_up_rate, {R('1e4 * avg((2 * p - 1) * f)')} AS mean_ret_bps, {R('avg((2 * p - 1) * f) / stddev_pop((2 * p - 1) * f) * sqrt(252.0)')} AS sharpe
FROM e GROUP BY 1"""


@query("g16_classifier_metrics", f"WITH {_EVAL.strip()}")
def _(b: Base) -> DataFrame:
    from quillpanel.operators import models as M

    out = M.evaluate(b.pr, "realized_up", forward="realized_ret", by="model")
    return out.select("model", "n", *[r6(c).alias(c) for c in out.columns if c not in ("model", "n")])


_PSI = """
e AS (SELECT sent_mean AS x FROM ft WHERE date < DATE '2023-09-01' AND sent_mean IS NOT NULL), a AS (SELECT sent_mean AS x FROM ft WHERE date >= DATE '2023-09-01' AND sent_mean IS NOT NULL),
edges AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS v FROM e),
bins AS (SELECT unnest(range(0, len(v) - 1)) AS bin FROM edges),
he AS (SELECT len(list_filter(v[2:len(v) - 1], lambda t: t <= x)) AS bin, count(*) AS c FROM e, edges GROUP BY 1),
ha AS (SELECT len(list_filter(v[2:len(v) - 1], lambda t: t <= x)) AS bin, count(*) AS c FROM a, edges GROUP BY 1),
sh AS (SELECT b.bin, greatest(coalesce(he.c, 0) / (SELECT count(*) * 1.0 FROM e), 1e-6) AS pe, greatest(coalesce(ha.c, 0) / (SELECT count(*) * 1.0 FROM a), 1e-6) AS pa FROM bins b LEFT JOIN he ON he.bin = b.bin LEFT JOIN ha ON ha.bin = b.bin)"""


@query("g17_psi", f"WITH {_PSI.strip()} SELECT {R('sum((pa - pe) * ln(pa / pe))')} AS psi FROM sh")
def _(b: Base) -> DataFrame:
    cut = F.lit(CUT).cast("date")
    return stats.psi(b.ft.where(F.col("date") < cut), b.ft.where(F.col("date") >= cut), "sent_mean").select(r6("psi").alias("psi"))


_ACC = "acc AS (SELECT model, date, count(*) AS n, avg(CASE WHEN pred_up = realized_up THEN 1.0 ELSE 0.0 END) AS accuracy, avg(realized_up) AS up_rate, avg(prob_up) AS mean_prob FROM pr WHERE realized_up IS NOT NULL GROUP BY 1, 2)"


@query("g19_daily_accuracy", f"WITH {_ACC} SELECT model, {D('date')} AS date, n, {R('accuracy')} AS accuracy, {R('up_rate')} AS up_rate, {R('mean_prob')} AS mean_prob FROM acc")
def _(b: Base) -> DataFrame:
    from quillpanel.operators import monitor as MO

    return MO.daily_accuracy(b.pr).select("model", day("date").alias("date"), "n", *[r6(c).alias(c) for c in ("accuracy", "up_rate", "mean_prob")])


@query("g20_metrics_pivot", f"""
WITH m AS (SELECT model, CAST(dayofmonth(date) % 2 AS INT) AS lag, avg(CASE WHEN pred_up = realized_up THEN 1.0 ELSE 0.0 END) AS accuracy, avg(prob_up) AS roc_auc FROM pr WHERE realized_up IS NOT NULL GROUP BY 1, 2)
SELECT a.model, {R('a.accuracy')} AS accuracy_lag0, {R('a.roc_auc')} AS roc_auc_lag0, {R('b.accuracy')} AS accuracy_lag1, {R('b.roc_auc')} AS roc_auc_lag1, {R('a.accuracy - b.accuracy')} AS accuracy_inflation, {R('a.roc_auc - b.roc_auc')} AS roc_auc_inflation
FROM m a JOIN m b ON a.model = b.model AND a.lag = 0 AND b.lag = 1""")
def _(b: Base) -> DataFrame:
    from quillpanel.operators import experiments as EX

    done = b.pr.where("realized_up is not null")
    results = done.groupBy("model", (F.dayofmonth("date") % 2).alias("extra_lag")).agg(F.avg((F.col("pred_up") == F.col("realized_up")).cast("double")).alias("accuracy"), F.avg("prob_up").alias("roc_auc"))
    out = EX.lag_pivot(results)
    return out.select("model", *[r6(c).alias(c) for c in out.columns if c != "model"])


@query("g21_coverage_pivot", "WITH m AS (SELECT DISTINCT strftime(trade_date, '%Y-%m') AS month FROM hl WHERE trade_date IS NOT NULL), t AS (SELECT DISTINCT ticker FROM hl) SELECT t.ticker, m.month, count(h.headline_uid) AS n FROM t CROSS JOIN m LEFT JOIN hl h ON h.ticker IS NOT DISTINCT FROM t.ticker AND strftime(h.trade_date, '%Y-%m') = m.month GROUP BY 1, 2")
def _(b: Base) -> DataFrame:
    from quillpanel.plans import figures

    return figures.coverage(b.hl)


@query("g22_medians", f"SELECT {D('date')} AS date, {R('median(fwd_ret_1d)')} AS median FROM ft WHERE fwd_ret_1d IS NOT NULL GROUP BY ft.date")
def _(b: Base) -> DataFrame:
    return b.ft.where("fwd_ret_1d is not null").groupBy("date").agg(F.median("fwd_ret_1d").alias("m")).select(day("date").alias("date"), r6("m").alias("median"))


@query("g24_tail_sum", f"WITH {_ACC} SELECT model, CAST(sum(n) AS BIGINT) AS n_obs FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM acc) WHERE k <= 60 GROUP BY 1")
def _(b: Base) -> DataFrame:
    from quillpanel.operators import monitor as MO

    return MO.daily_accuracy(b.pr).join(MO.last_dates(b.pr), ["model", "date"], "left_semi").groupBy("model").agg(F.sum("n").alias("n_obs"))


@query("g25_well_covered", "WITH c AS (SELECT ticker, count(*) AS n, count(DISTINCT date_trunc('month', trade_date)) AS m FROM hl GROUP BY 1) SELECT ticker, n AS n_headlines, m AS n_months FROM c WHERE n >= 100 AND m >= 0.2 * (SELECT count(DISTINCT date_trunc('month', trade_date)) FROM hl)")
def _(b: Base) -> DataFrame:
    return AN.well_covered(b.hl, 0.2, 100).select("ticker", "n_headlines", "n_months")
