"""Classifiers, baselines, ablation and the ranking models."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.functions.numbers import at_least, ratio, squash
from quillpanel.functions.stats import rank_sums
from quillpanel.operators import boosting, newton
from quillpanel.operators import cross_section as XS
from quillpanel.runtime import release, slots, write_table
from quillpanel.sources.schema import FEATURES, PRICE_FEATURES, SENTIMENT_FEATURES

BLOCKS = {"sentiment_only": SENTIMENT_FEATURES, "price_only": PRICE_FEATURES, "combined": FEATURES}
#: Inverse regularisation strengths tried.
C_GRID = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: Blends of the fitted ranking with the prior.
BLENDS = (0.0, 0.25, 0.5, 0.75, 1.0)


def split(df: DataFrame, cut: str = SETTINGS.test_start) -> tuple[DataFrame, DataFrame]:
    """Rows before ``cut`` and from it on; either empty is an error."""
    at = F.lit(cut).cast("date")
    train, test = df.where(F.col("date") < at), df.where(F.col("date") >= at)
    n = df.agg(F.count(F.when(F.col("date") < at, 1)).alias("train"), F.count(F.when(F.col("date") >= at, 1)).alias("test")).first()
    if not n["train"] or not n["test"]:
        raise ValueError(f"nothing to {'train' if not n['train'] else 'test'} on at {cut}")
    return train, test


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column, fitted on one frame."""

    mean: Mapping[str, float]
    std: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        return cls({c: r[f"m_{c}"] or 0.0 for c in columns}, {c: r[f"s_{c}"] or 1.0 for c in columns})

    def column(self, c: str) -> Column:
        return (F.col(c) - self.mean[c]) / self.std[c]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.mean})


def balanced_weight(df: DataFrame, target: str) -> DataFrame:
    """``df`` with ``_weight`` = n / (2 * size of the row's class)."""
    sizes = df.agg(F.struct(F.count("*").alias("n"), F.count(F.when(F.col(target) == 1, 1)).alias("n1"))).scalar()
    own = F.when(F.col(target) == 1, F.col("_sizes.n1")).otherwise(F.col("_sizes.n") - F.col("_sizes.n1"))
    return df.withColumn("_sizes", sizes).withColumn("_weight", ratio(F.col("_sizes.n"), 2 * own)).drop("_sizes")


@dataclass(frozen=True)
class Linear:
    """A fitted logistic regression as an expression over raw columns: no assembler, no Python on the way."""

    scaler: Scaler
    coefficients: Mapping[str, float]
    intercept: float

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for c, w in self.coefficients.items():
            z = z + w * self.scaler.column(c)
        return squash(z, 1.0)


def logistic(train: DataFrame, columns: Sequence[str], target: str = "target_next_up", c: float = 0.1, balanced: bool = True, max_iter: int = 2000) -> Linear:
    """L2 logistic regression on scaled columns: minimises |w|^2 / 2 + c * loss."""
    return logistics(train, columns, target, (c,), balanced, max_iter)[0]


def logistics(train: DataFrame, columns: Sequence[str], target: str, grid: Sequence[float], balanced: bool = True, max_iter: int = 2000) -> list[Linear]:
    """``logistic`` at each strength of ``grid``."""
    scaler = Scaler.fit(train, columns)
    rows = _plain(train, columns, target, F.lit(0.0))
    try:
        return _linear(newton.fitted(rows, [_part(scaler, columns, 1.0)], grid, balanced, max_iter), [scaler], columns)[0]
    finally:
        rows.unpersist()


def logistic_blocks(train: DataFrame, blocks: Sequence[Sequence[str]], strengths: Sequence[float], target: str = "target_next_up") -> list[Linear]:
    """``logistic`` of each block at its strength; all share the passes."""
    every, grid = list(dict.fromkeys(c for columns in blocks for c in columns)), sorted(set(strengths))
    whole = Scaler.fit(train, every)
    scalers = [Scaler({c: whole.mean[c] for c in columns}, {c: whole.std[c] for c in columns}) for columns in blocks]
    rows = _plain(train, every, target, F.lit(0.0))
    try:
        found = newton.fitted(rows, [_part(s, columns, 1.0, every) for s, columns in zip(scalers, blocks)], grid, True, 2000)
    finally:
        rows.unpersist()
    return [_linear([each], [s], columns)[0][grid.index(c)] for each, s, columns, c in zip(found, scalers, blocks, strengths)]


def _plain(df: DataFrame, columns: Sequence[str], target: str, at: Column) -> DataFrame:
    """The columns, target and place as doubles, stored in as many partitions as there are tasks at a time."""
    each = [F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)]
    return df.select(*each, F.col(target).cast("double").alias("_y"), at.cast("double").alias("_at")).coalesce(slots(df.sparkSession)).persist()


def _part(scaler: Scaler, columns: Sequence[str], upto: float, of: Sequence[str] | None = None) -> newton.Part:
    """The part over ``columns`` of rows that hold the columns ``of``."""
    return newton.Part(tuple(map((of or columns).index, columns)), tuple(scaler.mean[c] for c in columns), tuple(scaler.std[c] for c in columns), upto)


def _linear(found: list[list[tuple]], scalers: Sequence[Scaler], columns: Sequence[str]) -> list[list[Linear]]:
    return [[Linear(scaler, dict(zip(columns, map(float, w))), b) for w, b in each] for scaler, each in zip(scalers, found)]


def boosted(train: DataFrame, columns: Sequence[str], target: str = "target_next_up", rounds: int = 200, depth: int = 3, step: float = 0.03, held: float = 0.15, seed: int = SETTINGS.random_state):
    """Gradient-boosted trees and their number: of ``rounds``, as many as have the least loss on a held-out share of the training rows.

    Stands for a histogram booster with early stopping: like in design, not equal in numbers.
    """
    assemble = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip")
    rows = train.dropna(subset=[*columns, target]).withColumns({"_y": F.col(target).cast("double"), "_held": F.rand(seed) < held})
    trees, staged = boosting.grow(rows, columns, "_y", "_held", rounds, depth, step)
    best = 1 + min(range(len(staged)), key=staged.__getitem__) if staged and not math.isnan(staged[0]) else rounds
    return PipelineModel([assemble, boosting.classifier(trees[:best], len(columns), step, featuresCol="_x", labelCol="_y", maxDepth=depth, maxIter=rounds, seed=seed, maxBins=64)]), best


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """``model`` with its first ``n`` trees and their weights only."""
    whole, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees, weights = whole.trees(), whole.treeWeights()
    if n >= len(trees):
        return model
    kept, kept_weights = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    for k in range(n):
        kept[k], kept_weights[k] = trees[k], float(weights[k])
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid(), kept, kept_weights, whole.numFeatures(), whole.numClasses())
    out = GBTClassificationModel(cut)
    out._resetUid(model.uid)
    return model._copyValues(out)


def boosted_probability(model: PipelineModel, df: DataFrame, out: str = "prob_up") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def placed(df: DataFrame) -> DataFrame:
    """``df`` with ``_at``, the row's position from 0 on in (date, ticker) order.

    Positions come from counts per day, a prefix sum over the days and a rank
    within the day.
    """
    per_day = df.groupBy("date").agg(F.count("*").alias("_c"))
    before = per_day.select("date", (F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("date")) - F.col("_c")).alias("_before"))  # one row a day
    return df.join(F.broadcast(before), "date").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("date").orderBy("ticker")) - 1).drop("_before")


def fold_bounds(total: int, n: int) -> list[tuple[int, int]]:
    """Where the test part of each fold begins and ends; its training part is all before."""
    size = total // (n + 1)
    return [(total - (n - k) * size, total - (n - k - 1) * size) for k in range(n)]


def folds(df: DataFrame, n: int = 4) -> list[tuple[DataFrame, DataFrame]]:
    """Forward-chaining folds by row position in (date, ticker) order: each test part follows its training part.

    A fold may cut inside a day.
    """
    rows = placed(df)
    return [(rows.where(F.col("_at") < lo).drop("_at"), rows.where((F.col("_at") >= lo) & (F.col("_at") < hi)).drop("_at")) for lo, hi in fold_bounds(df.count(), n)]


def auc(df: DataFrame, target: str, prob: str) -> DataFrame:
    """``(auc)`` by average ranks; null with a single class."""
    rows = df.where(F.col(prob).isNotNull() & F.col(target).isNotNull()).select(F.lit(0).alias("_all"), F.col(prob).alias("_p"), F.col(target).alias("_y"))
    s = rank_sums(rows, "_all", "_p", F.col("_y") == 1).agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))  # a row, without rows too
    return s.select(ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def tunings(train: DataFrame, blocks: Sequence[Sequence[str]], target: str = "target_next_up", grid: Sequence[float] = C_GRID, n: int = 4) -> DataFrame:
    """``(block, c, auc)`` by the place of a block: the mean AUC of each strength over the folds, 0.5 where a fold has one class.

    The folds of all blocks share the passes and the ranks.
    """
    every = list(dict.fromkeys(c for columns in blocks for c in columns))
    rows = _plain(placed(train), every, target, F.col("_at"))
    try:
        bounds = fold_bounds(rows.count(), n)
        scalers = [Scaler(dict(zip(every, map(float, m))), {c: float(v) or 1.0 for c, v in zip(every, d)}) for m, d in zip(*newton.moments(rows, [lo for lo, _ in bounds]))]
        folds_ = [(columns, s, lo, hi) for columns in blocks for s, (lo, hi) in zip(scalers, bounds)]
        found = newton.fitted(rows, [_part(s, columns, float(lo), every) for columns, s, lo, _ in folds_], grid, True, 2000)
        tests = [(_part(s, columns, float(hi), every), float(lo), models) for (columns, s, lo, hi), models in zip(folds_, found)]
        s = rank_sums(newton.scored(rows, tests), "_by", "_p", F.col("_y") == 1)  # reads the rows here
    finally:
        rows.unpersist()
    got = s.select("_by", ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))
    ways = [(k, float(c)) for k in range(len(blocks)) for _ in range(n) for c in grid]
    each = train.sparkSession.createDataFrame([(i, *way) for i, way in enumerate(ways)], "_by int, block int, c double")  # a row per block, fold and strength
    return each.join(got, "_by", "left").groupBy("block", "c").agg(F.avg(F.coalesce("auc", F.lit(0.5))).alias("auc"))


def tuning(train: DataFrame, columns: Sequence[str], target: str = "target_next_up", grid: Sequence[float] = C_GRID, n: int = 4) -> DataFrame:
    """``(c, auc)`` of one block: ``tunings``."""
    return tunings(train, [columns], target, grid, n).drop("block")


def tuned_c(train: DataFrame, columns: Sequence[str], target: str = "target_next_up", grid: Sequence[float] = C_GRID, n: int = 4, means: Callable[[], Mapping[float, float]] | None = None) -> float:
    """The strength with the best mean AUC over the folds; the first of equals. ``means`` gives what ``tuning`` gives, where it is known."""
    mean = means() if means else {r["c"]: r["auc"] for r in tuning(train, columns, target, grid, n).collect()}  # a row per strength
    return max(grid, key=lambda c: mean[float(c)])


def together(spark: SparkSession, jobs: Sequence[Callable]) -> list:
    """The results of ``jobs``, in order, run side by side: fits are many short Spark jobs that leave most cores idle."""
    with ThreadPool(max(1, min(4, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)


def evaluate(df: DataFrame, target: str = "target_next_up", pred: str = "pred_up", prob: str = "prob_up", forward: str = "fwd_ret_1d", by: str | None = None) -> DataFrame:
    """Classification and trading metrics, one row (per ``by``): a single aggregate plus the rank sum for the AUC.

    The five columns needed are stored once, so a model is not applied again for each pass.
    """
    key = F.lit(0) if by is None else F.col(by)
    rows = df.select(key.alias("_by"), F.col(target).alias("y"), F.col(pred).alias("p"), F.col(prob).alias("q"), F.col(forward).alias("f")).where("y is not null and p is not null and q is not null")
    rows = write_table(rows, "scored")
    sums = rank_sums(rows, "_by", "q", F.col("y") == 1).select("_by", F.col("r").alias("rank_sum"))
    n_if = lambda cond: F.count(F.when(cond, 1))
    y1, p1 = F.col("y") == 1, F.col("p") == 1
    pnl = (2 * F.col("p") - 1) * F.col("f")
    m = rows.groupBy("_by").agg(
        F.count("*").alias("n"), n_if(y1 & p1).alias("tp"), n_if(~y1 & ~p1).alias("tn"), n_if(y1).alias("pos"), n_if(p1).alias("pp"),
        F.avg(pnl).alias("mean_ret"), F.stddev_pop(pnl).alias("sd_ret"),
    ).join(sums, "_by")
    tpr, tnr = ratio(F.col("tp"), F.col("pos")), ratio(F.col("tn"), F.col("n") - F.col("pos"))
    return m.select(
        *([F.col("_by").alias(by)] if by else []), "n", ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        F.when(tpr.isNull() | tnr.isNull(), F.coalesce(tpr, tnr)).otherwise((tpr + tnr) / 2).alias("balanced_accuracy"),
        ratio(F.col("rank_sum") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("roc_auc"),
        F.coalesce(ratio(2 * F.col("tp"), F.col("pos") + F.col("pp")), F.lit(0.0)).alias("f1_up"), ratio(F.col("pp"), F.col("n")).alias("pred_up_rate"),
        (1e4 * F.col("mean_ret")).alias("mean_ret_bps"), F.coalesce(F.when(F.col("sd_ret") > 0, F.col("mean_ret") / F.col("sd_ret") * F.sqrt(F.lit(252.0))), F.lit(0.0)).alias("sharpe"),
    )


def baselines(train: DataFrame, test: DataFrame, target: str = "target_next_up") -> DataFrame:
    """Test rows once per baseline with ``model``, ``prob_up``, ``pred_up``: always up, moving-average cross, sign of sentiment."""
    base = train.agg(F.avg(target)).scalar()
    ways = {
        "baseline_always_up": (F.col("_base"), F.lit(1)),
        "baseline_ma_cross": (squash(F.col("ma_cross"), 10.0), (F.col("ma_cross") > 0).cast("int")),
        "baseline_sentiment_sign": (squash(F.col("sent_mean"), 2.0), (F.col("sent_mean") > 0).cast("int")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("prob_up"), y.alias("pred_up")) for m, (p, y) in ways.items()]))
    return test.withColumn("_base", base).select("*", each.alias("_m")).select(*test.columns, "_m.*")


def ablation(features: DataFrame, test_start: str = SETTINGS.test_start, c: float | None = None, rounds: int = 200, blocks: Mapping[str, Sequence[str]] = BLOCKS, kept: dict | None = None) -> DataFrame:
    """Metrics of both learners on each block of features and of the baselines, best balanced accuracy first.

    Without ``c`` the logistic strength is tuned on each block's training rows; column ``C`` has what was used.
    ``kept`` takes the fitted models by name.
    """
    train, test = split(features, test_start)
    train, test = train.persist(), test.persist()
    keep = ["ticker", "date", "target_next_up", "fwd_ret_1d", "model", "prob_up", "pred_up"]

    @cache
    def tuned() -> list[dict[float, float]]:
        rows = tunings(train, list(blocks.values())).collect()  # a row per block and strength
        return [{r["c"]: r["auc"] for r in rows if r["block"] == k} for k in range(len(blocks))]

    try:
        forests = [boosted(train, columns, rounds=rounds)[0] for columns in blocks.values()]  # one after the other: each takes all cores
        release(features.sparkSession)
        used = [tuned_c(train, columns, means=lambda k=k: tuned()[k]) if c is None else c for k, columns in enumerate(blocks.values())]
        fitted = logistic_blocks(train, list(blocks.values()), used)
        scored, strength = baselines(train, test).select(*keep), {}
        for name, of, fit, trees in zip(blocks, used, fitted, forests):
            strength[f"logreg__{name}"] = of
            if kept is not None:
                kept |= {f"logreg__{name}": fit, f"hgb__{name}": trees}
            scored = scored.unionByName(test.withColumns({"model": F.lit(f"logreg__{name}"), "prob_up": fit.probability()}).withColumn("pred_up", at_least(F.col("prob_up"))).select(*keep))
            scored = scored.unionByName(boosted_probability(trees, test).withColumns({"model": F.lit(f"hgb__{name}")}).withColumn("pred_up", at_least(F.col("prob_up"))).select(*keep))
        of_model = F.create_map(*[F.lit(x) for m, of in strength.items() for x in (m, float(of))])
        metrics = evaluate(scored, by="model")  # over a stored table
    finally:
        train.unpersist()
        test.unpersist()
    release(features.sparkSession)
    return metrics.withColumn("C", F.try_element_at(of_model, F.col("model"))).orderBy(F.desc("balanced_accuracy"), "model")


def champion(metrics: DataFrame, metric: str = "balanced_accuracy", like: str = "") -> DataFrame:
    """The model with the best metric among those whose name ends in ``like``; of equals the first by name."""
    return metrics.where(F.col("model").endswith(like)).orderBy(F.desc(metric), "model").limit(1)


def predictions(scored: DataFrame, model: str) -> DataFrame:
    """Rows of ``predictions`` from a scored test frame; the class is ``prob >= 0.5`` whatever the model's own rule."""
    return scored.select(F.lit(model).alias("model"), "ticker", "date", "prob_up", at_least(F.col("prob_up")).alias("pred_up"), F.lit(None).cast("double").alias("realized_ret"), F.lit(None).cast("int").alias("realized_up"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))


def blended(fit: Mapping[str, float], prior: Mapping[str, float], blend: float) -> dict[str, float]:
    """``blend`` of the fitted direction and the rest of the prior's, both of length 1; a zero vector stays."""
    columns = list(fit)

    def unit(w: Mapping[str, float]) -> dict[str, float]:
        size = math.sqrt(sum(w.get(c, 0.0) ** 2 for c in columns))
        return {c: w.get(c, 0.0) / size if size else 0.0 for c in columns}

    f, p = unit(fit), unit(prior)
    return {c: blend * f[c] + (1 - blend) * p[c] for c in columns}


def shrunk_score(df: DataFrame, scaler: Scaler, weights: Mapping[str, float], out: str = "score") -> DataFrame:
    """``df`` with the weighted sum of its scaled columns."""
    return df.withColumn(out, sum((F.lit(w) * scaler.column(c) for c, w in weights.items()), F.lit(0.0)))


def walk_forward_blend(panel: DataFrame, columns: Sequence[str], prior: Mapping[str, float] = SETTINGS.sign_prior, target: str = "target_rel", least_history: int = 500, grid: Sequence[float] = BLENDS, least_names: int = SETTINGS.min_names_per_day) -> float:
    """The blend with the best mean of yearly mean ICs, each year fitted on the years before it; the first of equals.

    A year needs enough history. The fit does not depend on the blend, so there
    is one per year; all years are fitted together.
    """
    sizes = {r["y"]: r["n"] for r in panel.groupBy(F.year("date").alias("y")).agg(F.count("*").alias("n")).collect()}  # one row a year
    years = [y for y in sorted(sizes)[1:] if sum(n for past, n in sizes.items() if past < y) >= least_history]
    if not years:
        return grid[0]
    rows = _plain(panel, columns, target, F.year("date"))
    try:
        scalers = [Scaler(dict(zip(columns, map(float, m))), {c: float(v) or 1.0 for c, v in zip(columns, d)}) for m, d in zip(*newton.moments(rows, [float(y) for y in years]))]
        fits = [f[0] for f in _linear(newton.fitted(rows, [_part(s, columns, float(y)) for s, y in zip(scalers, years)], (0.1,), False, 2000), scalers, columns)]
    finally:
        rows.unpersist()
    of_year = [(y, [f.scaler.mean[c] for c in columns], [f.scaler.std[c] for c in columns], [[blended(f.coefficients, prior, g)[c] for c in columns] for g in grid]) for y, f in zip(years, fits)]
    ways = panel.sparkSession.createDataFrame(of_year, "_year int, _mean array<double>, _std array<double>, _ways array<array<double>>")  # a row a year
    placed_ = panel.join(F.broadcast(ways), F.year("date") == F.col("_year"))
    each = F.array(*[
        F.struct(F.lit(g).alias("blend"), sum((F.col("_ways")[i][j] * ((F.col(c) - F.col("_mean")[j]) / F.col("_std")[j]) for j, c in enumerate(columns)), F.lit(0.0)).alias("score")) for i, g in enumerate(grid)
    ])
    scored = write_table(placed_.select("date", "fwd_ret_1d", F.explode(each).alias("_w")).select("date", "fwd_ret_1d", "_w.*"), "blends")
    ic = XS.daily_ic(scored, "score", least=least_names, by=["blend"])
    yearly = ic.groupBy("blend", F.year("date").alias("y")).agg(F.avg("ic").alias("ic")).groupBy("blend").agg(F.avg("ic").alias("ic")).collect()  # one row a blend
    got = {r["blend"]: r["ic"] for r in yearly}
    best = max((g for g in grid if got.get(g) is not None), key=lambda g: got[g], default=grid[0])
    return best


def cross_sectional_run(features: DataFrame, test_start: str = SETTINGS.test_start, least_names: int = SETTINGS.min_names_per_day, c: float = 0.1, rounds: int = 200, cost_bps: float = SETTINGS.cost_bps_per_side) -> DataFrame:
    """Seven rankings, each with accuracy, IC summary and net back-test: two learned, the prior, the shrunk one, sentiment alone.

    The target is made first, so the z-scores leave out a day's middle name.
    """
    signs = SETTINGS.sign_prior
    rows = XS.with_composite(XS.zscored(XS.with_relative_target(XS.panel(features.dropna(subset=["fwd_ret_1d"]), least_names)), FEATURES))
    columns = [*FEATURES, "sent_composite"]
    panel = write_table(XS.prior_score(rows), "cross_section")
    train, test = split(panel, test_start)
    trees, _ = boosted(train, columns, "target_rel", rounds=rounds)
    fit, blend = together(features.sparkSession, [lambda: logistic(train, columns, "target_rel", c, balanced=False), lambda: walk_forward_blend(train, columns, signs, least_names=least_names)])
    cuts = {"xs_logreg": 0.5, "xs_hgb": 0.5, "prior_composite": None, "shrunk_to_prior": None, "prior_composite_full": None, "rank_by_sentiment": 0.0, "rank_by_sentiment_full": 0.0}
    keep = ["date", "ticker", "target_rel", "fwd_ret_1d"]

    def of(df: DataFrame, **scores: Column) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.cast("double").alias("score")) for m, s in scores.items()]))
        return df.select(*keep, each.alias("_m")).select("_m.*", *keep)

    shrunk = shrunk_score(test, fit.scaler, blended(fit.coefficients, signs, blend), "_shrunk")
    release(features.sparkSession)
    scored = of(shrunk, xs_logreg=fit.probability(), prior_composite=F.col("prior"), shrunk_to_prior=F.col("_shrunk"), rank_by_sentiment=F.col("sent_mean"))
    scored = scored.unionByName(of(boosted_probability(trees, test, "_score"), xs_hgb=F.col("_score")))
    scored = scored.unionByName(of(panel, prior_composite_full=F.col("prior"), rank_by_sentiment_full=F.col("sent_mean")))
    return XS.compared(write_table(scored, "rankings"), cuts, least_names, cost_bps)


def save_bundle(spark: SparkSession, path: str, name: str, columns: Sequence[str], model: Linear | PipelineModel) -> None:
    """A model with its name and columns below ``path``, replacing what lies there."""
    head = {"model": name, "features": list(columns), "kind": "linear" if isinstance(model, Linear) else "pipeline"}
    if isinstance(model, Linear):
        head |= {"mean": dict(model.scaler.mean), "std": dict(model.scaler.std), "coefficients": dict(model.coefficients), "intercept": model.intercept}
    else:
        model.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load_bundle(spark: SparkSession, path: str) -> tuple[str, list[str], Linear | PipelineModel]:
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    if head["kind"] == "linear":
        return head["model"], head["features"], Linear(Scaler(head["mean"], head["std"]), head["coefficients"], head["intercept"])
    return head["model"], head["features"], PipelineModel.load(f"{path}/pipeline")


def predict_one(model: Linear | PipelineModel, values: Mapping[str, float], threshold: float = 0.5, columns: Sequence[str] | None = None) -> dict:
    """Probability and class of one request; columns it lacks count as 0 and are named. ``columns`` are those of a stored pipeline."""
    if isinstance(model, Linear):
        columns = list(model.coefficients)
        z = model.intercept + sum(w * ((values.get(c, 0.0) - model.scaler.mean[c]) / model.scaler.std[c]) for c, w in model.coefficients.items())
        p = 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
    else:
        spark = SparkSession.active()
        row = spark.range(1).select(*[F.lit(float(values.get(c, 0.0))).alias(c) for c in columns])
        p = boosted_probability(model, row).first()["prob_up"]
    return {"prob_up": p, "pred_up": int(p >= threshold), "missing_features": [c for c in columns if c not in values]}
