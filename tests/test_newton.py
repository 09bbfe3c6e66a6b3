import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import models as M

from .test_boosting import jobs_of
from .test_panel import _day, _features

COLUMNS = ["sent_mean", "ret_1d", "volume_z"]


@pytest.fixture(scope="module")
def features(spark):
    return _features(spark).cache()


def test_the_slope_at_the_result_is_zero(features):
    for balanced in (True, False):
        for c, fit in zip((0.003, 1.0), M.logistics(features, COLUMNS, "target_next_up", (0.003, 1.0), balanced)):
            rows = features.dropna(subset=[*COLUMNS, "target_next_up"]).toPandas()
            z = np.column_stack([(rows[k] - fit.scaler.mean[k]) / fit.scaler.std[k] for k in COLUMNS] + [np.ones(len(rows))]).astype(float)
            y = rows["target_next_up"].to_numpy(float)
            w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else 1.0
            b = np.array([*fit.coefficients.values(), fit.intercept])
            slope = c * z.T @ (w * (1 / (1 + np.exp(-z @ b)) - y)) + np.append(b[:-1], 0)
            assert np.abs(slope).max() < 1e-7 * len(y)


def test_one_class_is_sure(features):
    for y, p in ((1, 1.0), (0, 0.0)):
        fit = M.logistic(features.withColumn("target_next_up", F.lit(y)), COLUMNS)
        assert math.isinf(fit.intercept) and features.select(fit.probability()).first()[0] == p


def test_rows_with_nulls_are_left_out_of_the_fit_not_of_the_scale(spark, features):
    holed = features.withColumn("ret_1d", F.when(F.col("date") != F.lit(str(_day(7))).cast("date"), F.col("ret_1d"))).cache()
    fit = M.logistic(holed, COLUMNS)
    assert fit.scaler == M.Scaler.fit(holed, COLUMNS)
    whole = M.newton.fitted(M._plain(holed.dropna(subset=COLUMNS), COLUMNS, "target_next_up", F.lit(0.0)), [M._part(fit.scaler, COLUMNS, 1.0)], (0.1,), True, 100)[0][0]
    assert list(fit.coefficients.values()) == pytest.approx(list(whole[0])) and fit.intercept == pytest.approx(whole[1])


def test_tuning_takes_a_few_jobs(spark, features):
    got, jobs = jobs_of(spark, lambda: M.tuning(features, COLUMNS, n=3).collect())
    assert {r["c"] for r in got} == set(M.C_GRID)
    assert jobs < 60  # a job an iteration, fold and strength before
