import math

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillpanel.operators import boosting as B
from quillpanel.operators import models as M

COLUMNS = ["a", "b", "c", "same"]


def jobs_of(spark, run):
    """What ``run`` gives and the number of Spark jobs it takes."""
    group = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def rows(spark):
    u = lambda seed: F.xxhash64("id", F.lit(seed)) / float(2**63)
    df = spark.range(900).select("id", u(1).alias("a"), F.round(u(2), 1).alias("b"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(u(3)).alias("c"), F.lit(1.0).alias("same"))
    up = F.col("a") + F.col("b") * F.col("c") + u(4) / 2 > 0.1
    return df.withColumns({"y": up.cast("int"), "held": F.col("id") % 6 == 0}).cache()


@pytest.mark.parametrize("per_task", [10_000, 200])
def test_trees_are_those_of_spark(rows, per_task):
    trees, losses = B.grow(rows, COLUMNS, "y", "held", 8, 3, 0.3, rows_per_task=per_task)
    x = VectorAssembler(inputCols=COLUMNS, outputCol="_x").transform(rows).withColumn("_y", F.col("y").cast("double")).cache()
    want = GBTClassifier(featuresCol="_x", labelCol="_y", maxDepth=3, maxIter=8, stepSize=0.3, maxBins=64).fit(x.where(~F.col("held")))
    got = B.classifier(trees, len(COLUMNS), 0.3, featuresCol="_x")
    score = lambda m: {r["id"]: r["probability"][1] for r in m.transform(x).collect()}
    assert score(got) == pytest.approx(score(want), abs=1e-12)
    assert losses == pytest.approx(want.evaluateEachIteration(x.where("held")))


def test_bins_count_every_row(spark):
    big = spark.range(100_000).select((F.pmod(F.xxhash64("id"), F.lit(100_000)) + 0.0).alias("a"), (F.col("id") % 2).alias("y"), F.lit(False).alias("held"))
    rows = big.select(F.col("a").alias("_0"), F.col("y").cast("double").alias("_y"), F.col("held").alias("_held")).repartition(4)
    exact, small = B._splits(rows, 1, 64, 100_000)[0], B._splits(rows, 1, 64, 512)[0]
    assert len(exact) == len(small) == 63
    n = rows.select(*[F.sum((F.col("_0") <= float(t)).cast("int")) for t in small]).first()
    assert all(abs(k - (i + 1) * 100_000 / 64) < 300 for i, k in enumerate(n))


def test_all_rounds_take_one_job(spark, rows):
    (model, best), jobs = jobs_of(spark, lambda: M.boosted(rows, COLUMNS, "y", rounds=40))
    assert 1 <= best <= 40 and model.stages[-1].getNumTrees == best
    assert jobs < 20  # a job a level and round before


def test_one_class_and_nulls(spark, rows):
    one = rows.withColumn("y", F.lit(1)).withColumn("a", F.when(F.col("id") != 5, F.col("a")))
    model, _ = M.boosted(one, COLUMNS, "y", rounds=3)
    scored = M.boosted_probability(model, one).agg(F.count("*"), F.min("prob_up")).first()
    assert scored[0] == 899 and scored[1] > 0.8 and not math.isnan(scored[1])
    with pytest.raises(ValueError, match="nothing to train on"):
        M.boosted(one.where("id < 0"), COLUMNS, "y", rounds=3)
