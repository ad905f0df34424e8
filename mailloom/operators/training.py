"""Training of a text classifier, grids of parameters, and the choice of the best model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailloom.functions import text as T

FEATURES = 1 << 14


def tokens(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.withColumn("tokens", T.alnum_tokens(F.coalesce(F.col(text_col), F.lit(""))))


def pipeline(rate: float = 0.01) -> tuple[Pipeline, LogisticRegression]:
    """Hashed, weighted words and a logistic regression of label_id."""
    last = LogisticRegression(labelCol="label_id", featuresCol="features", regParam=rate, maxIter=20)
    return Pipeline(stages=[HashingTF(numFeatures=FEATURES, inputCol="tokens", outputCol="counts"), IDF(inputCol="counts", outputCol="features"), last]), last


def train(rows: DataFrame, rate: float = 0.01) -> PipelineModel:
    """Fit rows of text and label_id (0 spam, 1 other)."""
    return pipeline(rate)[0].fit(tokens(rows))


def spam_scores(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with score, the probability of class 0."""
    found = fitted.transform(tokens(rows))
    return found.withColumn("score", vector_to_array("probability")[0]).drop("tokens", "counts", "features", "rawPrediction", "probability", "prediction")


def grid(rows: DataFrame, rates: list[float], mixes: list[float], seed: int = 1) -> tuple[PipelineModel, list[float]]:
    """The best model over a grid of penalties and their mixes, by a held-out quarter, and each one's measure."""
    steps, last = pipeline()
    params = ParamGridBuilder().addGrid(last.regParam, rates).addGrid(last.elasticNetParam, mixes).build()
    split = TrainValidationSplit(estimator=steps, estimatorParamMaps=params, evaluator=BinaryClassificationEvaluator(labelCol="label_id"), trainRatio=0.75, seed=seed)
    found = split.fit(tokens(rows))
    return found.bestModel, list(found.validationMetrics)


def saved(runs: DataFrame, slack: float = 1e-4, run: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """The rows with save: whether an epoch's loss is lower, by more than slack, than the best of the run that was noted before; the first
    epoch is noted and not saved, and a loss that isn't so much lower isn't noted."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(loss).alias("l"))).over(W.partitionBy(run)))
    before = F.filter(ordered, lambda x: x["e"] < F.col(epoch))
    start = F.lit(None).cast("double")
    best = F.aggregate(before, start, lambda acc, x: F.when(acc.isNull() | (x["l"] < acc - slack), x["l"]).otherwise(acc))
    return runs.withColumn("save", F.coalesce(F.col(loss) < best - slack, F.lit(False)))
