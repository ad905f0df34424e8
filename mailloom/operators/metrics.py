"""Metrics of a classifier with unequal costs, histograms and statistics of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spam_metrics(scores: DataFrame, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """One row over score (0 to 1, 1 for spam) and label_id (0 spam, 1 other): counts by class, those surely right and surely wrong
    (beyond the limits, which count for neither), mean scores, and cost: the share of spam not surely found, and three times the
    shares of each class that are surely wrong (null if a class is empty).  Rows with a null are left out."""
    x, spam, other = F.col("score"), F.col("label_id") == 0, F.col("label_id") == 1
    n = scores.where("score is not null and label_id in (0, 1)").agg(
        F.count_if(spam).alias("spam_n"),
        F.count_if(other).alias("ham_n"),
        F.count_if(spam & (x > high)).alias("spam_ok"),
        F.count_if(spam & (x < low)).alias("spam_missed"),
        F.count_if(other & (x < low)).alias("ham_ok"),
        F.count_if(other & (x > high)).alias("ham_wrong"),
        F.round(F.avg(F.when(spam, x)), 6).alias("spam_mean"),
        F.round(F.avg(F.when(other, x)), 6).alias("ham_mean"),
    )
    part = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return n.withColumn("cost", F.round(1 - part("spam_ok", "spam_n") + 3 * part("spam_missed", "spam_n") + 3 * part("ham_wrong", "ham_n"), 6))


def accuracy_loss(scores: DataFrame) -> DataFrame:
    """One row over p0 (probability of class 0) and label_id: n, accuracy of the likelier class (the first of equal ones), mean log loss."""
    p = F.greatest(F.least(F.col("p0"), F.lit(1 - 1e-12)), F.lit(1e-12))
    guess = F.when(F.col("p0") >= 0.5, 0).otherwise(1)
    loss = -F.log(F.when(F.col("label_id") == 0, p).otherwise(1 - p))
    return scores.agg(F.count("*").alias("n"), F.round(F.avg((guess == F.col("label_id")).cast("double")), 6).alias("accuracy"), F.round(F.avg(loss), 6).alias("loss"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int = 128) -> DataFrame:
    """bin (from 0) and n of the values from low to high (exclusive); empty bins have no row."""
    at = F.floor((value - low) * bins / (high - low)).cast("int")
    return rows.select(at.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"))


def weight_stats(rows: DataFrame, vec: Column) -> DataFrame:
    """One row over vectors: values, their deviation, the share within a tenth of it around 0, and vectors without a value of 0.1."""
    values = rows.select(F.explode(vec).alias("x")).select(F.col("x").cast("double").alias("x"))
    deviation = values.agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd"))
    near = values.crossJoin(F.broadcast(deviation)).agg(F.first("n").alias("n"), F.round(F.first("sd"), 6).alias("sd"), F.round(F.avg((F.abs("x") < 0.1 * F.col("sd")).cast("double")), 6).alias("near_zero"))
    dead = rows.agg(F.count_if(F.array_max(vec) < 0.1).alias("dead"))
    return near.crossJoin(F.broadcast(dead))
