"""A ranker learned from preference pairs: logistic regression on the difference of two candidates' rule amounts.

Without an intercept that is the pairwise logistic loss, so the weights score single candidates. Training and
scoring are Spark jobs; the model is one weight for each rule.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import share
from .scoring import featured, rules


def candidate_features(pool: DataFrame, items: DataFrame) -> DataFrame:
    """(pool_id, features): the amount that every rule adds."""
    amounts = F.array(*[F.when(r.applies, r.amount).otherwise(0.0).cast("double") for r in rules()])
    return featured(pool, items).select("pool_id", amounts.alias("features"))


def pair_differences(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs with ``difference``, the right candidate's features less the wrong one's."""
    right = features.select(F.col("pool_id").alias("positive"), F.col("features").alias("fp"))
    wrong = features.select(F.col("pool_id").alias("negative"), F.col("features").alias("fn"))
    return pairs.join(right, "positive").join(wrong, "negative").withColumn("difference", F.zip_with("fp", "fn", lambda a, b: a - b)).drop("fp", "fn")


def train(differences: DataFrame, regularisation: float = 0.01, rounds: int = 50) -> list[float]:
    """A weight for every rule. Each pair is shown both ways round, so that both classes are there."""
    both = differences.select(F.col("difference").alias("d"), F.lit(1.0).alias("label")).union(
        differences.select(F.transform("difference", lambda x: -x), F.lit(0.0)))
    data = both.select(array_to_vector("d").alias("features"), "label")
    if data.isEmpty():
        return [0.0] * len(rules())
    model = LogisticRegression(fitIntercept=False, regParam=regularisation, maxIter=rounds, standardization=False).fit(data)
    return [float(w) for w in model.coefficients]


def weighted(features: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def pair_accuracy(differences: DataFrame, weights: list[float]) -> DataFrame:
    """Per kind of wrong candidate: pairs, share ranked right, mean margin."""
    margin = weighted(F.col("difference"), weights)
    return differences.withColumn("margin", margin).groupBy("kind").agg(
        F.count("*").alias("pairs"), share(F.col("margin") > 0).alias("accuracy"), F.round(F.avg("margin"), 4).alias("mean_margin"))
