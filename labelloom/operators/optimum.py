"""Whether a linear classifier reached the optimum of its penalized loss.

A solver is no oracle of itself, but a convex loss tells an optimum by sums over
the rows: the gradient vanishes there, and no other weights do better. All sums
are vector sums over the rows in one pass, so a check costs one scoring of the
training rows; what reaches the driver has the size of the model.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel, OneVsRestModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.session import fresh_path

# How Parquet keeps a vector: a dense one has its numbers in ``values``.
_VECTOR = T.StructType([T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()),
                        T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
# Weights scaled by the first and intercepts moved by the second number: each must do worse.
CHANGES = ((0.9, 0.0), (1.1, 0.0), (1.0, 0.1), (1.0, -0.1), (0.9, 0.1), (1.1, -0.1))


def _stored(scored: DataFrame, *plain: str) -> DataFrame:
    """What a model has made of the rows, written once; the vectors of ``plain`` are read back as structs."""
    path = fresh_path(scored.sparkSession, "scored")
    scored.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, _VECTOR) if f.name in plain else f for f in scored.schema])
    return scored.sparkSession.read.schema(schema).parquet(path)


def softmax_optimum(model: LogisticRegressionModel, data: DataFrame, reg: float) -> dict:
    """``gradient_norm``, ``objective`` and the least objective of changed weights, of a multinomial logistic regression.

    The objective is the mean log loss plus half ``reg`` times the squared
    weights. Its gradient in a class's weights is the mean of (probability less
    truth) times the features plus ``reg`` times the weights.
    """
    k = model.numClasses
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scored = _stored(model.transform(data).select("features", "label", "probability", "rawPrediction"), "probability", "rawPrediction")
    scored = scored.select("features", F.col("label").cast("int").alias("y"), F.col("probability.values").alias("p"),
                           F.col("rawPrediction.values").alias("m"))
    truth = [(F.col("y") == c).cast("double") for c in range(k)]
    total = Summarizer.metrics("sum")
    sums = scored.agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col("p")[c] - truth[c]) for c in range(k)]).alias("bias"),
        *[total.summary(F.col("features"), F.col("p")[c]).alias(f"p{c}") for c in range(k)],
        *[total.summary(F.col("features"), truth[c]).alias(f"y{c}") for c in range(k)],
        *[F.avg(_log_loss(scale, np.eye(k)[0] * shift, bias)).alias(f"loss{i}") for i, (scale, shift) in enumerate(((1.0, 0.0), *CHANGES))]).first()
    pulls = np.array([sums[f"p{c}"]["sum"].toArray() - sums[f"y{c}"]["sum"].toArray() for c in range(k)]) / sums["n"]
    gradient = np.concatenate([(pulls + reg * weights).ravel(), np.array(sums["bias"]) / sums["n"]])
    penalty = reg / 2 * float((weights ** 2).sum())
    losses = [sums[f"loss{i}"] + penalty * scale ** 2 for i, (scale, _) in enumerate(((1.0, 0.0), *CHANGES))]
    return {"gradient_norm": float(np.linalg.norm(gradient)), "objective": losses[0], "least_changed": min(losses[1:]), "n": sums["n"]}


def _log_loss(scale: float, shift: np.ndarray, bias: np.ndarray) -> Column:
    """Of a row, under scaled weights and moved intercepts: margins are weights times features plus intercept."""
    margins = F.array(*[(F.col("m")[c] - float(b)) * scale + float(b + shift[c]) for c, b in enumerate(bias)])
    most = F.array_max(margins)
    spread = F.aggregate(margins, F.lit(0.0), lambda held, x: held + F.exp(x - most))
    return F.log(spread) + most - F.get(margins, F.col("y"))


def hinge_optimum(model: OneVsRestModel, data: DataFrame, reg: float) -> list[dict]:
    """For each class against the rest: ``objective`` and the least objective of changed weights.

    The objective is the mean hinge loss plus half ``reg`` times the squared
    weights. It has kinks, so its gradient need not vanish at the optimum.
    """
    out, features = [], data.select("features", F.col("label").cast("int").alias("y"))
    for c, one in enumerate(model.models):
        weights, bias = one.coefficients.toArray(), float(one.intercept)
        side = F.when(F.col("y") == c, 1.0).otherwise(-1.0)
        rows = _stored(one.transform(features).select(side.alias("s"), "rawPrediction"), "rawPrediction")
        rows = rows.select("s", F.col("rawPrediction.values")[1].alias("m"))
        penalty = reg / 2 * float(weights @ weights)
        changed = ((1.0, 0.0), *CHANGES)
        losses = rows.agg(F.count("*").alias("n"), *[
            F.avg(F.greatest(F.lit(0.0), 1 - F.col("s") * ((F.col("m") - bias) * scale + bias + shift))).alias(f"loss{i}")
            for i, (scale, shift) in enumerate(changed)]).first()
        values = [losses[f"loss{i}"] + penalty * scale ** 2 for i, (scale, _) in enumerate(changed)]
        out.append({"class": c, "objective": values[0], "least_changed": min(values[1:]), "n": losses["n"]})
    return out
