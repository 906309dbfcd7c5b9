"""Scorers: a contract for models over window features, with baselines from ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import reconstruction_error


class Scorer(Protocol):
    """Turns a table of windows into the same table with a column ``p``."""

    def score(self, windows: DataFrame) -> DataFrame: ...


class FeatureScorer:
    """A ``pyspark.ml`` classifier over numeric columns, standardised on the training rows."""

    def __init__(self, features: Sequence[str], hidden: Sequence[int] = (), max_iter: int = 50, seed: int = 42):
        self.features, self.hidden, self.max_iter, self.seed = list(features), tuple(hidden), max_iter, seed

    def fit(self, windows: DataFrame, label: str = "label") -> FeatureScorer:
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="__raw", handleInvalid="keep")
        raw = self.assembler.transform(windows.na.fill(0.0, self.features)).withColumn("__y", F.col(label).cast("double"))
        self.scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(raw)
        data = self.scaler.transform(raw)
        if self.hidden:
            model = MultilayerPerceptronClassifier(featuresCol="__x", labelCol="__y", layers=[len(self.features), *self.hidden, 2], maxIter=self.max_iter, seed=self.seed)
        else:
            model = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=self.max_iter)
        self.model = model.fit(data)
        return self

    def score(self, windows: DataFrame) -> DataFrame:
        x = self.scaler.transform(self.assembler.transform(windows.na.fill(0.0, self.features)))
        out = self.model.transform(x).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
        return out.select(*windows.columns, "p")


class LowRankScorer:
    """Reconstruction from the mean and ``rank`` principal directions of normal rows; their error is the score.

    Mean and Gram matrix are summed over the rows by tree aggregation; what reaches the driver is the matrix of a
    vector's length squared, whatever the number of rows.  Rank 0 rebuilds every row as the mean.  Fit on the rows
    of `splits.normal_sample`; rows without a vector of the right length get null.
    """

    def __init__(self, column: str, rank: int):
        self.column, self.rank = column, rank

    def fit(self, normal: DataFrame) -> LowRankScorer:
        rows = normal.where(F.col(self.column).isNotNull()).select(array_to_vector(F.col(self.column).cast("array<double>")).alias("x"))
        if rows.isEmpty():
            raise ValueError("no normal rows")
        self.mean = rows.select(Summarizer.mean(F.col("x")).alias("m")).first()["m"].toArray()
        self.directions = PCA(k=self.rank, inputCol="x", outputCol="y").fit(rows).pc.toArray().T if self.rank else np.zeros((0, len(self.mean)))
        return self

    def score(self, rows: DataFrame, rebuilt: str = "rebuilt", error: str = "error") -> DataFrame:
        """``rows`` with each vector's own reconstruction and the mean squared difference."""
        literal = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
        times = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        vector = F.when(F.size(self.column) == len(self.mean), F.col(self.column).cast("array<double>"))
        out = rows.withColumn("__off", F.zip_with(vector, literal(self.mean), lambda x, m: x - m))
        out = out.withColumn("__on", F.array(*(times(F.col("__off"), literal(d)) for d in self.directions)).cast("array<double>"))
        back = F.transform(literal(self.mean), lambda m, i: m + sum((F.get("__on", F.lit(j)) * F.get(literal(d), i) for j, d in enumerate(self.directions)), F.lit(0.0)))
        out = out.withColumn(rebuilt, F.when(vector.isNotNull(), back))
        return out.withColumn(error, reconstruction_error(F.col(self.column), F.col(rebuilt))).drop("__off", "__on")


class ArrayScorer:
    """Any vectorised function of stacked arrays [n, ...] to scores [n], run batch by batch over Arrow."""

    def __init__(self, column: str, predict: Callable[[np.ndarray], np.ndarray]):
        self.column, self.predict = column, predict

    def score(self, windows: DataFrame) -> DataFrame:
        column, predict = self.column, self.predict

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(p=np.asarray(predict(np.stack(f[column].to_numpy())), float) if len(f) else np.zeros(0))

        return windows.mapInPandas(run, T.StructType([*windows.schema.fields, T.StructField("p", T.DoubleType())]))
