"""Random Fourier features (Rahimi & Recht, 2007) as a persistable pipeline stage.

MLlib has no kernel SVM.  An RBF kernel ``exp(-γ‖x−y‖²)`` is approximated by
``z(x) = sqrt(2/D)·cos(Wx + b)`` with ``W ~ N(0, 2γ)`` and ``b ~ U(0, 2π)``;
a linear SVM / robust regression on z approximates the kernel machine.  W
and b are regenerated from the seed, so only the parameters are stored.
The map runs as an Arrow-batched pandas UDF (one matrix product per batch).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rff_weights(dim_in: int, dim_out: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(dim_in, dim_out))
    b = rng.uniform(0.0, 2.0 * np.pi, size=dim_out)
    return w, b


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable,
                            DefaultParamsWritable):
    numFeatures = Param(Params._dummy(), "numFeatures", "output dimension D", TypeConverters.toInt)
    inputDim = Param(Params._dummy(), "inputDim", "input dimension d", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", numFeatures=256, inputDim=1, gamma=1.0, seed=42):
        super().__init__()
        self._setDefault(numFeatures=256, inputDim=1, gamma=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        d, D = self.getOrDefault(self.inputDim), self.getOrDefault(self.numFeatures)
        w, b = rff_weights(d, D, self.getOrDefault(self.gamma), self.getOrDefault(self.seed))
        scale = np.sqrt(2.0 / D)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(xs: pd.Series) -> pd.Series:
            x = np.vstack(xs.to_numpy()) if len(xs) else np.zeros((0, d))
            z = scale * np.cos(x @ w + b)
            return pd.Series(list(z))

        arr = vector_to_array(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(rff(arr)))


class KernelRegression(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A linear model over random Fourier features as one stage: the features are made and weighed in one Arrow batch."""

    inputDim = Param(Params._dummy(), "inputDim", "input dimension d", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "weights of the random features", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="prediction", inputDim=1, gamma=1.0, weights=None, intercept=0.0, seed=42):
        super().__init__()
        self._setDefault(inputDim=1, gamma=1.0, intercept=0.0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        weights, intercept = np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.intercept)
        d = self.getOrDefault(self.inputDim)
        w, b = rff_weights(d, len(weights), self.getOrDefault(self.gamma), self.getOrDefault(self.seed))
        weights = np.sqrt(2.0 / len(weights)) * weights

        @F.pandas_udf(T.DoubleType())
        def predict(xs: pd.Series) -> pd.Series:
            x = np.vstack(xs.to_numpy()) if len(xs) else np.zeros((0, d))
            return pd.Series(np.cos(x @ w + b) @ weights + intercept)

        return dataset.withColumn(self.getOutputCol(), predict(vector_to_array(F.col(self.getInputCol()))))


class KernelClassification(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """The class of the largest of several linear models over random Fourier features, as one stage."""

    inputDim = Param(Params._dummy(), "inputDim", "input dimension d", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "weights of the random features, class after class", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "intercept of every class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="prediction", inputDim=1, gamma=1.0, weights=None, intercepts=None, seed=42):
        super().__init__()
        self._setDefault(inputDim=1, gamma=1.0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        intercepts, d = np.array(self.getOrDefault(self.intercepts)), self.getOrDefault(self.inputDim)
        weights = np.array(self.getOrDefault(self.weights)).reshape(len(intercepts), -1).T
        w, b = rff_weights(d, len(weights), self.getOrDefault(self.gamma), self.getOrDefault(self.seed))
        weights = np.sqrt(2.0 / len(weights)) * weights

        @F.pandas_udf(T.DoubleType())
        def predict(xs: pd.Series) -> pd.Series:
            x = np.vstack(xs.to_numpy()) if len(xs) else np.zeros((0, d))
            return pd.Series((np.cos(x @ w + b) @ weights + intercepts).argmax(axis=1).astype(float))

        return dataset.withColumn(self.getOutputCol(), predict(vector_to_array(F.col(self.getInputCol()))))
