"""Cross-fitted boosted trees on feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAMS = {"maxIter": 40, "stepSize": 0.08, "maxDepth": 5, "maxBins": 127, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5, "seed": 42}


def imputed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns as doubles; a null is 0, and house_delta's has its indicator among the features in house_eq."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


@dataclass
class FoldEnsemble:
    """Model k is fitted on the rows of other folds, so it scores fold k; rows of no fold get the mean of all."""

    features: Sequence[str]
    params: dict = field(default_factory=lambda: dict(PARAMS))
    models: list = field(default_factory=list)

    def fit(self, df: DataFrame, *, label: str = "y", fold: str = "fold", n_folds: int = 2) -> FoldEnsemble:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"missing features: {missing}")
        rows = VectorAssembler(inputCols=list(self.features), outputCol="features").transform(imputed(df, self.features)).select(F.col(label).cast("double").alias("label"), fold, "features").persist()
        self.models = [GBTClassifier(**self.params).fit(rows.filter(F.col(fold) != k)) for k in range(n_folds)]
        rows.unpersist()
        return self

    def predict(self, df: DataFrame, out: str, *, fold: str | None = None) -> DataFrame:
        """df with a probability: of the fold's own model, or the mean."""
        names = df.columns
        rows = df.withColumn("row_", F.struct(*names))
        rows = VectorAssembler(inputCols=list(self.features), outputCol="features").transform(imputed(rows, self.features))
        for k, m in enumerate(self.models):
            m = m.copy().setPredictionCol(f"c{k}_").setRawPredictionCol(f"r{k}_").setProbabilityCol(f"v{k}_")
            rows = m.transform(rows).withColumn(f"p{k}_", vector_to_array(f"v{k}_")[1])
        if fold:
            p = F.lit(None).cast("double")
            for k in range(len(self.models)):
                p = F.when(F.col(f"row_.{fold}") == k, F.col(f"p{k}_")).otherwise(p)
        else:
            p = sum((F.col(f"p{k}_") for k in range(len(self.models))), F.lit(0.0)) / len(self.models)
        return rows.select("row_.*", p.alias(out))

    def importance(self, top: int = 20) -> list[tuple[str, float]]:
        gains = [sum(float(m.featureImportances[k]) for m in self.models) / len(self.models) for k in range(len(self.features))]
        return sorted(zip(self.features, gains, strict=True), key=lambda x: (-x[1], x[0]))[:top]

    def save(self, path: str) -> None:
        PipelineModel(stages=self.models).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, features: Sequence[str]) -> FoldEnsemble:
        models = [m for m in PipelineModel.load(path).stages if isinstance(m, GBTClassificationModel)]
        return cls(features, models=models)
