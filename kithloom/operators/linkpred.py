"""Link prediction with Spark ML: any classifier with probabilities, gradient-boosted trees unless another is given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from kithloom.operators.evaluation import classification_scores
from kithloom.operators.features import FEATURES
from kithloom.operators.meta import predicted_label
from kithloom.operators.sampling import holdout


def default_classifier(seed: int = 0) -> Estimator:
    """A fresh estimator for each call, never shared (Q4)."""
    return GBTClassifier(featuresCol="features", labelCol="edge_exist", maxIter=20, maxDepth=4, seed=seed)


@dataclass
class LinkPredictor:
    """A fitted model, with the scores of its validation (None where nothing was held out)."""

    model: PipelineModel
    validation: DataFrame | None
    threshold: float = 0.5

    def predict(self, features: DataFrame) -> DataFrame:
        """(community, vertex, prob, predicted, and edge_exist where given) of each link (M4)."""
        prob = vector_to_array("probability")[1]
        kept = [c for c in ("community", "vertex", "edge_exist") if c in features.columns]
        scored = self.model.transform(features).select(*kept, prob.alias("prob"))
        return scored.withColumn("predicted", predicted_label(F.col("prob"), self.threshold))


def fit_links(features: DataFrame, classifier: Estimator | None = None, validation: float = 0.2, threshold: float = 0.5, seed: int = 0) -> LinkPredictor:
    """Validates on a hash-based part of the links, then fits on all of them."""
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), classifier or default_classifier(seed)])
    scores = None
    if validation > 0:
        train, held = holdout(features, ["community", "vertex", "edge_exist"], validation, seed)
        trial = LinkPredictor(pipeline.fit(train), None, threshold)
        scores = classification_scores(trial.predict(held), "edge_exist", "predicted")
    return LinkPredictor(pipeline.fit(features), scores, threshold)
