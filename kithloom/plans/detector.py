"""The detector: from two memberships to ranked communities, in one go or from kept features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from kithloom.operators import meta
from kithloom.operators.codes import coded
from kithloom.operators.features import topological_features
from kithloom.operators.linkpred import LinkPredictor, fit_links
from kithloom.operators.membership import bipartite
from kithloom.operators.sampling import negative_codes, positive_sample
from kithloom.session import keep
from kithloom.sources import readers, writers


@dataclass(frozen=True)
class Detection:
    """All that a detection yields; ``ranking`` is in long form."""

    predictor: LinkPredictor
    probabilities: DataFrame
    meta_features: DataFrame
    ranking: DataFrame


def labelled_features(m: DataFrame, max_edges: int | None = None, negatives: bool = True, seed: int = 0) -> DataFrame:
    """Features of the links, and of as many non-links (stages 3 and 4)."""
    codes = coded(m)

    def sample() -> DataFrame:
        links = positive_sample(codes.links) if max_edges is None else keep(codes.encode(positive_sample(m, max_edges, seed)), "sample")
        return links.unionByName(negative_codes(codes, links.count(), seed)) if negatives else links

    return codes.decode(topological_features(codes.links, sample))


def detect_from_features(train: DataFrame, test: DataFrame, classifier: Estimator | None = None, validation: float = 0.2, threshold: float = 0.5, seed: int = 0) -> Detection:
    """Stages 5 to 8: fit, probabilities, meta-features, ranking."""
    predictor = fit_links(train, classifier, validation, threshold, seed)
    probs = predictor.predict(test)
    scores = meta.meta_features(probs, threshold)
    return Detection(predictor, probs, scores, meta.rank_features(scores))


def detect(
    train_members: DataFrame, test_members: DataFrame, classifier: Estimator | None = None, max_edges: int | None = None, validation: float = 0.2, threshold: float = 0.5,
    seed: int = 0, save_to: str | None = None,
) -> Detection:
    """The whole way from (community, vertex) of train and test communities (M6); features are kept under ``save_to`` if given."""
    train = labelled_features(keep(bipartite(train_members), "train"), max_edges, True, seed)
    test = labelled_features(keep(bipartite(test_members), "test"), max_edges, False, seed)
    if save_to is not None:
        writers.write_features(train, test, save_to)
        train, test = readers.read_features(train.sparkSession, save_to)
    else:
        train, test = keep(train, "features"), keep(test, "features")
    return detect_from_features(train, test, classifier, validation, threshold, seed)
