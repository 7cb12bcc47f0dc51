"""The label classifier: class weights, grid search over stratified folds, prediction.

The whole classifier is one pipeline of two estimators, the vectoriser and the regression, so a saved pipeline is
all that predicting needs. The search takes the two apart, so that a fold's rows become vectors once for all settings.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.operators.cleaning import label_counts
from faultline.operators.evaluation import pair_counts, weighted_f1
from faultline.operators.features import Tfidf, TfidfModel
from faultline.operators.split import folds
from faultline.session import materialise, scratch


# Settings of one fold that are fitted side by side, at most; each is a chain of small jobs.
PARALLEL_FITS = 6
# Bytes of cached vectors to those of the written ones, at most.
CACHED_TO_WRITTEN = 3
UNWEIGHTED = "none"


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = label_counts(df, label)
    totals = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    rows, classes = totals.select("rows").scalar(), totals.select("classes").scalar()
    return counts.withColumn("weight", rows / (classes * F.col("n")))


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight`."""
    weights = class_weights(df, label).select(label, "weight")
    return df.join(materialise(weights, "class-weights"), label)


class _Fits(Iterator):
    """Models of settings 0..count-1, each fitted by the thread that asks for it."""

    def __init__(self, fit_one: Callable, count: int):
        self._fit_one, self._numbers, self._lock = fit_one, iter(range(count)), threading.Lock()

    def __next__(self) -> tuple:
        with self._lock:
            number = next(self._numbers)
        return number, self._fit_one(number)


class LabelRegression(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Multinomial logistic regression of `label` on `features`; its model adds `predicted_label`.

    `alpha` is the L2 strength on the mean loss. Labels are numbered and rows weighted by what the rows
    of the fit hold, once for all settings that are fitted on them.
    """

    alpha = Param(Params._dummy(), "alpha", "L2 strength", TypeConverters.toFloat)
    classWeight = Param(Params._dummy(), "classWeight", "none or balanced", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)

    def __init__(self, alpha: float = 1e-4, class_weight: str | None = "balanced", max_iter: int = schema.MAX_ITER):
        super().__init__()
        self._set(alpha=alpha, classWeight=class_weight or UNWEIGHTED, maxIter=max_iter)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        with scratch(dataset.sparkSession):
            return next(self.fitMultiple(dataset, [{}]))[1]

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator:
        indexer = StringIndexer(inputCol="label", outputCol="_label_no", stringOrderType="alphabetAsc").fit(dataset)
        weighted = with_class_weights(dataset.select("features", "label"))
        # Written, not cached: every fit caches its own scaled copy.
        rows = materialise(indexer.transform(weighted).select("features", "_label_no", "weight"), "fit-rows")
        to_name = IndexToString(
            inputCol="_predicted_no", outputCol="predicted_label", labels=list(indexer.labels)
        )

        def fit_one(number: int) -> PipelineModel:
            return PipelineModel([self.copy(paramMaps[number])._regression().fit(rows), to_name])

        return _Fits(fit_one, len(paramMaps))

    def _regression(self) -> LogisticRegression:
        model = LogisticRegression(
            featuresCol="features",
            labelCol="_label_no",
            predictionCol="_predicted_no",
            family="multinomial",
            regParam=self.getOrDefault(self.alpha),
            elasticNetParam=0.0,
            maxIter=self.getOrDefault(self.maxIter),
            standardization=False,
            tol=schema.TOLERANCE,
        )
        return model if self.getOrDefault(self.classWeight) == UNWEIGHTED else model.setWeightCol("weight")


class LabelF1(Evaluator):
    """Weighted F1 of `predicted_label` against `label`; labels the fit did not see count as missed."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return weighted_f1(pair_counts(dataset))

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class TrainedModel:
    """A fitted classifier and the record of how it was trained."""

    stages: PipelineModel
    config: dict = field(default_factory=dict)

    @property
    def vectoriser(self) -> TfidfModel:
        return self.stages.stages[0]

    @property
    def regression(self) -> LogisticRegressionModel:
        return self.stages.stages[1].stages[0]

    def predict(self, df: DataFrame, text: str = "processed_text") -> DataFrame:
        """Add `predicted_label` to rows with a normalised text."""
        scored = self.stages.transform(df, {self.vectoriser.inputCol: text})
        return scored.select(*df.columns, "predicted_label")


def text_classifier(
    alpha: float = 1e-4,
    class_weight: str | None = "balanced",
    max_features: int = schema.MAX_FEATURES,
    max_iter: int = schema.MAX_ITER,
) -> Pipeline:
    return Pipeline(stages=[Tfidf(max_features), LabelRegression(alpha, class_weight, max_iter)])


def _with_record(stages: PipelineModel, alpha: float, class_weight: str | None, max_features: int) -> TrainedModel:
    trained = TrainedModel(stages)
    trained.config = {
        "best_params": {"alpha": alpha, "class_weight": class_weight},
        "n_classes": trained.regression.numClasses,
        "max_features": max_features,
        "ngram_range": [1, 2],
        "random_state": schema.SEED,
    }
    return trained


def fit_classifier(
    train: DataFrame,
    alpha: float,
    class_weight: str | None = "balanced",
    max_features: int = schema.MAX_FEATURES,
    max_iter: int = schema.MAX_ITER,
) -> TrainedModel:
    """Fit one setting on (processed_text, label) rows."""
    rows = materialise(train.filter("label is not null").select("processed_text", "label"), "training-rows")
    stages = text_classifier(alpha, class_weight, max_features, max_iter).fit(rows)
    return _with_record(stages, alpha, class_weight, max_features)


@dataclass
class Searched:
    """The best setting fitted on all rows, and the mean and deviation of F1 over folds of every setting."""

    trained: TrainedModel
    scores: list[dict]


def _fold_scores(rows: DataFrame, number: int, vectoriser: Tfidf, regression: LabelRegression, grid: list[dict]) -> list[float]:
    """Score of every setting on one fold, fitted on the others."""
    start = vectoriser.fit(rows.filter(F.col("fold") != number))
    with scratch(rows.sparkSession):
        vectors = materialise(start.transform(rows).select("features", "label", "fold"), "fold-vectors")
        held, evaluator = vectors.filter(F.col("fold") == number), LabelF1()
        fits = regression.fitMultiple(vectors.filter(F.col("fold") != number), grid)
        scores = [0.0] * len(grid)

        def fit_and_score() -> None:
            at, model = next(fits)
            scores[at] = evaluator.evaluate(model.transform(held))

        with ThreadPool(_fits_at_once(vectors)) as pool:
            for done in [pool.apply_async(inheritable_thread_target(rows.sparkSession)(fit_and_score)) for _ in grid]:
                done.get()
    return scores


def _fits_at_once(vectors: DataFrame) -> int:
    """As many fits as the storage memory holds the rows of: each fit caches its own, and reads them in every step."""
    spark = vectors.sparkSession
    size = max(1, int(str(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    memory = [status._1() for status in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    ).values()]
    return max(1, min(PARALLEL_FITS, sum(memory) // (CACHED_TO_WRITTEN * size)))


def search(
    train: DataFrame,
    alphas: Sequence[float] = schema.GRID_ALPHAS,
    weightings: Sequence[str | None] = schema.GRID_CLASS_WEIGHTS,
    count: int = schema.CV_FOLDS,
    max_features: int = schema.MAX_FEATURES,
    max_iter: int = schema.MAX_ITER,
) -> Searched:
    """Grid search over stratified folds, then a fit of the best setting; the first tried wins a tie.

    `train` has incident_id, processed_text and label. The vectoriser is fitted anew per fold, and all settings of
    a fold are fitted and scored on vectors written once.
    """
    rows = materialise(folds(train, count).select("processed_text", "label", "fold"), "folds")
    classifier = text_classifier(max_features=max_features, max_iter=max_iter)
    regression = classifier.getStages()[-1]
    grid = (
        ParamGridBuilder()
        .addGrid(regression.alpha, [float(alpha) for alpha in alphas])
        .addGrid(regression.classWeight, [weighting or UNWEIGHTED for weighting in weightings])
        .build()
    )
    vectoriser = classifier.getStages()[0]
    found = np.array([_fold_scores(rows, number, vectoriser, regression, grid) for number in range(count)])
    settings = [(setting[regression.alpha], setting[regression.classWeight]) for setting in grid]
    scores = [
        {
            "alpha": alpha,
            "class_weight": None if weighting == UNWEIGHTED else weighting,
            "f1_weighted": float(mean),
            "f1_deviation": float(deviation),
        }
        for (alpha, weighting), mean, deviation in zip(settings, found.mean(axis=0), found.std(axis=0), strict=True)
    ]
    best = max(range(len(scores)), key=lambda at: scores[at]["f1_weighted"])
    stages = classifier.fit(rows, grid[best])
    best = scores[best]
    trained = _with_record(stages, best["alpha"], best["class_weight"], max_features)
    trained.config |= {"best_cv_f1_weighted": best["f1_weighted"], "cv_folds": count}
    return Searched(trained, scores)


def search_and_fit(train: DataFrame, **grid) -> TrainedModel:
    """The best setting of `search`, fitted on all training rows."""
    return search(train, **grid).trained


def save_model(trained: TrainedModel, spark: SparkSession, path: str) -> None:
    """The fitted pipeline, its vocabulary among its stages, and the training record."""
    trained.stages.write().overwrite().save(f"{path}/stages")
    record = spark.createDataFrame([(json.dumps(trained.config),)], "value string")
    record.coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    config = json.loads(spark.read.text(f"{path}/config").first()["value"])
    return TrainedModel(PipelineModel.load(f"{path}/stages"), config)


def training_record(trained: TrainedModel, spark: SparkSession) -> DataFrame:
    """The training record as (setting, value) rows."""
    rows = [(key, json.dumps(value)) for key, value in sorted(trained.config.items())]
    return spark.createDataFrame(rows, "setting string, value string")
