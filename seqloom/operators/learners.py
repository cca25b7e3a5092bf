"""Supervised learners over vectors, from ``pyspark.ml``, scored by our metrics."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence
from itertools import product

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics


def classifiers(seed: int = 42) -> Mapping[str, object]:
    return {
        "logistic": LogisticRegression(maxIter=50),
        "svc_ovr": OneVsRest(classifier=LinearSVC(maxIter=20)),
        "tree": DecisionTreeClassifier(seed=seed),
        "forest": RandomForestClassifier(seed=seed, numTrees=20),
        "bayes": NaiveBayes(modelType="gaussian"),
    }


def regressors(seed: int = 42) -> Mapping[str, object]:
    return {
        "linear": LinearRegression(),
        "tree": DecisionTreeRegressor(seed=seed),
        "forest": RandomForestRegressor(seed=seed, numTrees=20),
        "gbt": GBTRegressor(seed=seed, maxIter=20),
    }


def _ready(df: DataFrame, vec: str, label: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double")))).withColumn("label", F.col(label).cast("double"))


def sweep(train: DataFrame, test: DataFrame, vec: str, label: str, task: str = "classification", names: Sequence[str] | None = None) -> DataFrame:
    """Fits each registered learner; one row per model with its test metrics and fit seconds, or its error.

    Classifiers: accuracy, balanced accuracy, weighted F1, AUC of hard
    predictions, macro scores, MCC; regressors: errors, R2 and adjusted R2.
    """
    registry = classifiers() if task == "classification" else regressors()
    a, b = _ready(train, vec, label).persist(), _ready(test, vec, label)
    first = train.select(F.size(vec).alias("n")).first()
    features = first["n"] if first else 0
    out, failed = None, []
    for name in names or registry:
        try:
            began = time.perf_counter()
            pred = registry[name].fit(a).transform(b).select("label", F.col("prediction").alias("pred"))
            seconds = time.perf_counter() - began
        except (PySparkException, Py4JJavaError, ValueError, KeyError) as e:  # one learner's failure does not end the sweep
            failed.append((name, str(e)[:200]))
            continue
        pred = pred.withColumn("model", F.lit(name))
        if task == "classification":
            c = metrics.confusion(pred, ["model"])
            row = metrics.sweep_scores(c, ["model"]).join(metrics.macro_prf(c, ["model"]), "model").join(metrics.mcc(c, ["model"]), "model")
        else:
            row = metrics.regression(pred, ["model"], "label", "pred").join(pred.groupBy("model").agg(F.count(F.lit(1)).alias("n_test")), "model")
            row = row.withColumn("adjusted_r2", metrics.adjusted_r2(F.col("r2"), F.col("n_test"), features))
        row = row.withColumn("seconds", F.lit(seconds)).withColumn("error", F.lit(None).cast("string"))
        out = row if out is None else out.unionByName(row)
    a.unpersist()
    if failed:
        bad = train.sparkSession.createDataFrame(failed, "model string, error string")
        out = bad if out is None else out.unionByName(bad, allowMissingColumns=True)
    return out


class MetricScorer(Evaluator):
    """An ML evaluator from any function of (labels and predictions) to one number."""

    def __init__(self, metric: Callable[[DataFrame], float], larger_is_better: bool = True):
        super().__init__()
        self.metric, self.larger = metric, larger_is_better

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.metric(dataset.select("label", "prediction")))

    def isLargerBetter(self) -> bool:
        return self.larger


def search(train: DataFrame, vec: str, label: str, name: str, choices: Mapping[str, Sequence], n_iter: int = 10, folds: int = 3,
           task: str = "classification", scorer: Evaluator | None = None, seed: int = 42):
    """Random search with cross-validation; ``(best model, table of settings and mean scores)``.

    ``choices`` lists values by the learner's parameter name; at most ``n_iter``
    combinations are tried, drawn by ``seed``.
    """
    learner = (classifiers(seed) if task == "classification" else regressors(seed))[name]
    every = [dict(zip(choices, values)) for values in product(*choices.values())]
    tried = every if len(every) <= n_iter else random.Random(seed).sample(every, n_iter)
    grid = [{learner.getParam(k): v for k, v in t.items()} for t in tried]
    usual = MulticlassClassificationEvaluator(metricName="f1") if task == "classification" else RegressionEvaluator(metricName="r2")
    found = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=scorer or usual, numFolds=folds, seed=seed).fit(_ready(train, vec, label))
    rows = [({k: str(v) for k, v in t.items()}, float(m)) for t, m in zip(tried, found.avgMetrics)]
    return found.bestModel, train.sparkSession.createDataFrame(rows, "settings map<string,string>, score double")


def run_named(splits: DataFrame, vec: str, label: str, name: str, task: str = "classification", production: bool = False, split: str = "split", seeds: Sequence[int] = (42,)) -> DataFrame:
    """Fits one named learner per seed and scores it on the test rows; one row per seed.

    In production the validation rows are trained on as well.
    """
    train = splits.where(F.col(split).isin(["train", "valid"] if production else ["train"]))
    test = splits.where(F.col(split) == "test")
    a, b = _ready(train, vec, label), _ready(test, vec, label)
    out = None
    for seed in seeds:
        learner = (classifiers(seed) if task == "classification" else regressors(seed))[name]
        pred = learner.fit(a).transform(b).select(F.lit(seed).alias("seed"), "label", F.col("prediction").alias("pred"))
        out = pred if out is None else out.unionByName(pred)
    if task != "classification":
        return metrics.regression(out, ["seed"], "label", "pred")
    c = metrics.confusion(out, ["seed"])
    acc = c.groupBy("seed").agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n_test"))
    return acc.join(metrics.macro_prf(c, ["seed"]), "seed").join(metrics.mcc(c, ["seed"]), "seed")
