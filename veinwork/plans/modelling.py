"""Model fitting as Spark jobs: preprocessing, out-of-fold scoring over spatial folds, leaderboards, importances, calibration."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.operators import metrics
from veinwork.operators.ordered import quantiles
from veinwork.sources.scratch import settled


#: What a task of a fit holds: trees keep their rows in memory, some 300 bytes each, and read them whole at every level.
FIT_ROWS = 50_000


def even(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into parts of about FIT_ROWS, each in the keys' order: a small file may hold millions of rows, and trees draw rows by their place."""
    return df.repartition(max(1, math.ceil(df.count() / FIT_ROWS)), *keys).sortWithinPartitions(*keys)


class MedianImputer(Estimator):
    """Exact medians, the mean of the middle two, in place of nulls and NaN: column c becomes c__i. A column without numbers stays null."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _fit(self, df: DataFrame) -> SQLTransformer:
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
        long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in self.columns))))
        medians = {r.column: r.median for r in quantiles(long, ["column"], F.col("v"), {"median": 0.5}).collect()}  # a row per column
        filled = (f"coalesce(nanvl(cast(`{c}` as double), null), {f"double('{medians[c]!r}')" if c in medians else "cast(null as double)"}) as `{c}__i`" for c in self.columns)
        return SQLTransformer(statement=f"select *, {', '.join(filled)} from __THIS__")


def preprocessor(numeric: list[str], categories: list[str] = (), scale: bool = False) -> list:
    """Pipeline stages: medians for missing numbers, unknown categories kept apart, one vector column `features`."""
    stages: list = [MedianImputer(numeric)] if numeric else []
    if categories:
        stages += [StringIndexer(inputCols=list(categories), outputCols=[f"{c}__x" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__x" for c in categories], outputCols=[f"{c}__h" for c in categories], handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[f"{c}__i" for c in numeric] + [f"{c}__h" for c in categories], outputCol="raw" if scale else "features", handleInvalid="keep"))
    return stages + ([StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else [])


def estimators(task: str, label: str, seed: int = 7) -> dict:
    """The competing algorithms of a task, with small fixed parameters."""
    if task == "regression":
        return {
            "linear": LinearRegression(labelCol=label, regParam=0.01),
            "random_forest": RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=5, seed=seed),
            "boosted_trees": GBTRegressor(labelCol=label, maxIter=10, maxDepth=3, seed=seed),
        }
    return {
        "logistic": LogisticRegression(labelCol=label, regParam=0.01),
        "random_forest": RandomForestClassifier(labelCol=label, numTrees=20, maxDepth=5, seed=seed, weightCol="class_weight"),
        "boosted_trees": GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=seed),
    }


def balanced(df: DataFrame, label: str) -> DataFrame:
    """class_weight: rows over twice the class's rows."""
    n = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__p"))
    w = F.when(F.col(label) == 1, F.col("__n") / (2 * F.col("__p"))).otherwise(F.col("__n") / (2 * (F.col("__n") - F.col("__p"))))
    return df.join(F.broadcast(n), how="inner").withColumn("class_weight", w).drop("__n", "__p")


def out_of_fold(df: DataFrame, key: str, label: str, stages: list, estimator, folds: int, task: str, fold: str = "fold") -> DataFrame:
    """key, fold, y, score: each row scored once, by the model that trained without its fold."""
    return out_of_folds(df, key, label, stages, {"": estimator}, folds, task, fold)[""]


def out_of_folds(df: DataFrame, key: str, label: str, stages: list, estimators: dict, folds: int, task: str, fold: str = "fold") -> dict[str, DataFrame]:
    """out_of_fold() of several estimators over the same stages, which are fitted once a fold."""
    data, parts = settled(even(df, key), "fit-rows"), {name: [] for name in estimators}
    score = vector_to_array("probability")[1] if task == "classification" else F.col("prediction")
    for k in range(folds):
        train, test = even(data.where(F.col(fold) != k), key), data.where(F.col(fold) == k)
        prepared = Pipeline(stages=stages).fit(train)
        rows = prepared.transform(balanced(train, label) if task == "classification" else train)
        for name, estimator in estimators.items():
            scored = estimator.fit(rows).transform(prepared.transform(test))
            parts[name].append(scored.select(key, F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), score.alias("score")))
    return {name: reduce(DataFrame.unionByName, some) for name, some in parts.items()}


def competition(df: DataFrame, key: str, label: str, stages: list, folds: int, task: str, seed: int = 7) -> DataFrame:
    """algorithm, fold, the task's metrics; out-of-fold scores of every algorithm."""
    out = []
    for name, oof in out_of_folds(df, key, label, stages, estimators(task, label, seed), folds, task).items():
        m = metrics.regression(oof, ["fold"], "y", "score") if task == "regression" else metrics.ranking(oof, ["fold"]).join(metrics.confusion(oof, ["fold"]).select("fold", "n", "brier"), "fold")
        out.append(m.withColumn("algorithm", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def leaderboard(folds: DataFrame, metric: str, ascending: bool) -> DataFrame:
    from veinwork.operators.windows import leaderboard as rank

    g = folds.groupBy("algorithm").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    return rank(g, [F.asc("mean") if ascending else F.desc("mean"), "algorithm"], F.col("mean").isNotNull())


def calibrated(oof: DataFrame, folds: int) -> DataFrame:
    """Scores through a sigmoid that was fitted on the other folds' out-of-fold scores."""
    logit = F.log(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score"))) / (1 - F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))))
    d = VectorAssembler(inputCols=["logit"], outputCol="features").transform(oof.withColumn("logit", logit))
    parts = []
    for k in range(folds):
        model = LogisticRegression(labelCol="y").fit(d.where(F.col("fold") != k))
        parts.append(model.transform(d.where(F.col("fold") == k)).withColumn("score", vector_to_array("probability")[1]).select(*oof.columns))
    return reduce(DataFrame.unionByName, parts)


def importances(df: DataFrame, key: str, label: str, numeric: list[str], n: int = 10, seed: int = 7) -> DataFrame:
    rows = even(df.select(key, label, *numeric), key)
    model = Pipeline(stages=[*preprocessor(numeric), RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=5, seed=seed)]).fit(rows)
    rows = [(c, float(v)) for c, v in zip(numeric, model.stages[-1].featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def f_statistics(df: DataFrame, label: str, numeric: list[str]) -> DataFrame:
    """feature, f: the two-class analysis of variance of each feature, from sums alone."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numeric))).alias("x")).select("y", "x.*")
    g = long.where("v is not null").groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = g.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("s")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = (F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("k") - 1)
    return t.select("feature", F.when((F.col("k") > 1) & (F.col("within") > 0), between / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


#: Declared parameter grids by algorithm: small, fixed, searched whole.
GRIDS = {
    "linear": {"regParam": [0.0, 0.01, 0.1]},
    "logistic": {"regParam": [0.0, 0.01, 0.1]},
    "random_forest": {"numTrees": [20, 50], "maxDepth": [5, 8]},
    "boosted_trees": {"maxIter": [10, 20], "maxDepth": [3, 5]},
}


def candidates(task: str, label: str, stages: list, algorithms: list[str], seed: int = 7) -> dict[str, list]:
    """name -> pipeline stages, for every point of the algorithms' grids."""
    out = {}
    for name in algorithms:
        base, builder = estimators(task, label, seed)[name], ParamGridBuilder()
        for param, values in GRIDS[name].items():
            builder = builder.addGrid(base.getParam(param), values)
        for point in builder.build():
            said = ",".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda x: x[0].name))
            out[f"{name}({said})"] = [*stages, base.copy(point)]
    return out


def linear_on(features: list[str], label: str) -> list:
    """Stages of an ordinary least squares model of a few complete numbers."""
    return [VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(labelCol=label, regParam=0.0, solver="normal")]


def _loss(scored: DataFrame, label: str, task: str) -> float:
    """Root mean squared error, or one less the ROC AUC: less is better."""
    if task == "regression":
        return scored.agg(F.sqrt(F.avg((F.col("prediction") - F.col(label)) ** 2))).first()[0]
    auc = metrics.ranking(scored.withColumn("score", vector_to_array("probability")[1]), [], label).first()
    return 1 - auc.auc if auc and auc.auc is not None else 1.0


def nested_cv(df: DataFrame, key: str, label: str, choices: dict[str, list], folds: int, task: str = "regression", fold: str = "fold") -> DataFrame:
    """key, fold, y, score, chosen: every fold is scored by the candidate that was best, on average, in folds of its training rows
    alone, fitted again on all of them. The fold column holds groups together, inside as outside."""
    parts = []
    for k in range(folds):
        train, losses = even(df.where(F.col(fold) != k), key).cache(), {}
        for name, stages in choices.items():
            each = [_loss(Pipeline(stages=stages).fit(train.where(F.col(fold) != i)).transform(train.where(F.col(fold) == i)), label, task) for i in range(folds) if i != k]
            losses[name] = sum(each) / len(each)
        best = min(losses, key=lambda name: (losses[name], name))
        scored = Pipeline(stages=choices[best]).fit(train).transform(df.where(F.col(fold) == k))
        score = vector_to_array("probability")[1] if task == "classification" else F.col("prediction")
        parts.append(scored.select(key, F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), score.alias("score"), F.lit(best).alias("chosen")))
        train.unpersist()
    return reduce(DataFrame.unionByName, parts)


def gated_competition(df: DataFrame, key: str, label: str, algorithms: dict[str, dict[str, list]], folds: int, least_gain: float = 0.05) -> DataFrame:
    """algorithm, rmse, gain over the training mean, place and passes: nested out-of-fold scores of each algorithm, ranked; a winner that
    gains less than least_gain isn't one."""
    from veinwork.operators.folds import baseline

    mean = baseline(df, label, folds).agg(F.sqrt(F.avg((F.col("pred") - F.col(label)) ** 2)).alias("base"))
    out = [nested_cv(df, key, label, choices, folds).agg(F.sqrt(F.avg((F.col("score") - F.col("y")) ** 2)).alias("rmse")).withColumn("algorithm", F.lit(name)) for name, choices in algorithms.items()]
    rows = reduce(DataFrame.unionByName, out).join(F.broadcast(mean), how="inner").withColumn("gain", 1 - F.col("rmse") / F.col("base")).drop("base")
    from veinwork.operators.windows import leaderboard as rank

    return rank(rows, [F.asc("rmse"), "algorithm"], F.col("rmse").isNotNull()).withColumnRenamed("rank", "place").withColumn("passes", (F.col("place") == 1) & (F.col("gain") >= least_gain))


def learning_curve(df: DataFrame, key: str, label: str, stages: list, folds: int, group: str, fractions: tuple[float, ...], seed: str) -> DataFrame:
    """fraction, fold, n_train, rmse: models of nested random subsets of groups, each tested on its whole fold."""
    from veinwork.operators.folds import group_subset

    out = []
    for share in fractions:
        subset = group_subset(df, group, share, seed).cache()
        for k in range(folds):
            train = subset.where(F.col("fold") != k)
            scored = Pipeline(stages=stages).fit(train).transform(df.where(F.col("fold") == k))
            one = scored.agg(F.sqrt(F.avg((F.col("prediction") - F.col(label)) ** 2)).alias("rmse"))
            out.append(one.join(train.agg(F.count(F.lit(1)).alias("n_train")), how="inner").select(F.lit(share).alias("fraction"), F.lit(k).alias("fold"), "n_train", "rmse"))
    return reduce(DataFrame.unionByName, out)


def batch_score(model: PipelineModel, df: DataFrame, key: str, q90: float, bounds: DataFrame, features: list[str], most_outside: float = 0.5) -> DataFrame:
    """key, prediction, low_q90, high_q90, outside, status: the model's interval is its out-of-fold residuals' 90th percentile either
    way; a row with too many features absent or outside the training profile is abstained from."""
    from veinwork.operators.aggregates import applicability

    told = applicability(model.transform(df), bounds, features)
    ok = F.col("outside") <= most_outside
    say = lambda x: F.when(ok, x)
    return told.select(key, say(F.col("prediction")).alias("prediction"), say(F.col("prediction") - q90).alias("low_q90"), say(F.col("prediction") + q90).alias("high_q90"), "outside", F.when(ok, "scored").otherwise("abstained").alias("status"))


def integrated(first: DataFrame, second: DataFrame, key: str, high_first: float, high_second: float) -> DataFrame:
    """One row: cases that both models scored, the correlation of their scores with its strength, and how often they agree on high ones.
    first and second: (key, score), a row per case."""
    from veinwork.functions.columns import concordance, strength
    from veinwork.operators.joins import one_to_one

    both = one_to_one(first.select(key, F.col("score").alias("a")), second.select(key, F.col("score").alias("b")), [key]).where("a is not null and b is not null")
    label = concordance(F.col("a") >= high_first, F.col("b") >= high_second)
    names = ("both_high", "first_high_only", "second_high_only", "both_low")
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"), *(F.count_if(label == x).alias(x) for x in names)).withColumn("strength", strength(F.col("r")))


def volume_comparison(df: DataFrame, key: str, label: str, variants: dict, stages: list, folds: int) -> DataFrame:
    """variant, fold, n_train, n_test, mae: each variant trains on its own rows of the other folds; all are tested on the rows that every
    variant has. variants: name -> condition."""
    common = reduce(lambda a, b: a & b, variants.values())
    out = []
    for name, ok in variants.items():
        for k in range(folds):
            train = df.where(ok & (F.col("fold") != k))
            scored = Pipeline(stages=stages).fit(train).transform(df.where(common & (F.col("fold") == k)))
            one = scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(F.col("prediction") - F.col(label))).alias("mae"))
            out.append(one.join(train.agg(F.count(F.lit(1)).alias("n_train")), how="inner").select(F.lit(name).alias("variant"), F.lit(k).alias("fold"), "n_train", "n_test", "mae"))
    return reduce(DataFrame.unionByName, out)
