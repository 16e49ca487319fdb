"""Validation of models by spatial folds: training and held-out scores of one fit, nested folds dealt anew by group, pipelines that are
saved and read back. Fits are jobs of their own and run in a few threads; each reads the same written table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators import calibration
from veinwork.operators import folds as f
from veinwork.operators import metrics as m
from veinwork.sources.scratch import folder, settled

from .modelling import _loss, balanced

#: Fits at a time; the cluster shares its executors among them.
THREADS = 4
#: A ROC AUC that falls by more than this is overfitting; one at most that, apparent and held out, is underfitting.
STRONG_GAP, NO_SKILL = 0.15, 0.6


def _each(job: Callable, some: Iterable) -> list:
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(job, some))


def kept_model(model: PipelineModel, path: str) -> PipelineModel:
    """The pipeline as it is read back after saving."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def score_column(task: str) -> Column:
    return vector_to_array("probability")[1] if task == "classification" else F.col("prediction")


class FoldModels:
    """A model for each fold, fitted on the eligible rows of the others. labels: the label under each fold's model, where it depends on
    the fold. df: a settled table."""

    def __init__(self, df: DataFrame, stages: list, folds: int, label: str, labels: dict[int, Column], eligible: Column | None = None, task: str = "regression", fold: str = "fold"):
        self.df, self.folds, self.label, self.labels, self.task, self.fold = df, folds, label, labels, task, fold
        self.eligible = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))

        def fit(k: int) -> PipelineModel:
            train = self.rows(k).where((F.col(fold) != k) & self.eligible)
            return Pipeline(stages=stages).fit(balanced(train, label) if task == "classification" else train)

        self.models = dict(enumerate(_each(fit, range(folds))))

    def rows(self, k: int) -> DataFrame:
        return self.df.withColumn(self.label, self.labels[k].cast("double")) if k in self.labels else self.df

    def save(self, path: str) -> None:
        """Save all pipelines and go on with what is read back."""
        self.models = {k: kept_model(model, f"{path}/fold_{k}") for k, model in self.models.items()}

    def held_out(self, key: str) -> DataFrame:
        """key, fold, y, score: each row by the model that trained without its fold."""
        return self._union(key, lambda k: F.col(self.fold) == k).drop("part")

    def both_sides(self, key: str) -> DataFrame:
        """key, fold (of the model), part, y, score: the rows that each model trained on (train) and those of its fold (test)."""
        return self._union(key, lambda k: (F.col(self.fold) == k) | self.eligible)

    def _union(self, key: str, which: Callable[[int], Column]) -> DataFrame:
        part = lambda k: F.when(F.col(self.fold) == k, "test").otherwise("train").alias("part")
        one = lambda k: self.models[k].transform(self.rows(k).where(which(k))).select(key, F.lit(k).alias("fold"), part(k), F.col(self.label).cast("double").alias("y"), score_column(self.task).alias("score"))
        return reduce(DataFrame.unionByName, map(one, range(self.folds)))


def sides(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and, for train and test: n, auc, ap, brier; what AUC and AP lose, and whether the AUC loses strongly. scored: keys, part, y, score."""
    by = [*keys, "part"]
    c = m.confusion(scored, by).select(*by, "n", "brier").join(m.ranking(scored, by), by)
    pick = lambda p, x: F.max(F.when(F.col("part") == p, F.col(x))).alias(f"{p}_{x}")
    g = c.groupBy(*keys).agg(*(pick(p, x) for x in ("n", "auc", "ap", "brier") for p in ("train", "test")))
    gap = F.col("train_auc") - F.col("test_auc")
    return g.select("*", gap.alias("auc_gap"), (F.col("train_ap") - F.col("test_ap")).alias("ap_gap"), (gap > STRONG_GAP).alias("strong_overfit"))


def overfit_audit(df: DataFrame, key: str, value: str, algorithms: dict[str, list], folds: int, label: str = "label", q: float = 0.75, eligible: Column | None = None) -> DataFrame:
    """algorithm, fold, sides() and refit_difference. A row's label is that of the model's fold: whether value reaches the quantile of the
    fold's training rows. Models are saved and read back; refit_difference is how far what they say then is from the scores stored before."""
    limits = {r.train_fold: r.threshold for r in f.fold_thresholds(df, value, folds, q).collect()}  # a row for each fold
    labels = {k: (F.col(value) >= t) for k, t in limits.items()}
    out, apart = [], []
    for name, stages in algorithms.items():
        models = FoldModels(df, stages, folds, label, labels, eligible)
        stored = settled(models.held_out(key), "held-out").withColumnRenamed("score", "stored")
        models.save(folder(df.sparkSession, "fold-models"))
        out.append(models.both_sides(key).withColumn("algorithm", F.lit(name)))
        again = models.held_out(key).join(stored.drop("y"), [key, "fold"])
        apart.append(again.groupBy("fold").agg(F.max(F.abs(F.col("score") - F.col("stored"))).alias("refit_difference")).withColumn("algorithm", F.lit(name)))
    by = ["algorithm", "fold"]
    return sides(settled(reduce(DataFrame.unionByName, out), "both-sides"), by).join(reduce(DataFrame.unionByName, apart), by)


def generalisation(df: DataFrame, key: str, value: str, algorithms: dict[str, list], folds: int, label: str = "label", q: float = 0.75, eligible: Column | None = None) -> DataFrame:
    """algorithm, n, positives, then AUC, AP, Brier score and balanced accuracy at 0.5 of: fit (the final model on the rows it was fitted on), hold
    (held-out scores of the same rows and labels), fold (those scores under the labels of their folds); gaps and flags."""
    limits = {r.train_fold: r.threshold for r in f.fold_thresholds(df, value, folds, q).collect()}
    fixed = f.quantiles(df, [], F.col(value), {"t": q}).first().t
    keep = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    rows = df.withColumn(label, (F.col(value) >= fixed).cast("double"))
    out = []
    for name, stages in algorithms.items():
        final = Pipeline(stages=stages).fit(rows.where(keep))
        said = final.transform(rows.where(keep)).select(key, F.lit("fit").alias("kind"), F.col(label).alias("y"), F.col("prediction").alias("score"))
        held = FoldModels(df, stages, folds, label, {k: (F.col(value) >= t) for k, t in limits.items()}, eligible).held_out(key)
        same = rows.where(keep).select(key, F.col(label).alias("__fixed"))
        held = settled(held.join(same, key), "held-out")
        for kind, y in (("hold", "__fixed"), ("fold", "y")):
            said = said.unionByName(held.select(key, F.lit(kind).alias("kind"), F.col(y).alias("y"), "score"))
        out.append(said.withColumn("algorithm", F.lit(name)))
    by = ["algorithm", "kind"]
    scored = settled(reduce(DataFrame.unionByName, out), "generalisation")
    c = m.confusion(scored, by).select(*by, "n", F.col("prevalence"), "brier", "balanced_accuracy").join(m.ranking(scored, by), by)
    pick = lambda kind, x: F.max(F.when(F.col("kind") == kind, F.col(x))).alias(f"{kind}_{x}")
    g = c.groupBy("algorithm").agg(F.max("n").alias("n"), F.max(F.when(F.col("kind") == "fit", F.round(F.col("prevalence") * F.col("n")))).cast("bigint").alias("positives"), *(pick(k, x) for k in ("fit", "hold", "fold") for x in ("auc", "ap", "brier", "balanced_accuracy")))
    gap = F.col("fit_auc") - F.col("hold_auc")
    return g.select("*", gap.alias("auc_gap"), (F.col("fit_ap") - F.col("hold_ap")).alias("ap_gap"), (gap > STRONG_GAP).alias("strong_overfit"), ((F.col("fit_auc") <= NO_SKILL) & (F.col("hold_auc") <= NO_SKILL)).alias("underfit"))


def with_inner_folds(df: DataFrame, group: str, folds: int, inner: int, fold: str = "fold") -> DataFrame:
    """df with inner: for each outer fold that a row trains for, its fold within those training rows."""
    dealt = f.nested_folds(df, group, folds, inner, fold)
    by_group = dealt.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("outer", "inner"))).alias("inner"))  # `folds` entries at most
    return df.join(by_group, group)


def nested_cv(df: DataFrame, key: str, label: str, choices: dict[str, list], folds: int, group: str, inner: int = 3, task: str = "regression", fold: str = "fold", save: str | None = None) -> DataFrame:
    """key, fold, y, score, chosen. In each outer fold's training rows groups are dealt to inner folds anew; the candidate with the least mean
    loss over these is fitted on all training rows and, if save is given, saved there and read back, before it scores the fold."""
    data = settled(with_inner_folds(df, group, folds, inner, fold), "nested")
    train = {k: data.where(F.col(fold) != k) for k in range(folds)}

    def loss(job: tuple[int, str, int]) -> float | None:
        k, name, i = job
        at = F.col("inner")[k]
        fit, test = train[k].where(at != i), train[k].where(at == i)
        if test.isEmpty():
            return None
        return _loss(Pipeline(stages=choices[name]).fit(balanced(fit, label) if task == "classification" else fit).transform(test), label, task)

    jobs = [(k, name, i) for k in range(folds) for name in choices for i in range(inner)]
    losses: dict[tuple[int, str], list[float]] = {}
    for (k, name, _), x in zip(jobs, _each(loss, jobs)):
        losses.setdefault((k, name), []).extend([x] if x is not None else [])
    best = {k: min(choices, key=lambda name: (sum(losses[k, name]) / max(1, len(losses[k, name])), name)) for k in range(folds)}

    def final(k: int) -> PipelineModel:
        model = Pipeline(stages=choices[best[k]]).fit(balanced(train[k], label) if task == "classification" else train[k])
        return kept_model(model, f"{save}/fold_{k}") if save else model

    models = _each(final, range(folds))
    one = lambda k: models[k].transform(data.where(F.col(fold) == k)).select(key, F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), score_column(task).alias("score"), F.lit(best[k]).alias("chosen"))
    return reduce(DataFrame.unionByName, map(one, range(folds)))


def isolation(df: DataFrame, group: str, folds: int, inner: int, fold: str = "fold") -> DataFrame:
    """One row: groups, those that lie in several outer folds, and those that lie in several inner folds of an outer one."""
    outer = df.groupBy(group).agg(F.countDistinct(fold).alias("n")).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("shared_outer"))
    within = f.nested_folds(df, group, folds, inner, fold).groupBy("outer", group).agg(F.countDistinct("inner").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_inner"))
    return outer.join(F.broadcast(within), how="inner")


def competition(df: DataFrame, key: str, label: str, algorithms: dict[str, dict[str, list]], folds: int, group: str, inner: int = 3, least_gain: float = 0.05) -> DataFrame:
    """algorithm, rmse, gain over the training mean, place, passes and final_rmse. Nested held-out scores rank the algorithms; the winner, unless
    it gains less than least_gain, is fitted on all rows, saved, read back and scored on them once more."""
    from veinwork.operators.windows import leaderboard as rank

    spark, data = df.sparkSession, settled(df, "competition")
    mean = f.baseline(data, label, folds).agg(F.sqrt(F.avg((F.col("pred") - F.col(label)) ** 2)).alias("base"))
    rmse = lambda x, y: F.sqrt(F.avg((F.col(x) - F.col(y)) ** 2))
    out = [nested_cv(data, key, label, choices, folds, group, inner, save=folder(spark, f"nested-{name}")).agg(rmse("score", "y").alias("rmse")).withColumn("algorithm", F.lit(name)) for name, choices in algorithms.items()]
    rows = reduce(DataFrame.unionByName, out).join(F.broadcast(mean), how="inner").withColumn("gain", 1 - F.col("rmse") / F.col("base")).drop("base")
    board = settled(rank(rows, [F.asc("rmse"), "algorithm"], F.col("rmse").isNotNull()).withColumnRenamed("rank", "place").withColumn("passes", (F.col("place") == 1) & (F.col("gain") >= least_gain)), "board")
    won = board.where("passes").first()
    if won is None:
        return board.withColumn("final_rmse", F.lit(None).cast("double"))
    # the candidate of the winner's grid that is best over the outer folds
    choices = algorithms[won.algorithm]

    def loss(job: tuple[str, int]) -> float:
        name, k = job
        return _loss(Pipeline(stages=choices[name]).fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)), label, "regression")

    jobs = [(name, k) for name in choices for k in range(folds)] if len(choices) > 1 else []
    found: dict[str, float] = dict.fromkeys(choices, 0.0)
    for (name, _), x in zip(jobs, _each(loss, jobs)):
        found[name] += x
    name = min(choices, key=lambda c: (found[c], c))
    model = kept_model(Pipeline(stages=choices[name]).fit(data), folder(spark, "final-model"))
    final = model.transform(data).agg(rmse("prediction", label).alias("final_rmse")).withColumn("algorithm", F.lit(won.algorithm))
    return board.join(F.broadcast(final), "algorithm", "left")


def inner_scores(df: DataFrame, key: str, stages: list, folds: int, group: str, inner: int, label: str, labels: dict[int, Column], fold: str = "fold") -> DataFrame:
    """fold (the outer one), key, y, score: each outer fold's training rows, scored by models of the other inner folds, under the outer fold's label."""
    data = settled(with_inner_folds(df, group, folds, inner, fold), "inner")

    def one(job: tuple[int, int]) -> DataFrame:
        k, i = job
        rows = data.where(F.col(fold) != k).withColumn(label, labels[k].cast("double"))
        at = F.col("inner")[k]
        model = Pipeline(stages=stages).fit(rows.where(at != i))
        return model.transform(rows.where(at == i)).select(F.lit(k).alias("fold"), key, F.col(label).alias("y"), F.col("prediction").alias("score"))

    return reduce(DataFrame.unionByName, _each(one, [(k, i) for k in range(folds) for i in range(inner)]))


def nested_calibration(df: DataFrame, key: str, value: str, stages: list, folds: int, group: str, inner: int = 3, label: str = "label", q: float = 0.75) -> DataFrame:
    """fold, n, slope, intercept, threshold and, of the fold's rows: Brier score and balanced accuracy at 0.5 as scored and calibrated, and balanced accuracy
    at the frozen threshold. Calibrator and threshold come from the inner scores of the fold's training rows alone."""
    limits = {r.train_fold: r.threshold for r in f.fold_thresholds(df, value, folds, q).collect()}  # a row for each fold
    labels = {k: (F.col(value) >= t) for k, t in limits.items()}
    within = settled(inner_scores(df, key, stages, folds, group, inner, label, labels), "inner-scores")
    fits = settled(calibration.fit(calibration.score_counts(within, ["fold"]), ["fold"]), "calibrators")
    say = lambda rows: rows.join(F.broadcast(fits), "fold").withColumn("calibrated", calibration.applied(F.col("score"), F.col("slope"), F.col("intercept")))
    frozen = settled(m.operating_threshold(say(within), ["fold"], score="calibrated").select("fold", "threshold"), "thresholds")
    held = settled(say(FoldModels(df, stages, folds, label, labels).held_out(key)).join(F.broadcast(frozen), "fold"), "held-out")
    out = fits.join(frozen, "fold")
    for name, score, at in (("raw", "score", 0.5), ("calibrated", "calibrated", 0.5), ("frozen", "calibrated", F.col("threshold"))):
        c = m.confusion(held, ["fold"], at, score=score).select("fold", "n", F.col("brier").alias(f"{name}_brier"), F.col("balanced_accuracy").alias(f"{name}_balanced_accuracy"))
        out = out.join(c if name == "raw" else c.drop("n"), "fold")
    return out.drop("frozen_brier")


def noise_stress(df: DataFrame, key: str, label: str, feature: str, stages: list, folds: int, shares: tuple[float, ...], seed: str = "g14", fold: str = "fold") -> DataFrame:
    """fold, share, n, mae, noisy_mae, shift: each fold's model on its rows as they are, and with normal noise on a feature, in shares of the feature's
    deviation among the training rows; the same draw for all shares of a row."""
    models = FoldModels(df, stages, folds, label, {})
    spread = f.training_rows(df, folds, fold).groupBy("train_fold").agg(F.stddev_pop(feature).alias("__s"))
    limits = {r.train_fold: r["__s"] for r in spread.collect()}  # a row for each fold
    out = []
    for k in range(folds):
        rows = df.where(F.col(fold) == k)
        noise = f.normal(seed, F.col(key).cast("string")) * F.lit(limits[k])
        each = F.explode(F.array(*map(F.lit, (0.0, *shares))))
        told = models.models[k].transform(rows.withColumn("share", each).withColumn(feature, F.col(feature) + noise * F.col("share")))
        out.append(told.groupBy("share").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col(label))).alias("noisy_mae")).withColumn("fold", F.lit(k)))
    told = settled(reduce(DataFrame.unionByName, out), "noise")
    base = told.where("share = 0").select("fold", F.col("noisy_mae").alias("mae"))
    return told.where("share > 0").join(F.broadcast(base), "fold").select("fold", "share", "n", "mae", "noisy_mae", (F.col("noisy_mae") - F.col("mae")).alias("shift"))
