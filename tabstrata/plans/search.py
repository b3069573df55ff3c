"""Search over a trials table, at random or learning from trials, with median pruning, failures, parallel trials and refits."""

from __future__ import annotations

import statistics
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabstrata.functions import proba as P
from tabstrata.operators.class_weights import best_per_fold, grid_scores, grid_weights
from tabstrata.operators.metrics import log_loss, row_log_loss, running_mean
from tabstrata.plans import parzen
from tabstrata.plans.pipeline import Pipeline
from tabstrata.plans.space import Param, as_params, sample

TRIAL_SCHEMA = (
    "study string, trial int, params map<string,string>, fold int, score double, "
    "running_mean double, state string"
)


class Study:
    """Scores per (trial, fold). ``trials_table`` is the record; at most trials x folds rows.

    ``sampler`` is "random", or "tpe": the first ``startup`` trials at random, then those that `parzen` suggests
    from the completed and pruned trials before them. Trials that run at the same time learn from the same ones.
    """

    def __init__(
        self, name: str, space: list[Param], direction="minimize", warmup=2, min_trials=5, seed=42, sampler="tpe",
        startup=parzen.STARTUP,
    ):
        if sampler not in ("tpe", "random"):
            raise ValueError(f"unknown sampler {sampler!r}")
        self.sampler, self.startup = sampler, startup
        self.name, self.space, self.direction = name, list(space), direction
        self.warmup, self.min_trials, self.seed = warmup, min_trials, seed
        self.trials: dict[int, dict] = {}

    # reading ----------------------------------------------------------------------------------
    def trials_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for t, e in sorted(self.trials.items()):
            params = {k: str(v) for k, v in e["params"].items()}
            means = _running(e["scores"])
            for f, (s, m) in enumerate(zip(e["scores"], means)):
                rows.append((self.name, t, params, f, float(s), float(m), e["state"]))
            if not e["scores"]:
                rows.append((self.name, t, params, None, None, None, e["state"]))
        return spark.createDataFrame(rows, TRIAL_SCHEMA)

    def value(self, trial: int) -> float:
        return statistics.fmean(self.trials[trial]["scores"])

    @property
    def best_trial(self) -> int:
        done = [t for t, e in self.trials.items() if e["state"] == "COMPLETE"]
        if not done:
            raise ValueError("no trial was completed")
        sign = 1 if self.direction == "minimize" else -1
        return min(done, key=lambda t: (sign * self.value(t), t))

    @property
    def best_params(self) -> dict:
        return dict(self.trials[self.best_trial]["params"])

    # running ----------------------------------------------------------------------------------
    def _prune(self, scores: list[float]) -> bool:
        step = len(scores) - 1
        sign = 1 if self.direction == "minimize" else -1
        done = [e["scores"] for e in list(self.trials.values()) if e["state"] == "COMPLETE"]
        if step < self.warmup or len(done) < self.min_trials:
            return False
        at_step = [sign * _running(s)[step] for s in done if len(s) > step]
        return bool(at_step) and min(sign * m for m in _running(scores)) > statistics.median(at_step)

    def run(
        self,
        spark: SparkSession,
        objective: Callable[[dict], object],
        n_trials: int,
        parallelism: int = 1,
        catch: tuple = (ValueError,),
    ) -> "Study":
        """``objective(params)`` yields one score per fold. Continues after earlier trials."""
        start = max(self.trials, default=-1) + 1
        rows = sample(spark, self.space, self.name, n_trials, start, self.seed).orderBy("trial").collect()
        drawn = [(r["trial"], as_params(r, self.space)) for r in rows]

        def one(trial, params):
            if parallelism > 1:  # with FAIR scheduling every trial gets its own pool
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial}")
            entry = {"params": params, "scores": [], "state": "RUNNING"}
            self.trials[trial] = entry
            try:
                for s in objective(entry["params"]):
                    entry["scores"].append(float(s))
                    if self._prune(entry["scores"]):
                        entry["state"] = "PRUNED"
                        return
                entry["state"] = "COMPLETE"
            except catch as e:
                entry["state"], entry["error"] = "FAIL", str(e)

        # jobs of different trials share the cluster; spark.scheduler.mode=FAIR evens it out
        free = [d for d in drawn if self.sampler == "random" or d[0] < self.startup]
        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(lambda d: one(*d), free))
            later = [t for t, _ in drawn[len(free) :]]
            for at in range(0, len(later), parallelism):
                known = self.outcomes()
                some = [(t, self._suggested(t, known, dict(drawn))) for t in later[at : at + parallelism]]
                list(pool.map(lambda d: one(*d), some))
        return self

    def outcomes(self) -> list[tuple[dict, float]]:
        """(parameters, value to be small) of the trials that say something; pruned ones are worse than completed ones."""
        sign, out = 1 if self.direction == "minimize" else -1, []
        for t, e in sorted(self.trials.items()):
            if e["state"] == "COMPLETE":
                out.append((e["params"], sign * self.value(t)))
            elif e["state"] == "PRUNED":
                out.append((e["params"], float("inf")))
        return out

    def _suggested(self, trial: int, known: list, drawn: dict) -> dict:
        return parzen.suggest(self.space, known, self.name, trial, self.seed) if known else drawn[trial]


def _running(scores: list[float]) -> list[float]:
    return [statistics.fmean(scores[: i + 1]) for i in range(len(scores))]


def cv_log_loss(df: DataFrame, label: str, fold: str, k_folds: int, build: Callable[[dict], Pipeline]):
    """Objective: log loss per fold. Learners that train all folds at once get one scoring pass;
    others are fitted fold by fold, so pruning saves the remaining fits."""

    def objective(params: dict):
        pipe = build(params)
        names = [f"p_{c}" for c in range(pipe.k)]
        if pipe.parallel_folds:
            scored = pipe.out_of_fold(df, label, fold, k_folds, "p")
            losses = {r[fold]: r["log_loss"] for r in log_loss(scored, label, names, [fold]).collect()}
            yield from (losses[j] for j in range(k_folds))
        else:
            for j in range(k_folds):
                part = pipe.fold_scored(df, label, fold, j, "p")
                yield part.agg(F.avg(row_log_loss(label, names))).first()[0]

    return objective


def joint_objective(df: DataFrame, label: str, fold: str, k_folds: int, build, weight_names: list[str]):
    """Balanced accuracy per fold of a meta-model with sampled class weights."""
    from tabstrata.operators.metrics import balanced_accuracy, confusion

    def objective(params: dict):
        params = dict(params)
        weights = [params.pop(w) for w in weight_names]
        pipe = build(params)
        scored = pipe.out_of_fold(df, label, fold, k_folds, "p")
        pred = P.argmax(P.weighted([f"p_{c}" for c in range(pipe.k)], weights))
        table = balanced_accuracy(confusion(scored, label, pred, [fold]), [fold])
        by_fold = {r[fold]: r["balanced_accuracy"] for r in table.collect()}
        yield from (by_fold[j] for j in range(k_folds))

    return objective


def weight_scan(scored: DataFrame, label: str, ps: list[str], fold: str, k_folds: int) -> tuple[list[float], float]:
    """Best class weights for given out-of-fold probabilities: many weight vectors from one fit."""
    per_fold = grid_scores(scored, label, ps, fold, k_folds, "valid")
    top = (
        per_fold.groupBy("cand")
        .agg(F.avg("balanced_accuracy").alias("v"))
        .orderBy(F.round("v", 9).desc(), "cand")
        .first()
    )
    return grid_weights(top["cand"], [[1.0] * len(ps)], 4, 1.0), top["v"]


# the same rules on stored tables ------------------------------------------------------------------
def pruning_table(finished: DataFrame, running: DataFrame, warmup: int = 2, min_trials: int = 5) -> DataFrame:
    """(trial, fold, running_mean, median, pruned) for running trials against finished ones.

    Both inputs hold (trial, fold, score). A step is pruned when the best running mean so far is
    worse than the median of the finished trials' running means at that step.
    """
    done = running_mean(finished, ["trial"])
    medians = done.groupBy("fold").agg(
        F.percentile("running_mean", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n_finished")
    )
    now = running_mean(running, ["trial"])
    so_far = Window.partitionBy("trial").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return (
        now.withColumn("best", F.min("running_mean").over(so_far))
        .join(medians, "fold")
        .select(
            "trial",
            "fold",
            "running_mean",
            "median",
            (
                (F.col("fold") >= warmup) & (F.col("n_finished") >= min_trials) & (F.col("best") > F.col("median"))
            ).alias("pruned"),
        )
    )


def leaderboard(trials: DataFrame, direction: str = "minimize", k_folds: int = 5) -> DataFrame:
    """(trial, value) of completed trials, best first."""
    done = trials.groupBy("trial").agg(F.avg("score").alias("value"), F.count("score").alias("n"))
    order = F.col("value") if direction == "minimize" else F.desc("value")
    return done.where(F.col("n") == k_folds).select("trial", "value").orderBy(order, "trial")
