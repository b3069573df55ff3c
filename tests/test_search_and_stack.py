"""Studies: pruning, failures, parallel runs, extension; layers: skipping, chaining, submission."""

import pytest
from pyspark.sql import functions as F

from tabstrata.learners.moments import MomentLearner
from tabstrata.operators.encode import LabelCodes
from tabstrata.plans import search as SR
from tabstrata.plans import space as SP
from tabstrata.plans import stack as ST
from tabstrata.plans.pipeline import Pipeline
from tabstrata.plans.registry import LAYER_ONE, LAYER_STACKING, LEARNERS
from tabstrata.sources import tables as TB
from tabstrata.sources.tables import CATEGORIES, NUMERIC

SPACE = [SP.uniform("x", 0.0, 1.0)]


def test_median_pruning_rule(spark):
    study = SR.Study("s", SPACE, warmup=1, min_trials=2)
    study.run(spark, lambda p: [1.0, 1.0, 1.0], 2)
    study.run(spark, lambda p: [2.0, 2.0, 2.0], 1)
    study.run(spark, lambda p: [0.5, 3.0, 3.0], 1)  # its best running mean stays below the median
    states = [study.trials[t]["state"] for t in range(4)]
    assert states == ["COMPLETE", "COMPLETE", "PRUNED", "COMPLETE"]
    assert len(study.trials[2]["scores"]) == 2  # stopped at the first step after the warm-up
    table = study.trials_table(spark).where("state = 'PRUNED'")
    assert [r["running_mean"] for r in table.orderBy("fold").collect()] == [2.0, 2.0]


def test_pruning_table_agrees(spark):
    done = spark.createDataFrame([(t, f, 1.0 + t) for t in range(5) for f in range(3)], "trial int, fold int, score double")
    now = spark.createDataFrame([(9, f, s) for f, s in enumerate([2.9, 3.5, 9.0])], "trial int, fold int, score double")
    rows = SR.pruning_table(done, now, warmup=1, min_trials=5).orderBy("fold").collect()
    assert [r["median"] for r in rows] == [3.0, 3.0, 3.0]
    assert [r["pruned"] for r in rows] == [False, False, False]
    assert SR.pruning_table(done, now.withColumn("score", F.col("score") + 1), 1, 5).where("pruned").count() == 2
    assert SR.pruning_table(done, now.withColumn("score", F.col("score") + 1), 1, 6).where("pruned").count() == 0


def test_failures_are_recorded_and_other_errors_raise(spark):
    def objective(p):
        raise ValueError("no")

    study = SR.Study("s", SPACE).run(spark, objective, 2)
    assert {e["state"] for e in study.trials.values()} == {"FAIL"}
    with pytest.raises(ValueError):
        study.best_trial
    with pytest.raises(ZeroDivisionError):
        SR.Study("s", SPACE).run(spark, lambda p: [1 / 0], 1)


def test_parallel_and_extended_runs_see_the_same_trials(spark):
    def run(parts, parallelism):
        study = SR.Study("s", SPACE, direction="maximize", min_trials=99)
        for n in parts:
            study.run(spark, lambda p: [p["x"], p["x"]], n, parallelism)
        return {t: e["params"] for t, e in study.trials.items()}, study.best_trial

    assert run([6], 1) == run([2, 4], 3)


def test_registry_builds_every_learner(spark):
    assert set(LAYER_ONE) | set(LAYER_STACKING) <= set(LEARNERS) and len(LEARNERS) == 14
    for spec in LEARNERS.values():
        for stacking in (False, True):
            space = list(spec.space_for(stacking))
            for row in SP.sample(spark, space, spec.name, 3).collect():
                pipe = spec.build(SP.as_params(row, space), 3, NUMERIC, [] if stacking else CATEGORIES, 5)
                assert pipe.k == 3


def test_stacking_two_layers(spark, train, tmp_path):
    pipes = {n: Pipeline(MomentLearner(n, 3), NUMERIC) for n in ("lda", "qda")}
    one = ST.oof_table(train, "class_encoded", pipes)
    assert one.columns == ["id"] + [f"{n}_{c}" for n in pipes for c in range(3)]
    path = TB.write_parquet(one, str(tmp_path / "layer"))
    with pytest.raises(Exception, match="already exists"):
        TB.write_parquet(one, path)
    back = TB.align(TB.read_parquet(spark, path), train.select("id", "fold", "class_encoded"))
    assert back.count() == train.count()
    full = {n: p.fit(train, "class_encoded") for n, p in pipes.items()}
    test = ST.score_table(train, full)
    assert test.columns == one.columns and test.count() == train.count()
    meta = Pipeline(MomentLearner("ridge", 3), one.columns[1:]).fit(back, "class_encoded")
    pred = ST.meta_predict(test, meta, [1.0, 1.0, 1.0])
    sample = train.select("id").union(spark.createDataFrame([(-1,)], "id long"))
    out = ST.submission(pred, sample, LabelCodes(["GALAXY", "QSO", "STAR"]))
    assert out.count() == train.count() + 1
    assert out.where("class is null").count() == 1


def test_layer_is_skipped_when_done(train, tmp_path):
    args = (train, "class_encoded", NUMERIC, [], ["qda"], str(tmp_path), 3)
    assert ST.train_layer(*args, n_trials=1)["qda"]["state"] == "trained"
    assert ST.train_layer(*args, n_trials=1)["qda"]["state"] == "skipped"
