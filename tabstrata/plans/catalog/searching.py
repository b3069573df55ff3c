"""Search (T), stacking (K) and stored artifacts (S5, S6)."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstrata.functions import proba as P
from tabstrata.learners.linear import ElasticNetLogistic
from tabstrata.learners.moments import MomentLearner
from tabstrata.operators import class_weights as CW
from tabstrata.operators import encode as EN
from tabstrata.operators import metrics as ME
from tabstrata.operators.scale import StandardScaler
from tabstrata.plans import search as SR
from tabstrata.plans import space as SP
from tabstrata.plans import stack as ST
from tabstrata.plans.catalog.common import RS, R, rounded
from tabstrata.plans.catalog.encoding import A, B, MODELS_SQL, category_models
from tabstrata.plans.fixtures import CLASSES, FOLD_SQL, folded, training_frame, unit_sql
from tabstrata.plans.pipeline import Pipeline
from tabstrata.plans.registry import LAYER_ONE, LAYER_STACKING, LEARNERS
from tabstrata.runtime import Steps, drop_shuffles, materialize, scratch_path
from tabstrata.sources import artifacts
from tabstrata.sources.tables import CATEGORIES, NUMERIC

QUERIES, ORACLE = {}, {}
K, LABEL = 3, "class_encoded"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# S5, S6 ----------------------------------------------------------------------------------------------
_STORED = {
    "ridge": dict(alpha=1.0, fit_intercept=True),
    "extra_tree": dict(n_estimators=8, max_depth=5, min_samples_leaf=20, max_features=0.4, criterion="gini"),
    "trunsvd_knn": dict(n_components=3, n_neighbors=5, weights="distance", p=2, metric="minkowski"),
    "hist_gradient_boosting": dict(learning_rate=0.3, max_depth=3, min_samples_leaf=20, l2_regularization=1.0, max_bins=64),
}


@query(
    "s5_model_round_trip",
    f"with {FOLD_SQL} select unnest(['lda', {', '.join(map(repr, _STORED))}]) as model, 0e0 as max_gap, count(*) as n from f",
)
def s5(spark, sf):
    """Scores of raw rows by whole pipelines, categories included, before saving and after loading: the largest
    difference. Ridge and nearest neighbours encode and scale, extra trees encode, boosting codes categories."""
    df = training_frame(spark, sf)
    fits = {"lda": MomentLearner("lda", K).fit(df, NUMERIC, LABEL)}
    for name, params in _STORED.items():
        fits[name] = LEARNERS[name].build(params, K, NUMERIC, CATEGORIES, 3 if "boosting" in name else None).fit(df, LABEL)
    rows, steps = [], Steps(spark, "scored")  # of the scored tables one at a time is kept on disk
    for name, model in fits.items():
        again = artifacts.load_model(spark, artifacts.save_model(spark, model, scratch_path(spark, name)))
        scored = steps.write(model.score(df.select("id", *NUMERIC, *CATEGORIES), "a"))
        both = again.score(scored, "b")
        gap = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in range(K)])
        rows.append((name, *both.agg(F.max(gap), F.count(F.lit(1))).first()))
        steps.close()
        del scored, both, again
        drop_shuffles(spark)
    return rounded(spark.createDataFrame(rows, "model string, max_gap double, n long"))


@query("s6_skip_existing")
def s6(spark, sf):
    """The second call finds the first one's artifact and trains nothing."""
    df = training_frame(spark, sf)
    root = scratch_path(spark, "layer")
    rows = []
    for call in (1, 2):
        done = ST.train_layer(df, LABEL, NUMERIC, [], ["qda"], root, K, n_trials=1)
        model = artifacts.load_model(spark, done["qda"]["path"])
        loss = ME.log_loss(model.score(df, "p"), LABEL, [f"p_{c}" for c in range(K)]).first()[0]
        rows.append((call, done["qda"]["state"], float(loss)))
    return rounded(spark.createDataFrame(rows, "call int, state string, log_loss double"))


# T: one-pass scoring of a lookup model's smoothing, as a trials table ---------------------------------
_SMOOTH = SP.log_uniform("smooth", 0.1, 1e5)
_N_TRIALS = 12


def smoothing_trials(spark, sf) -> DataFrame:
    """(study, trial, smooth, fold, score): log loss per fold of the category lookup, all trials at once.

    Class counts per (category, fold) are enough to score every smoothing value: the lookup of a
    fold uses the other folds' counts, and its loss is a sum over the fold's own counts.
    """
    trials = SP.sample(spark, [_SMOOTH], "lookup", _N_TRIALS)
    df = folded(spark, sf).select("fold", LABEL, "galaxy_population")
    own = df.groupBy("galaxy_population", "fold").agg(
        F.expr("count(1) as n"), *[F.expr(f"count_if({LABEL} = {c}) as c{c}") for c in range(K)]
    )
    names = ["n"] + [f"c{c}" for c in range(K)]
    # windows over the (category, fold) counts, k_folds rows per category
    cat = Window.partitionBy("galaxy_population")
    rest = own.select("*", *[(F.sum(x).over(cat) - F.col(x)).alias(f"o_{x}") for x in names])
    per_fold = own.groupBy("fold").agg(*[F.sum(x).alias(f"f_{x}") for x in names]).collect()  # k_folds rows
    total = {x: sum(r[f"f_{x}"] for r in per_fold) for x in names}
    prior = {
        c: "case fold "
        + " ".join(
            f"when {r['fold']} then {(total[f'c{c}'] - r[f'f_c{c}']) / (total['n'] - r['f_n'])!r}D" for r in per_fold
        )
        + " end"
        for c in range(K)
    }
    entries = [
        F.struct(F.lit(r["study"]).alias("study"), F.lit(r["trial"]).alias("trial"), F.lit(r["smooth"]).alias("smooth"))
        for r in trials.collect()  # _N_TRIALS rows
    ]
    scored = rest.withColumn("t", F.explode(F.array(*entries))).select("*", "t.*")
    loss = " + ".join(
        f"c{c} * -ln(greatest(least((o_c{c} + smooth * ({prior[c]})) / (o_n + smooth), 1 - 1e-15), 1e-15))"
        for c in range(K)
    )
    return scored.groupBy("study", "trial", "smooth", "fold").agg(F.expr(f"sum({loss}) / sum(n) as score"))


def _trials_sql():
    lo, hi = math.log(0.1), math.log(1e5)
    smooth = f"exp({lo!r}e0 + {unit_sql('42|lookup|smooth', 'trial')} * {hi - lo!r}e0)"
    sums = ", ".join(f"sum(case when y = {c} then 1 else 0 end) as c{c}" for c in range(K))
    alls = ", ".join(f"sum(c{c}) as c{c}" for c in range(K))
    loss = " + ".join(
        f"own.c{c} * -ln(greatest(least(((tot.c{c} - own.c{c}) + smooth * ((pt.c{c} - pf.c{c}) * 1e0 / (pt.n - pf.n)))"
        f" / ((tot.n - own.n) + smooth), 1 - 1e-15), 1e-15))"
        for c in range(K)
    )
    return f"""{FOLD_SQL}, tr as (select trial, {smooth} as smooth from (select cast(unnest(range({_N_TRIALS})) as integer) as trial)),
      own as (select galaxy_population as cat, fold, count(*) as n, {sums} from f group by 1, 2),
      tot as (select cat, sum(n) as n, {alls} from own group by 1),
      pf as (select fold, sum(n) as n, {alls} from own group by 1),
      pt as (select sum(n) as n, {alls} from pf),
      ts as (select 'lookup' as study, trial, any_value(smooth) as smooth, own.fold, sum({loss}) / sum(own.n) as score
             from own join tot on tot.cat = own.cat join pf on pf.fold = own.fold cross join pt cross join tr group by trial, own.fold)"""


_W = [SP.log_uniform(f"weight_class_{c}", 0.05, 10.0) for c in range(K)]


def _weight_sql(c):
    lo, hi = math.log(0.05), math.log(10.0)
    return f"exp({lo!r}e0 + {unit_sql(f'42|meta|weight_class_{c}', 'trial')} * {hi - lo!r}e0) as weight_class_{c}"


@query(
    "t1_parameter_space",
    f"""with {MODELS_SQL}, tr as (select cast(unnest(range(20)) as integer) as trial),
      c as (select trial, {', '.join(_weight_sql(i) for i in range(K))},
            case when cast(floor({unit_sql('42|meta|solver', 'trial')} * 3) as integer) = 0 then 'svd'
                 when cast(floor({unit_sql('42|meta|solver', 'trial')} * 3) as integer) = 1 then 'lsqr' else 'eigen' end as solver,
            cast(16 + 16 * floor({unit_sql('42|meta|hidden', 'trial')} * 8) as integer) as hidden,
            {unit_sql('42|meta|shrinkage', 'trial')} as sh from tr),
      g as (select y, b_0, b_1, b_2, count(*) as n from m group by all),
      v as (select trial, y, n, case when b_0 * weight_class_0 >= b_1 * weight_class_1 and b_0 * weight_class_0 >= b_2 * weight_class_2 then 0
              when b_1 * weight_class_1 >= b_2 * weight_class_2 then 1 else 2 end as pred from g, c),
      rc as (select trial, y, sum(case when pred = y then n else 0 end) * 1e0 / sum(n) as recall from v group by 1, 2),
      s as (select trial, avg(recall) as balanced_accuracy from rc group by 1)
      select 'meta' as study, c.trial, {RS('weight_class_0', 'weight_class_1', 'weight_class_2')}, solver, hidden,
        {R("case when solver <> 'svd' then sh end", 'shrinkage')}, {R('balanced_accuracy', 'balanced_accuracy')}
      from c join s on s.trial = c.trial""",
)
def t1(spark, sf):
    """Sampled trials of every parameter kind, each with the balanced accuracy of its class weights."""
    space = [
        *_W,
        SP.choice("solver", "svd", "lsqr", "eigen"),
        SP.integer("hidden", 16, 128, 16),
        SP.uniform("shrinkage", 0.0, 1.0, when=("solver", ("lsqr", "eigen"))),
    ]
    trials = SP.sample(spark, space, "meta", 20)
    weights = [[r[w.name] for w in _W] for r in trials.orderBy("trial").collect()]  # 20 rows
    df = category_models(spark, sf)
    counts = CW.score_candidates(df, LABEL, B, weights, [], merge_equal=True)
    scores = ME.balanced_accuracy(counts, ["cand"]).withColumnRenamed("cand", "trial")
    return rounded(trials.join(scores, "trial").select(*trials.columns, "balanced_accuracy"))


def _lda_study(name="lda"):
    return SR.Study(name, list(LEARNERS["lda"].space), warmup=1, min_trials=2)


def _lda_objective(df):
    def build(params):
        return LEARNERS["lda"].build(params, K, NUMERIC, [])

    return SR.cv_log_loss(df, LABEL, "fold", 5, build), build


@query("t2_trial_scores")
def t2(spark, sf):
    """Every trial's fold losses, running means and state."""
    df = training_frame(spark, sf)
    study = _lda_study().run(spark, _lda_objective(df)[0], 4)
    return rounded(study.trials_table(spark).withColumn("params", F.to_json("params")))


@query(
    "t3_median_pruning",
    f"""with {_trials_sql()}, r as (select *, avg(score) over (partition by trial order by fold) as rm from ts),
      d as (select fold, median(rm) as med from r where trial < 6 group by 1),
      b as (select trial, r.fold, rm, med, min(rm) over (partition by trial order by r.fold) as best
            from r join d on d.fold = r.fold where trial >= 6)
      select trial, fold, {R('rm', 'running_mean')}, {R('med', 'median')}, fold >= 2 and best > med as pruned from b""",
)
def t3(spark, sf):
    trials = smoothing_trials(spark, sf).persist()
    cols = ["trial", "fold", "score"]
    out = SR.pruning_table(trials.where("trial < 6").select(*cols), trials.where("trial >= 6").select(*cols), 2, 5)
    return rounded(out)


@query(
    "t4_best_trial",
    f"""with {_trials_sql()}, v as (select study, trial, any_value(smooth) as smooth, avg(score) as value from ts group by 1, 2),
      q as (select *, row_number() over (order by value, trial) as place from v)
      select cast(place as integer) as place, trial, {RS('smooth', 'value')} from q""",
)
def t4(spark, sf):
    trials = smoothing_trials(spark, sf).persist()
    board = SR.leaderboard(trials).join(trials.select("trial", "smooth").distinct(), "trial")
    # a leaderboard has one row per trial
    return rounded(
        board.select(
            F.row_number().over(Window.orderBy("value", "trial")).alias("place"), "trial", "smooth", "value"
        )
    )


@query("t5_failed_trial")
def t5(spark, sf):
    """A trial whose fit raises ValueError is recorded as failed; the study goes on."""
    df = training_frame(spark, sf)
    inner, _ = _lda_objective(df)

    def objective(params):
        if params["solver"] == "eigen":
            raise ValueError("solver not offered here")
        yield from inner(params)

    study = _lda_study("failing").run(spark, objective, 4)
    table = study.trials_table(spark)
    return table.groupBy("trial", "state").agg(F.count("score").alias("n_scores"))


@query("t6_parallel_trials")
def t6(spark, sf):
    """Four trials submitted at the same time; scores equal the sequential run's."""
    df = training_frame(spark, sf)
    objective, _ = _lda_objective(df)
    study = SR.Study("lda", list(LEARNERS["lda"].space), min_trials=99)
    study.run(spark, objective, 4, parallelism=4)
    return rounded(study.trials_table(spark).select("trial", "fold", "score", "state"))


@query("t6_learning_trials")
def t6_learning(spark, sf):
    """Twelve trials of which the last four are suggested by the eight before them, two at a time."""
    df = training_frame(spark, sf)
    objective, _ = _lda_objective(df)
    study = SR.Study("lda", list(LEARNERS["lda"].space), min_trials=99, startup=8)
    study.run(spark, objective, 12, parallelism=2)
    return rounded(study.trials_table(spark).select("trial", "fold", "score", "state"))


@query("t7_refit_best")
def t7(spark, sf):
    """Best parameters refitted on all rows, saved, loaded and scored."""
    df = training_frame(spark, sf)
    objective, build = _lda_objective(df)
    study = _lda_study().run(spark, objective, 3)
    fitted = build(study.best_params).fit(df, LABEL)
    model = artifacts.load_model(spark, artifacts.save_model(spark, fitted, scratch_path(spark, "best")))
    return rounded(model.score(df, "best").select("id", *[f"best_{c}" for c in range(K)]))


def _meta_build(params):
    learner = ElasticNetLogistic(K, params["C"], params["l1_ratio"], params["class_weight"], max_iter=10)
    return Pipeline(learner, A + B)


@query("t8_joint_search")
def t8(spark, sf):
    """Meta-model and class weights searched together, then the weights alone on the best fit."""
    df = category_models(spark, sf).persist()
    space = [
        SP.log_uniform("C", 1e-5, 100.0),
        SP.uniform("l1_ratio", 0.0, 1.0),
        SP.choice("class_weight", None, "balanced"),
        *_W,
    ]
    names = [w.name for w in _W]
    study = SR.Study("joint", space, direction="maximize")
    study.run(spark, SR.joint_objective(df, LABEL, "fold", 5, _meta_build, names), 2)
    best = study.best_params
    scored = _meta_build(best).out_of_fold(df, LABEL, "fold", 5, "p").persist()
    weights, value = SR.weight_scan(scored, LABEL, [f"p_{c}" for c in range(K)], "fold", 5)
    rows = [("sampled", study.best_trial, *[float(best[n]) for n in names], study.value(study.best_trial))]
    rows.append(("scanned", study.best_trial, *weights, float(value)))
    return rounded(spark.createDataFrame(rows, "step string, trial int, w0 double, w1 double, w2 double, balanced_accuracy double"))


@query("t9_extend_study")
def t9(spark, sf):
    """Two trials, then three more: numbering and best value continue."""
    df = training_frame(spark, sf)
    objective, _ = _lda_objective(df)
    study = SR.Study("lda", list(LEARNERS["lda"].space), min_trials=99).run(spark, objective, 2)
    first = study.best_trial
    study.run(spark, objective, 3)
    table = study.trials_table(spark)
    return rounded(
        table.groupBy("trial", "state")
        .agg(F.avg("score").alias("value"))
        .withColumn("best_after_first", F.col("trial") == first)
        .withColumn("best", F.col("trial") == study.best_trial)
    )


# K -----------------------------------------------------------------------------------------------------
_REGISTRY_ROWS = [
    (n, n in LAYER_ONE, n in LAYER_STACKING, len(s.space), len(s.space_for(True)), s.warmup)
    for n, s in LEARNERS.items()
]
_REGISTRY_SQL = ", ".join(f"('{n}', {str(a).lower()}, {str(b).lower()}, {x}, {y}, {w})" for n, a, b, x, y, w in _REGISTRY_ROWS)


@query(
    "k1_registry",
    f"""with {FOLD_SQL}, v as (select fold, count(*) as n from f group by 1), z as (select cast(sum(n) as bigint) as n_rows, max(n) as n_valid from v)
      select r.*, n_rows, n_valid from (values {_REGISTRY_SQL}) r(model, layer_one, stacking, n_params, n_params_stacking, warmup), z""",
)
def k1(spark, sf):
    """Every registered learner: the layers that use it, its parameters, and the rows it would train on."""
    df = training_frame(spark, sf)
    sizes = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.max("n").alias("n_valid"))
    names = "model string, layer_one boolean, stacking boolean, n_params int, n_params_stacking int, warmup int"
    entries = [F.struct(*[F.lit(v).alias(c.split()[0]) for v, c in zip(r, names.split(", "))]) for r in _REGISTRY_ROWS]
    return sizes.select(F.explode(F.array(*entries)).alias("e"), "n_rows", "n_valid").select("e.*", "n_rows", "n_valid")


def _small(name, **limits):
    """A registered learner with a narrower search space, for a quick layer."""
    spec = LEARNERS[name]
    space = tuple(replace(p, **limits[p.name]) if p.name in limits else p for p in spec.space)
    return replace(spec, space=space)


@query("k2_train_layer")
def k2(spark, sf):
    """Tune, refit, save three learners; the second call skips all of them."""
    df = training_frame(spark, sf)
    registry = {
        "xgboost": _small("xgboost", max_depth=dict(low=2, high=3), learning_rate=dict(low=0.2, high=0.4)),
        "lda": LEARNERS["lda"],
        "qda": LEARNERS["qda"],
    }
    root = scratch_path(spark, "layer-one")
    args = (LABEL, NUMERIC, [], list(registry), root, K)
    first = ST.train_layer(df, *args, n_trials=2, cap=2, registry=registry, parallelism=1)
    second = ST.train_layer(df, *args, n_trials=2, cap=2, registry=registry)
    rows = []
    for n in registry:
        study = first[n]["study"]
        loss = float(study.value(study.best_trial))
        rows.append((n, first[n]["state"], second[n]["state"], len(study.trials), loss))
    return rounded(spark.createDataFrame(rows, "model string, first string, second string, n_trials int, best_log_loss double"))


_RELOADED = ("random_forest", "lda")


@query(
    "k2_layer_reloaded",
    f"with {FOLD_SQL} select unnest([{', '.join(map(repr, _RELOADED))}]) as model, 'skipped' as state, 0e0 as max_gap, count(*) as n from f",
)
def k2_reloaded(spark, sf):
    """A layer over raw columns with categories, trained once, found again, and scored from its artifacts: the
    largest difference to the pipelines in memory."""
    df = training_frame(spark, sf)
    small = dict(n_estimators=dict(low=4, high=6), max_depth=dict(low=4, high=5))
    registry = {n: _small(n, **(small if n == "random_forest" else {})) for n in _RELOADED}
    root = scratch_path(spark, "layer-raw")
    args = (LABEL, NUMERIC, CATEGORIES, list(registry), root, K)
    first = ST.train_layer(df, *args, n_trials=1, registry=registry, parallelism=1)
    second = ST.train_layer(df, *args, n_trials=1, registry=registry)
    rows = df.select("id", *NUMERIC, *CATEGORIES)
    parts = []
    for n in registry:
        again = artifacts.load_model(spark, second[n]["path"])
        both = again.score(materialize(first[n]["fitted"].score(rows, "a"), "scored"), "b")
        gap = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in range(K)])
        found = both.agg(F.max(gap).alias("max_gap"), F.count(F.lit(1)).alias("n"))
        parts.append(found.select(F.lit(n).alias("model"), F.lit(second[n]["state"]).alias("state"), "max_gap", "n"))
    return rounded(_union(parts))


@query(
    "k3_oof_layer_table",
    f"with {MODELS_SQL} select id, {RS(*A)}, {RS(*B)} from m",
)
def k3(spark, sf):
    """One row per training row with the out-of-fold probabilities of two closed-form lookup models."""
    return rounded(category_models(spark, sf).select("id", *A, *B))


@query("k3_oof_layer_learners")
def k3_learners(spark, sf):
    """The layer table of three learners, out of fold, on standardised features."""
    raw = training_frame(spark, sf)
    df = StandardScaler(NUMERIC).fit(raw).transform(raw).persist()
    pipes = {n: Pipeline(MomentLearner(n, K), NUMERIC) for n in ("lda", "qda")}
    pipes["sgd"] = LEARNERS["sgdclassifier"].build(
        dict(loss="log_loss", alpha=1e-3, average=True), K, NUMERIC, [], 3
    )
    return rounded(ST.oof_table(df, LABEL, pipes))


def _lookup_sql():
    cols, joins, ctes = [], [], []
    for m, col in (("la", "spectral_type"), ("lb", "galaxy_population")):
        counts = ", ".join(f"sum(case when y = {c} then 1 else 0 end) as {m}c{c}" for c in range(K))
        ctes.append(f"{m}s as (select {col}, count(*) as {m}n, {counts} from tr group by 1)")
        joins.append(f"left join {m}s on {m}s.{col} = te.{col}")
        cols += [
            R(f"coalesce(({m}c{c} + 10e0 * p{c}) / ({m}n + 10e0), p{c})", f"{m[1]}_{c}") for c in range(K)
        ]
    prior = ", ".join(f"sum(case when y = {c} then 1e0 else 0e0 end) / count(*) as p{c}" for c in range(K))
    return f"""tr as (select * from f where fold <> 4), te as (select * from f where fold = 4),
      pr as (select {prior} from tr), {', '.join(ctes)},
      lt as (select te.id, te.y, {', '.join(cols)} from te cross join pr {' '.join(joins)})"""


def _test_layer(spark, sf):
    """Layer table of the held-back part from lookups fitted on the whole training part."""
    df = folded(spark, sf).select("id", "fold", LABEL, "spectral_type", "galaxy_population").persist()
    train, test = df.where("fold <> 4"), df.where("fold = 4")
    enc = EN.TargetEncoder(["spectral_type", "galaxy_population"], K, 10.0).fit(train, LABEL)
    out = enc.transform(test)
    names = [f"{m}_{c}" for m in "ab" for c in range(K)]
    return out.select("id", *[F.col(x).alias(n) for x, n in zip(enc.names(), names)])


@query("k4_test_layer_table", f"with {FOLD_SQL}, {_lookup_sql()} select id, {RS(*A)}, {RS(*B)} from lt")
def k4(spark, sf):
    return rounded(_test_layer(spark, sf))


@query("k5_layer_chain")
def k5(spark, sf):
    """Layer one's table, written and read back, feeds layer two; log loss of every model per layer."""
    df = training_frame(spark, sf)
    one = {n: Pipeline(MomentLearner(n, K), NUMERIC) for n in ("lda", "qda")}
    keys = df.select("id", "fold", LABEL)
    first = materialize(ST.oof_table(df, LABEL, one), "layer-one").join(keys, "id").persist()
    numeric = [c for c in first.columns if c not in ("id", "fold", LABEL)]
    two = {
        "lda2": Pipeline(MomentLearner("lda", K), numeric),
        "sgd2": LEARNERS["sgdclassifier"].build(dict(loss="hinge", alpha=1e-3), K, numeric, [], 4),
    }
    second = materialize(ST.oof_table(first, LABEL, two), "layer-two").join(keys, "id").persist()
    parts = []
    for layer, frame, names in ((1, first, one), (2, second, two)):
        for n in names:
            loss = ME.log_loss(frame, LABEL, [f"{n}_{c}" for c in range(K)])
            parts.append(loss.select(F.lit(layer).alias("layer"), F.lit(n).alias("model"), "log_loss"))
    return rounded(_union(parts))


@query("k6_meta_model")
def k6(spark, sf):
    """Meta-model on stored out-of-fold probabilities, weighted argmax on every row."""
    df = materialize(category_models(spark, sf), "layer-two").persist()
    model = ElasticNetLogistic(K, C=1.0, l1_ratio=0.5, class_weight="balanced", max_iter=20).fit(df, A + B, LABEL)
    return ST.meta_predict(df, model, [1.0, 0.5, 2.0])


def _pred_sql(ws=("1", "0.5", "2")):
    s = [f"(((a_{c} + b_{c}) / 2e0) * {w}e0)" for c, w in enumerate(ws)]
    return f"case when {s[0]} >= {s[1]} and {s[0]} >= {s[2]} then 0 when {s[1]} >= {s[2]} then 1 else 2 end"


@query(
    "k6_weighted_argmax",
    f"with {MODELS_SQL} select id, {_pred_sql()} as pred from m",
)
def k6_argmax(spark, sf):
    """Weighted argmax from stored probabilities of two models, averaged."""
    df = materialize(category_models(spark, sf), "layer-two")
    mean = [(F.col(a) + F.col(b)) / 2.0 for a, b in zip(A, B)]
    return df.select("id", P.argmax(P.weighted(mean, [1.0, 0.5, 2.0])).alias("pred"))


_NAMES_SQL = "case pred when 0 then 'GALAXY' when 1 then 'QSO' else 'STAR' end"


@query(
    "k7_submission",
    f"with {FOLD_SQL}, {_lookup_sql()}, p as (select id, {_pred_sql()} as pred from lt) select id, {_NAMES_SQL} as class from p",
)
def k7(spark, sf):
    """Labelled predictions for every row of the sample, written as CSV and read back."""
    layer = _test_layer(spark, sf)
    mean = [(F.col(a) + F.col(b)) / 2.0 for a, b in zip(A, B)]
    pred = layer.select("id", P.argmax(P.weighted(mean, [1.0, 0.5, 2.0])).alias("pred"))
    sample = folded(spark, sf).where("fold = 4").select("id")
    from tabstrata.sources.tables import write_csv

    out = ST.submission(pred, sample, EN.LabelCodes(CLASSES))
    path = write_csv(out, scratch_path(spark, "submission"), ["id", "class"])
    return spark.read.schema("id long, class string").option("header", True).csv(path)


__all__ = ["CATEGORIES", "ORACLE", "QUERIES"]
