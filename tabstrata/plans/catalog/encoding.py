"""Encoders (X), folds (V), probability operators (C) and metrics (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabstrata.functions import proba as P
from tabstrata.functions.hashing import unit_hash
from tabstrata.operators import class_weights as CW
from tabstrata.operators import encode as EN
from tabstrata.operators import folds as FO
from tabstrata.operators import isotonic as IS
from tabstrata.operators import metrics as ME
from tabstrata.operators import scale as SC
from tabstrata.plans.catalog.common import RS, R, rounded
from tabstrata.plans.fixtures import (
    CLASSES,
    FOLD_SQL,
    LAB_SQL,
    OBS_SQL,
    fold_sql,
    folded,
    labelled,
    observations,
    table,
    unit_sql,
)

QUERIES, ORACLE = {}, {}
K = 3


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# X: labels and categories -------------------------------------------------------------------------
@query(
    "x1_label_encode",
    f"with {OBS_SQL}, c as (select noise_class, row_number() over (order by noise_class) - 1 as code "
    "from (select distinct noise_class from obs)) "
    "select id, o.noise_class, cast(code as integer) as class_encoded from obs o join c on c.noise_class = o.noise_class",
)
def x1(spark, sf):
    df = observations(spark, sf).select("id", "noise_class")
    return EN.LabelCodes.fit(df, "noise_class").encode(df, "noise_class")


@query("x2_label_decode", f"with {LAB_SQL} select id, y as class_encoded, signal_class as class from lab")
def x2(spark, sf):
    return EN.LabelCodes(CLASSES).decode(labelled(spark, sf).select("id", "class_encoded"), "class_encoded")


# train = folds 0..3; a category of the test part absent from train gets the reserved code
@query(
    "x3_category_codes",
    """with d as (select *, cast((row_number() over (order by md5('42|' || cast(event_id as varchar)), event_id) - 1) % 5
          as integer) as fold, user_id % 7 as grp from events),
      c as (select user_id, row_number() over (order by count(*) desc, cast(user_id as varchar)) - 1 as code
            from d where fold <> 4 group by user_id)
      select event_id, fold, d.user_id, cast(coalesce(code, (select count(*) from c)) as integer) as user_code
      from d left join c on c.user_id = d.user_id""",
)
def x3(spark, sf):
    events = FO.plain_folds(table(spark, sf, "events").select("event_id", "user_id"), "event_id")
    events = events.withColumn("u", F.col("user_id").cast("string"))
    codes = EN.CategoryCodes.fit(events.where("fold <> 4"), "u")
    return codes.encode(events, "user_code").select("event_id", "fold", "user_id", "user_code")


def _counts_sql(prefix=""):
    return ", ".join(f"sum(case when y = {c} then 1 else 0 end) as {prefix}c{c}" for c in range(K))


def te_cte(col: str, name: str, source: str = "f", smooth="10e0") -> str:
    """CTE ``name``: (category, fold) -> te_0.. from the rows of the other folds."""
    parts = ", ".join(f"sum(case when y = {c} and {source}.fold <> k.fold then 1 else 0 end) as c{c}" for c in range(K))
    if smooth == "auto":
        def enc(c):
            prior = f"(c{c}_t * 1e0 / n_t)"
            s = f"((c{c} * 1e0 / n) * (1 - c{c} * 1e0 / n) / ({prior} * (1 - {prior})))"
            return f"case when n = 0 then {prior} else (c{c} + {s} * {prior}) / (n + {s}) end"
    else:
        def enc(c):
            return f"(c{c} + {smooth} * (c{c}_t * 1e0 / n_t)) / (n + {smooth})"
    return f"""{name} as (
      with k as (select distinct fold from {source}),
      s as (select {col}, k.fold, sum(case when {source}.fold <> k.fold then 1 else 0 end) as n, {parts}
            from {source}, k group by 1, 2),
      t as (select k.fold, count(*) as n_t, {', '.join(f'sum(case when y = {c} then 1 else 0 end) as c{c}_t' for c in range(K))}
            from {source}, k where {source}.fold <> k.fold group by 1)
      select {col}, s.fold, {', '.join(f'{enc(c)} as te_{c}' for c in range(K))} from s join t on t.fold = s.fold)"""


_TE = [(c, f"{c}_te") for c in ("spectral_type", "galaxy_population")]


def _x4_sql(smooth):
    ctes = ", ".join(te_cte(col, name, smooth=smooth) for col, name in _TE)
    cols = ", ".join(R(f"{n}.te_{c}", f"{col}_te_{c}") for col, n in _TE for c in range(K))
    joins = " ".join(f"join {n} on {n}.{col} = f.{col} and {n}.fold = f.fold" for col, n in _TE)
    return f"with {FOLD_SQL}, {ctes} select f.id, f.fold, {cols} from f {joins}"


def _x4(spark, sf, smooth):
    df = folded(spark, sf).select("id", "fold", "class_encoded", *[c for c, _ in _TE]).persist()
    enc = EN.TargetEncoder([c for c, _ in _TE], K, smooth)
    return rounded(enc.fit_transform(df, "class_encoded", "fold", 5).select("id", "fold", *enc.names()))


@query("x4_target_encoding", _x4_sql("10e0"))
def x4(spark, sf):
    return _x4(spark, sf, 10.0)


@query("x4_target_encoding_auto", _x4_sql("auto"))
def x4_auto(spark, sf):
    return _x4(spark, sf, "auto")


@query(
    "x4_target_encoding_new_rows",
    f"""with {FOLD_SQL}, t as (select count(*) as n_t, {_counts_sql()} from f where fold <> 4),
      s as (select spectral_type, count(*) as n, {_counts_sql('s')} from f where fold <> 4 group by 1)
      select f.id, {', '.join(R(f'coalesce((sc{c} + 10e0 * c{c} / n_t) / (n + 10e0), c{c} * 1e0 / n_t)', f'spectral_type_te_{c}') for c in range(K))}
      from f cross join t left join s on s.spectral_type = f.spectral_type where fold = 4""",
)
def x4_new(spark, sf):
    df = folded(spark, sf).select("id", "fold", "class_encoded", "spectral_type")
    enc = EN.TargetEncoder(["spectral_type"], K, 10.0).fit(df.where("fold <> 4"), "class_encoded")
    return rounded(enc.transform(df.where("fold = 4")).select("id", *enc.names()))


def _x5_sql(expr):
    return f"""with {LAB_SQL}, p as (select avg(y) as prior from lab),
      s as (select galaxy_population, count(*) as n, avg(y) as m from lab group by 1)
      select id, {R(expr, 'galaxy_population_mean')} from lab join s using (galaxy_population) cross join p"""


def _x5(spark, sf, **kw):
    df = labelled(spark, sf).select("id", "class_encoded", "galaxy_population")
    enc = EN.MeanTargetEncoder(["galaxy_population"], **kw).fit(df, "class_encoded")
    return rounded(enc.transform(df).select("id", "galaxy_population_mean"))


@query("x5_mean_target_encoding", _x5_sql("(n * m + 10e0 * prior) / (n + 10e0)"))
def x5(spark, sf):
    return _x5(spark, sf, smoothing=10.0)


_W = "(1e0 / (1e0 + exp(-(n - 20e0) / 10e0)))"


@query("x5_mean_target_encoding_sigmoid", _x5_sql(f"case when n = 1 then prior else prior * (1 - {_W}) + m * {_W} end"))
def x5_sigmoid(spark, sf):
    return _x5(spark, sf, smoothing=10.0, blend="sigmoid")


_STD, _ROB = ["alpha", "delta"], ["u", "g", "r", "i", "z", "redshift"]


def _std_sql(c):
    return f"({c} - (select avg({c}) from obs)) / (select stddev_pop({c}) from obs)"


@query("x6_standard_scale", f"with {OBS_SQL} select id, {', '.join(R(_std_sql(c), f'{c}_std') for c in _STD)} from obs")
def x6(spark, sf):
    df = observations(spark, sf).select("id", *_STD)
    out = SC.StandardScaler(_STD, out="{col}_std").fit(df).transform(df)
    return rounded(out.select("id", *[f"{c}_std" for c in _STD]))


def _rob_ctes(source):
    return "q as (select " + ", ".join(
        f"median({c}) as {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as {c}_w" for c in _ROB
    ) + f" from {source})"


@query(
    "x7_robust_scale",
    f"with {OBS_SQL}, {_rob_ctes('obs')} select id, {', '.join(R(f'({c} - {c}_m) / {c}_w', f'{c}_rob') for c in _ROB)} from obs, q",
)
def x7(spark, sf):
    df = observations(spark, sf).select("id", *_ROB)
    out = SC.RobustScaler(_ROB, out="{col}_rob").fit(df).transform(df)
    return rounded(out.select("id", *[f"{c}_rob" for c in _ROB]))


def _x8_sql():
    ctes = ", ".join(te_cte(col, name, smooth="auto") for col, name in _TE)
    te = ", ".join(R(f"{n}.te_{c}", f"{col}_te_{c}") for col, n in _TE for c in range(K))
    std = ", ".join(R(_std_sql(c), f"x_{c}") for c in _STD)
    rob = ", ".join(R(f"({c} - {c}_m) / {c}_w", f"x_{c}") for c in _ROB)
    joins = " ".join(f"join {n} on {n}.{col} = f.{col} and {n}.fold = f.fold" for col, n in _TE)
    return f"with {FOLD_SQL}, {ctes}, {_rob_ctes('f')} select f.id, {te}, {std}, {rob} from f {joins} cross join q"


@query("x8_column_composition", _x8_sql())
def x8(spark, sf):
    df = folded(spark, sf).select("id", "fold", "class_encoded", *[c for c, _ in _TE], *_STD, *_ROB).persist()
    comp = SC.ColumnComposer([c for c, _ in _TE], _STD, _ROB, K)
    out = comp.fit_transform(df, "class_encoded", "fold", 5)
    return rounded(
        out.select("id", *comp.encoder.names(), *[F.col(c).alias(f"x_{c}") for c in _STD + _ROB])
    )


_GRAM = ["u", "g", "r", "z"]
_GRAM_SQL = " union all ".join(
    f"select {i} as i, {j} as j, {R(f'sum({_GRAM[i]} * {_GRAM[j]})', 'value', 4)} from obs"
    for i in range(4)
    for j in range(i, 4)
)


@query("x9_gram_matrix", f"with {OBS_SQL} {_GRAM_SQL}")
def x9_gram(spark, sf):
    return SC.gram_entries(observations(spark, sf), _GRAM).select("i", "j", (F.round("value", 4) + 0.0).alias("value"))


@query("x9_truncated_svd")
def x9(spark, sf):
    df = observations(spark, sf).select("id", *_STD, *_ROB).persist()
    svd = SC.TruncatedSVD(_STD + _ROB, 3).fit(df)
    return rounded(svd.transform(df).select("id", *svd.names), 4)


@query(
    "x9_svd_two_columns",
    f"""with {OBS_SQL}, s as (select sum(u * u) as a, sum(u * redshift) as b, sum(redshift * redshift) as c from obs),
      l as (select *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as top,
                      (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as low from s),
      w as (select top, low, b / sqrt(b * b + (top - a) * (top - a)) as x, (top - a) / sqrt(b * b + (top - a) * (top - a)) as y from l),
      v as (select *, case when abs(x) >= abs(y) then sign(x) else sign(y) end as s1, case when abs(y) >= abs(x) then sign(-y) else sign(x) end as s2 from w)
      select id, {R('s1 * (u * x + redshift * y)', 'svd_0', 4)}, {R('s2 * (redshift * x - u * y)', 'svd_1', 4)},
             {R('sqrt(top)', 'singular_0', 4)}, {R('sqrt(low)', 'singular_1', 4)} from obs, v""",
)
def x9_two(spark, sf):
    """Both components of two columns, whose vectors have a closed form."""
    df = observations(spark, sf).select("id", "u", "redshift").persist()
    svd = SC.TruncatedSVD(["u", "redshift"], 2).fit(df)
    values = [F.lit(float(s)).alias(f"singular_{i}") for i, s in enumerate(svd.singular_values_)]
    return rounded(svd.transform(df).select("id", *svd.names, *values), 4)


@query("x9_wide_svd")
def x9_wide(spark, sf):
    """Three components of the embeddings' elements, found without their Gram matrix."""
    elements = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)]
    df = table(spark, sf, "embeddings").where(F.size("embedding") >= 64).select("vec_id", *elements).persist()
    svd = SC.TruncatedSVD([f"e{i}" for i in range(64)], 3).fit(df)
    return rounded(svd.transform(df).select("vec_id", *svd.names), 4)


@query(
    "x10_class_weights",
    f"""with d as (select doc_id, quality from labels where quality is not null),
      n as (select quality, count(*) as nk from d group by 1),
      t as (select sum(nk) as n, count(*) as k, max(nk) as top from n)
      select doc_id, d.quality, {R('n * 1e0 / (k * nk)', 'balanced')}, {R('top * 1e0 / nk', 'max_ratio')},
             {R('sqrt(top * 1e0 / nk)', 'sqrt_ratio')} from d join n on n.quality = d.quality cross join t""",
)
def x10(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", "quality").where(F.col("quality").isNotNull())
    counts = {r["quality"]: r["n"] for r in df.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    cols = [
        EN.weight_column(EN.weights_from_counts(counts, m), "quality").alias(m)
        for m in ("balanced", "max_ratio", "sqrt_ratio")
    ]
    return rounded(df.select("doc_id", "quality", *cols))


# V ------------------------------------------------------------------------------------------------
@query("v1_stratified_folds", f"with {FOLD_SQL} select id, y as class_encoded, fold from f")
def v1(spark, sf):
    return folded(spark, sf).select("id", "class_encoded", "fold")


@query("v2_plain_folds", "with f as (" + fold_sql("(select event_id as id from events)", strata=None) + ") select id as event_id, fold from f")
def v2(spark, sf):
    return FO.plain_folds(table(spark, sf, "events").select("event_id"), "event_id")


@query("v2_hashed_folds", f"select event_id, cast(floor({unit_sql('42', 'event_id')} * 5) as integer) as fold from events")
def v2_hashed(spark, sf):
    return FO.hashed_folds(table(spark, sf, "events").select("event_id"), "event_id")


@query(
    "v3_fold_fan_out",
    f"""with {FOLD_SQL}, k as (select cast(unnest(range(5)) as integer) as outer_fold)
      select outer_fold, case when fold = outer_fold then 'valid' else 'train' end as role, y as class_encoded,
             count(*) as n, {R('avg(redshift)', 'mean_redshift')} from f, k group by 1, 2, 3""",
)
def v3(spark, sf):
    pairs = FO.fan_out(folded(spark, sf).select("id", "class_encoded", "redshift", "fold"), 5)
    return rounded(
        pairs.groupBy("outer_fold", "role", "class_encoded").agg(
            F.count(F.lit(1)).alias("n"), F.avg("redshift").alias("mean_redshift")
        )
    )


@query("v4_holdout_split", f"with {OBS_SQL} select id, {unit_sql('42|holdout', 'id')} < 0.1e0 as is_holdout from obs")
def v4(spark, sf):
    return observations(spark, sf).select("id", FO.holdout_flag("id", 0.1, 42).alias("is_holdout"))


@query(
    "v7_nested_folds",
    f"""with {FOLD_SQL}, k as (select cast(unnest(range(5)) as integer) as outer_fold),
      t as (select outer_fold, id, y from f, k where fold <> outer_fold)
      select outer_fold, id, cast((row_number() over (partition by outer_fold, y
        order by md5('43|' || cast(id as varchar)), id) - 1) % 3 as integer) as inner_fold from t""",
)
def v7(spark, sf):
    df = folded(spark, sf).select("id", "class_encoded", "fold")
    return FO.nested_folds(df, k_inner=3).select("outer_fold", "id", "inner_fold")


# C and G: on the cross-fitted category probabilities, base models a and b --------------------------
def category_models(spark, sf):
    """id, fold, class_encoded and the out-of-fold probabilities of two category lookups a_k, b_k."""
    df = folded(spark, sf).select("id", "fold", "class_encoded", *[c for c, _ in _TE]).persist()
    enc = EN.TargetEncoder([c for c, _ in _TE], K, 10.0)
    out = enc.fit_transform(df, "class_encoded", "fold", 5)
    renamed = [
        F.col(f"{col}_te_{c}").alias(f"{m}_{c}") for (col, _), m in zip(_TE, "ab") for c in range(K)
    ]
    return out.select("id", "fold", "class_encoded", *renamed)


MODELS_SQL = (
    FOLD_SQL
    + ", "
    + ", ".join(te_cte(col, name) for col, name in _TE)
    + ", m as (select f.id, f.fold, f.y, "
    + ", ".join(f"{n}.te_{c} as {m}_{c}" for (_, n), m in zip(_TE, "ab") for c in range(K))
    + " from f "
    + " ".join(f"join {n} on {n}.{col} = f.{col} and {n}.fold = f.fold" for col, n in _TE)
    + ")"
)

A, B = [f"a_{c}" for c in range(K)], [f"b_{c}" for c in range(K)]
# margins with a different scale per class, exact in both engines
_MARGIN = {0: "u - 3 * g", 1: "r - i", 2: "2 * z - 10"}


def _margins(spark, sf):
    cols = [F.expr(e).cast("double").alias(f"m_{k}") for k, e in _MARGIN.items()]
    return observations(spark, sf).select("id", *cols)


_MARGIN_SQL = OBS_SQL + ", m as (select id, " + ", ".join(f"{e} as m_{k}" for k, e in _MARGIN.items()) + " from obs)"
_EXPS = [f"exp(m_{k} - greatest(m_0, m_1, m_2))" for k in range(K)]


@query(
    "c2_softmax",
    f"with {_MARGIN_SQL} select id, " + ", ".join(R(f"{e} / ({' + '.join(_EXPS)})", f"p_{k}") for k, e in enumerate(_EXPS)) + " from m",
)
def c2(spark, sf):
    return rounded(_margins(spark, sf).select("id", *P.named(P.softmax(["m_0", "m_1", "m_2"]), "p")))


@query("c3_binary_margin", f"with {_MARGIN_SQL} select id, {R('1 - m_1', 'd_0')}, {R('m_1', 'd_1')} from m")
def c3(spark, sf):
    return rounded(_margins(spark, sf).select("id", *P.named(P.binary_columns("m_1"), "d")))


@query("c4_clip", f"with {_MARGIN_SQL} select id, greatest(least(m_1 / 64e0, 1 - 1e-15), 1e-15) as p from m")
def c4(spark, sf):
    return _margins(spark, sf).select("id", P.clip(F.col("m_1") / 64.0).alias("p"))


_BAD = "case when id % 5 = 0 then cast('nan' as double) when id % 5 = 1 then cast('inf' as double) when id % 5 = 2 then cast('-inf' as double) else m_1 end"


@query(
    "c5_replace_non_finite",
    f"""with {_MARGIN_SQL}, b as (select id, {_BAD} as p from m) select id, case when isnan(p) then 1e-15
        when p = cast('inf' as double) then 1 - 1e-15 when p = cast('-inf' as double) then 1e-15 else p end as p from b""",
)
def c5(spark, sf):
    return _margins(spark, sf).selectExpr("id", f"{_BAD} as p").select("id", P.replace_non_finite("p").alias("p"))


_CW = [1.0, 0.5, 2.0]


@query("c7_weighted", f"with {MODELS_SQL} select id, {', '.join(R(f'{b} * {w}e0', f'w_{k}') for k, (b, w) in enumerate(zip(B, ['1', '0.5', '2'])))} from m")
def c7(spark, sf):
    return rounded(category_models(spark, sf).select("id", *P.named(P.weighted(B, _CW), "w")))


@query(
    "c8_argmax",
    f"with {_MARGIN_SQL} select id, case when m_0 >= m_1 and m_0 >= m_2 then 0 when m_1 >= m_2 then 1 else 2 end as pred from m",
)
def c8(spark, sf):
    return _margins(spark, sf).select("id", P.argmax(["m_0", "m_1", "m_2"]).alias("pred"))


@query(
    "c9_renormalize",
    f"with {_MARGIN_SQL}, s as (select *, m_0 + m_1 + m_2 as s from m) select id, "
    + ", ".join(R(f"m_{k} / case when s = 0 then 1 else s end", f"p_{k}") for k in range(K))
    + " from s",
)
def c9(spark, sf):
    return rounded(_margins(spark, sf).select("id", *P.named(P.renormalize(["m_0", "m_1", "m_2"]), "p")))


_GRID = CW.log_grid(K)
_CAND_SQL = "c(cand, w0, w1, w2) as (values " + ", ".join(f"({i}, {', '.join(f'{x!r}e0' for x in w)})" for i, w in enumerate(_GRID)) + ")"


def _score_sql(ps, fold_filter="v.fold <> k.fold"):
    w = [f"{p} * w{i}" for i, p in enumerate(ps)]
    return f"""g as (select fold, y, {', '.join(ps)}, count(*) as n from m group by all),
      k as (select distinct fold from m),
      v as (select fold, y, cand, n, case when {w[0]} >= {w[1]} and {w[0]} >= {w[2]} then 0
              when {w[1]} >= {w[2]} then 1 else 2 end as pred from g, c),
      rc as (select k.fold as outer_fold, cand, y, sum(case when pred = y then n else 0 end) * 1e0 / sum(n) as recall
            from v, k where {fold_filter} group by 1, 2, 3),
      s as (select outer_fold, cand, avg(recall) as balanced_accuracy from rc group by 1, 2)"""


_BEST_SQL = (
    "t as (select *, row_number() over (partition by outer_fold order by round(balanced_accuracy, 9) desc, cand) as rn from s)"
)


@query(
    "c10_class_weight_search",
    f"with {MODELS_SQL}, {_CAND_SQL}, {_score_sql(B)}, {_BEST_SQL} select outer_fold, t.cand, {RS('w0', 'w1', 'w2')}, "
    f"{R('balanced_accuracy', 'balanced_accuracy')} from t join c on c.cand = t.cand where rn = 1",
)
def c10(spark, sf):
    df = category_models(spark, sf)
    best = CW.best_per_fold(CW.grid_scores(df, "class_encoded", B, "fold", 5, "train"))
    w = F.element_at(CW.candidate_array(_GRID), F.col("cand") + 1)
    return rounded(
        best.select("outer_fold", "cand", *[w[f"w{i}"].alias(f"w{i}") for i in range(K)], "balanced_accuracy")
    )


@query("c10_class_weight_fit")
def c10_fit(spark, sf):
    df = category_models(spark, sf)
    fit = CW.fit_class_weights(df, "class_encoded", B)
    scored = ME.balanced_accuracy(ME.confusion(df, "class_encoded", fit.predict(B)))
    plain = ME.balanced_accuracy(ME.confusion(df, "class_encoded", P.argmax(B)), out="unweighted")
    one = scored.withColumn("unweighted", plain.scalar())
    return rounded(one.select(*[F.lit(w).alias(f"w{i}") for i, w in enumerate(fit.weights)], "balanced_accuracy", "unweighted"))


def _weighted_cols(ps, ws):
    return [f"({p} * {w}e0)" for p, w in zip(ps, ws)]


_WB = _weighted_cols(B, ["1", "0.5", "2"])


@query(
    "c11_weighted_predict",
    f"with {MODELS_SQL} select id, case when {_WB[0]} >= {_WB[1]} and {_WB[0]} >= {_WB[2]} then 0 when {_WB[1]} >= {_WB[2]} then 1 else 2 end as pred, "
    + ", ".join(R(f"{w} / ({' + '.join(_WB)})", f"p_{k}") for k, w in enumerate(_WB))
    + " from m",
)
def c11(spark, sf):
    fit = CW.ClassWeights(_CW)
    df = category_models(spark, sf)
    return rounded(df.select("id", fit.predict(B).alias("pred"), *P.named(fit.predict_proba(B), "p")))


def _ovr_sql(raw):
    s = " + ".join(raw)
    return ", ".join(R(f"case when {s} = 0 then 1e0 / 3 else {r} / ({s}) end", f"{{n}}_{k}") for k, r in enumerate(raw))


_SIG = [f"(1e0 / (1e0 + exp(-m_{k} / 16e0)))" for k in range(K)]
_HUB = [f"((least(greatest(m_{k} / 16e0, -1e0), 1e0) + 1e0) / 2e0)" for k in range(K)]


@query(
    "c12_ovr_probabilities",
    f"with {_MARGIN_SQL} select id, {_ovr_sql(_SIG).format(n='log')}, "
    + ", ".join(
        R(f"case when {' + '.join(_HUB)} = 0 then 1e0 / 3e0 else {h} / case when {' + '.join(_HUB)} = 0 then 1e0 else {' + '.join(_HUB)} end end", f"huber_{k}")
        for k, h in enumerate(_HUB)
    )
    + " from m",
)
def c12(spark, sf):
    m = [F.col(f"m_{k}") / 16.0 for k in range(K)]
    return rounded(
        _margins(spark, sf).select(
            "id",
            *P.named(P.ovr_probabilities(m, "log_loss"), "log"),
            *P.named(P.ovr_probabilities(m, "modified_huber"), "huber"),
        )
    )


# isotonic fit of the class indicators on the quantity sum, all (fold, class) pairs at once; u takes
# at most a few hundred values, which keeps the quadratic max-min formula of the SQL side feasible
@query(
    "c6_isotonic_blocks",
    f"""with {FOLD_SQL}, k as (select cast(unnest(range(3)) as integer) as cls),
      s as (select fold, cls, u as score, sum(case when y = cls then 1 else 0 end) as t, count(*) as n from f, k group by 1, 2, 3),
      p as (select *, sum(t) over w as ct, sum(n) over w as cn from s window w as (partition by fold, cls order by score)),
      iv as (select a.fold, a.cls, a.score as lo, b.score as hi, (b.ct - a.ct + a.t) * 1e0 / (b.cn - a.cn + a.n) as m
             from p a join p b on a.fold = b.fold and a.cls = b.cls and a.score <= b.score),
      mn as (select fold, cls, lo, hi, min(m) over (partition by fold, cls, lo order by hi rows between current row and unbounded following) as mi from iv),
      fit as (select fold, cls, hi as score, max(mi) as value from mn group by 1, 2, 3)
      select fold, cls, {R('score', 'score')}, {R('value', 'value')} from fit""",
)
def c6(spark, sf):
    df = folded(spark, sf).select("fold", "u", "class_encoded").persist()
    long = df.select(
        "fold",
        "u",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("cls"), (F.col("class_encoded") == c).cast("int").alias("hit")) for c in range(K)])
        ).alias("e"),
    ).select("fold", "e.cls", "u", "e.hit")
    blocks = IS.isotonic_blocks(long, ["fold", "cls"], "u", "hit")
    scores = long.select("fold", "cls", F.col("u").alias("score")).distinct()
    b = blocks.withColumnsRenamed({"fold": "bf", "cls": "bc"})
    cond = (
        (F.col("fold") == F.col("bf")) & (F.col("cls") == F.col("bc")) & F.col("score").between(F.col("lo"), F.col("hi"))
    )
    return rounded(scores.join(b, cond).select("fold", "cls", "score", "value"))


# G ------------------------------------------------------------------------------------------------
def _nll(ps):
    return "avg(-ln(greatest(least(case y when 0 then {} when 1 then {} else {} end, 1 - 1e-15), 1e-15)))".format(*ps)


@query(
    "g1_log_loss",
    f"with {MODELS_SQL} select 'a' as model, fold, {R(_nll(A), 'log_loss')} from m group by fold "
    f"union all select 'b', fold, {R(_nll(B), 'log_loss')} from m group by fold",
)
def g1(spark, sf):
    df = category_models(spark, sf)
    both = df.groupBy("fold").agg(
        *[F.avg(ME.row_log_loss("class_encoded", ps)).alias(m) for m, ps in (("a", A), ("b", B))]
    )
    long = both.unpivot("fold", ["a", "b"], "model", "log_loss")
    return rounded(long.select("model", "fold", "log_loss"))


def _argmax_sql(ps):
    return f"case when {ps[0]} >= {ps[1]} and {ps[0]} >= {ps[2]} then 0 when {ps[1]} >= {ps[2]} then 1 else 2 end"


@query(
    "g2_balanced_accuracy",
    f"""with {MODELS_SQL}, r as (select fold, y, avg(case when {_argmax_sql(B)} = y then 1e0 else 0e0 end) as recall from m group by 1, 2)
      select fold, {R('avg(recall)', 'balanced_accuracy')} from r group by 1""",
)
def g2(spark, sf):
    counts = ME.confusion(category_models(spark, sf), "class_encoded", P.argmax(B), ["fold"])
    return rounded(ME.balanced_accuracy(counts, ["fold"]))


@query("g4_confusion", f"with {MODELS_SQL} select y, {_argmax_sql(B)} as pred, count(*) as n from m group by 1, 2")
def g4(spark, sf):
    return ME.confusion(category_models(spark, sf), "class_encoded", P.argmax(B))


@query(
    "g5_running_mean",
    f"""with {MODELS_SQL}, s as (select fold, {_nll(B)} as score from m group by fold)
      select fold, {R('score', 'score')}, {R('avg(score) over (order by fold rows unbounded preceding)', 'running_mean')} from s""",
)
def g5(spark, sf):
    losses = ME.log_loss(category_models(spark, sf), "class_encoded", B, ["fold"], "score")
    return rounded(ME.running_mean(losses.withColumn("trial", F.lit(0)), ["trial"]).drop("trial"))


# the first complete chain: folds, base models, layer table, weights, metric, best candidate --------
_AVG = [f"((a_{c} + b_{c}) / 2e0)" for c in range(K)]


@query(
    "slice0_stacked_weighting",
    f"""with {MODELS_SQL.replace(', m as (', ', m0 as (')}, m as (select id, fold, y, {', '.join(f'{a} as s_{c}' for c, a in enumerate(_AVG))} from m0),
      {_CAND_SQL}, {_score_sql(['s_0', 's_1', 's_2'], 'v.fold = k.fold')},
      a as (select cand, avg(balanced_accuracy) as balanced_accuracy from s group by 1)
      select a.cand, {RS('w0', 'w1', 'w2')}, {R('balanced_accuracy', 'balanced_accuracy')} from a join c on c.cand = a.cand""",
)
def slice0(spark, sf):
    """All class-weight candidates of the grid for the averaged out-of-fold probabilities of two models."""
    layer = category_models(spark, sf)
    mean = layer.select(
        "id", "fold", "class_encoded", *[((F.col(a) + F.col(b)) / 2.0).alias(f"s_{c}") for c, (a, b) in enumerate(zip(A, B))]
    )
    per_fold = CW.grid_scores(mean, "class_encoded", ["s_0", "s_1", "s_2"], "fold", 5, "valid")
    scores = per_fold.groupBy("cand").agg(F.avg("balanced_accuracy").alias("balanced_accuracy"))
    w = F.element_at(CW.candidate_array(_GRID), F.col("cand") + 1)
    return rounded(scores.select("cand", *[w[f"w{i}"].alias(f"w{i}") for i in range(K)], "balanced_accuracy"))


__all__ = ["CLASSES", "QUERIES", "ORACLE", "category_models", "MODELS_SQL", "unit_hash"]
