"""Sources and sinks (S), selection (P), profiling (E) and feature engineering (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabstrata.operators import features as FE
from tabstrata.operators import profile as PR
from tabstrata.operators import selection as SE
from tabstrata.plans.catalog.common import RS, R, rounded
from tabstrata.plans.fixtures import CLASSES, FOLD_SQL, LAB_SQL, OBS_SQL, folded, labelled, observations, table
from tabstrata.runtime import scratch_path
from tabstrata.sources import tables as TB
from tabstrata.sources.tables import CATEGORIES, NUMERIC

QUERIES, ORACLE = {}, {}
FEATURES = NUMERIC + CATEGORIES


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def _feature_list():
    return ", ".join(FEATURES)


# S ------------------------------------------------------------------------------------------------
_RAW_SQL = f"with {OBS_SQL} select id, {RS(*NUMERIC)}, {', '.join(CATEGORIES)}, signal_class as class from obs"


def _raw(spark, sf):
    return observations(spark, sf).select("id", *FEATURES, F.col("signal_class").alias("class"))


@query("s1_csv_scan", _RAW_SQL)
def s1(spark, sf):
    path = TB.write_csv(_raw(spark, sf), scratch_path(spark, "train-csv"))
    return rounded(TB.read_csv(spark, path, TB.observation_schema(), "id"))


@query("s2_csv_sink", f"with {OBS_SQL} select id, signal_class as class from obs")
def s2(spark, sf):
    path = TB.write_csv(_raw(spark, sf), scratch_path(spark, "submission-csv"), ["id", "class"])
    return spark.read.schema("id long, class string").option("header", True).csv(path)


@query(
    "s3_parquet_scan",
    "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where l_quantity >= 25",
)
def s3(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    return TB.read_parquet(spark, f"{sf}/lineitem.parquet", cols).where("l_quantity >= 25")


@query("s4_parquet_sink", _RAW_SQL)
def s4(spark, sf):
    path = TB.write_parquet(_raw(spark, sf), scratch_path(spark, "x-train-raw"))
    return rounded(TB.read_parquet(spark, path))


# P ------------------------------------------------------------------------------------------------
@query("p1_split_columns", f"with {OBS_SQL} select id, {RS(*NUMERIC)}, {_feature_list().split('redshift, ')[1]} from obs")
def p1(spark, sf):
    x, _ = TB.split_xy(_raw(spark, sf), "class")
    return rounded(x)


@query("p2_category_columns", f"with {OBS_SQL} select id, spectral_type, galaxy_population, cast(cast(z as bigint) as varchar) as z from obs")
def p2(spark, sf):
    df = observations(spark, sf).select("id", *CATEGORIES, F.col("z").cast("long").alias("z"))
    return SE.as_category(df, [*CATEGORIES, "z"])


@query("p3_label_column", f"with {LAB_SQL} select id, y as class_encoded from lab")
def p3(spark, sf):
    return SE.label_frame(labelled(spark, sf))


@query("p4_select_by_name", f"with {OBS_SQL} select id, {R('redshift', 'redshift')}, {R('u', 'u')}, spectral_type from obs")
def p4(spark, sf):
    picker = SE.ColumnSelector(features=["redshift", "u", "spectral_type"])
    return rounded(picker.select(_raw(spark, sf), key=["id"]))


_MASK = [c in ("alpha", "g", "galaxy_population") for c in FEATURES]


@query("p5_select_by_mask", f"with {OBS_SQL} select id, {RS('alpha', 'g')}, galaxy_population from obs")
def p5(spark, sf):
    return rounded(SE.ColumnSelector(mask=_MASK).select(_raw(spark, sf).drop("class"), key=["id"]))


_NULLED = ", ".join(
    (R(c, c) if c in NUMERIC else c)
    if c in ("alpha", "g", "galaxy_population")
    else f"cast(null as {'double' if c in NUMERIC else 'varchar'}) as {c}"
    for c in FEATURES
)


@query("p6_inverse_selection", f"with {OBS_SQL} select id, {_NULLED} from obs")
def p6(spark, sf):
    x = _raw(spark, sf).drop("class")
    picker = SE.ColumnSelector(mask=_MASK)
    return rounded(picker.restore(picker.select(x, key=["id"]), x.schema, key=["id"]))


_CHOSEN = ["redshift", "u", "spectral_type"]
_SUPPORT_SQL = " union all ".join(
    f"select {i} as pos, '{c}' as name, {str(c in _CHOSEN).lower()} as selected, "
    f"cast({_CHOSEN.index(c) if c in _CHOSEN else -1} as integer) as out_pos, "
    f"count({c}) as n_values from obs"
    for i, c in enumerate(FEATURES)
)


@query("p7_support_report", f"with {OBS_SQL} {_SUPPORT_SQL}")
def p7(spark, sf):
    return SE.ColumnSelector(features=_CHOSEN).support_report(_raw(spark, sf).drop("class"), key=["id"])


@query("p8_select_by_position", f"with {OBS_SQL} select id, {RS('alpha', 'u', 'redshift', 'g')} from obs")
def p8(spark, sf):
    x = _raw(spark, sf).drop("class", *CATEGORIES)
    by_name = SE.ColumnSelector(features=["x0", "x2"], synthetic_names=True)
    by_position = SE.ColumnSelector(features=[7, 3])
    cols = [c for c in x.columns if c != "id"]
    return rounded(x.select("id", *by_name.resolve(cols), *by_position.resolve(cols)))


@query(
    "p9_head_tail",
    f"""with {OBS_SQL}
    (select 'head' as part, id, spectral_type, {R('u', 'u')} from obs order by id limit 5)
    union all (select 'tail' as part, id, spectral_type, {R('u', 'u')} from obs order by id desc limit 5)""",
)
def p9(spark, sf):
    df = observations(spark, sf).select("id", "spectral_type", "u")
    first = SE.head(df, "id").select(F.lit("head").alias("part"), "*")
    last = SE.tail(df, "id").select(F.lit("tail").alias("part"), "*")
    return rounded(first.unionByName(last))


_TYPES = [("id", "bigint")] + [(c, "double") for c in NUMERIC] + [(c, "string") for c in CATEGORIES + ["class"]]
_SHAPE_SQL = " union all ".join(
    f"select {i} as pos, '{n}' as name, '{t}' as type, count(*) as n_rows, {len(_TYPES)} as n_cols from obs"
    for i, (n, t) in enumerate(_TYPES)
)


@query("p10_shape", f"with {OBS_SQL} {_SHAPE_SQL}")
def p10(spark, sf):
    return SE.shape(_raw(spark, sf))


@query(
    "p11_fold_subsets",
    f"""with {FOLD_SQL} select 'train' as part, id, fold, y as class_encoded from f where fold <> 2
        union all select 'valid', id, fold, y from f where fold = 2""",
)
def p11(spark, sf):
    df = folded(spark, sf).select("id", "fold", "class_encoded")
    train = SE.fold_train(df, 2).select(F.lit("train").alias("part"), "*")
    return train.unionByName(SE.fold_valid(df, 2).select(F.lit("valid").alias("part"), "*"))


@query("p12_distinct_values", "select distinct quality from documents left join labels using (doc_id) where quality is not null order by 1")
def p12(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return SE.distinct_values(docs, "quality")


# E ------------------------------------------------------------------------------------------------
def _docs(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


_DOC_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_DOCS_SQL = "docs as (select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels l on l.doc_id = d.doc_id)"


@query(
    "e1_null_fraction",
    f"with {_DOCS_SQL} "
    + " union all ".join(
        f"select '{c}' as \"column\", {R(f'avg(case when {c} is null then 1e0 else 0e0 end)', 'null_fraction')} from docs"
        for c in _DOC_COLS
    ),
)
def e1(spark, sf):
    return rounded(PR.null_fractions(_docs(spark, sf).select(*_DOC_COLS)))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "e2_numeric_summary",
    " union all ".join(
        f"select '{c}' as \"column\", {R(f'max({c})', 'max')}, {R(f'min({c})', 'min')}, "
        f"{R(f'median({c})', 'median')}, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'std')} from lineitem"
        for c in _LI
    ),
)
def e2(spark, sf):
    return rounded(PR.numeric_summary(table(spark, sf, "lineitem"), _LI))


def _hist_sql(source, col, bins=None):
    auto = f"""ceil((hi - lo) / (case when fd > 0 then least(sturges, fd) else sturges end))"""
    return f"""with s as (select count({col}) as n, min({col}) as lo, max({col}) as hi,
        quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) as iqr from {source}),
      w as (select *, (hi - lo) / (log2(n) + 1) as sturges, 2 * iqr / pow(n, 1e0 / 3e0) as fd from s),
      b as (select *, cast({bins or auto} as integer) as nb from w),
      p as (select lo, (hi - lo) / nb as width, nb from b),
      c as (select least(cast(floor(({col} - lo) / width) as integer), nb - 1) as bin, count(*) as n
            from {source}, p where {col} is not null group by 1),
      g as (select cast(unnest(range(nb)) as integer) as bin, lo, width from p)
      select g.bin, {R('lo + g.bin * width', 'lo')}, {R('lo + (g.bin + 1) * width', 'hi')},
             coalesce(c.n, 0) as n from g left join c on c.bin = g.bin"""


@query("e3_histogram", _hist_sql("events", "value"))
def e3(spark, sf):
    return rounded(PR.histogram(table(spark, sf, "events"), "value"))


@query("e3_histogram_fixed", _hist_sql("lineitem", "l_extendedprice", 25))
def e3_fixed(spark, sf):
    return rounded(PR.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 25))


@query(
    "e4_kernel_density",
    f"""with s as (select count(value) as n, stddev_samp(value) * pow(count(value), -0.2e0) as h,
            min(value) as lo, max(value) as hi from events),
      g as (select cast(k as integer) as point, lo + k * ((hi - lo) / 199) as x, h, n
            from s, (select unnest(range(200)) as k)),
      d as (select point, any_value(x) as x, sum(exp(-0.5e0 * pow((x - value) / h, 2))) /
              (any_value(n) * any_value(h) * sqrt(2 * pi())) as density
            from g, events where value is not null group by point)
      select point, {RS('x')}, {R('density', 'density', 9)} from d""",
)
def e4(spark, sf):
    out = PR.kernel_density(table(spark, sf, "events"), "value")
    return out.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def _box_sql(source, col, by=None):
    keys = f"{by}, " if by else ""
    grp = f"group by {by}" if by else ""
    join = f"s join q on s.{by} = q.{by}" if by else "s, q"
    return f"""q as (select {keys} quantile_cont({col}, 0.25) as q1, quantile_cont({col}, 0.5) as median,
            quantile_cont({col}, 0.75) as q3 from {source} {grp}),
      j as (select {'s.' + by + ', ' if by else ''} s.{col} as x, q1, median, q3,
            q1 - 1.5e0 * (q3 - q1) as a, q3 + 1.5e0 * (q3 - q1) as b from {source} {join})
      select {keys} {R('any_value(q1)', 'q1')}, {R('any_value(median)', 'median')}, {R('any_value(q3)', 'q3')},
        {R('min(case when x between a and b then x end)', 'whisker_lo')},
        {R('max(case when x between a and b then x end)', 'whisker_hi')},
        cast(sum(case when x between a and b then 0 else 1 end) as bigint) as n_outliers,
        count(*) as n from j {grp}"""


@query("e5_box_stats", "with " + _box_sql("lineitem", "l_extendedprice"))
def e5(spark, sf):
    return rounded(PR.box_stats(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("e6_value_counts", "select event_type as value, count(*) as n from events where event_type is not null group by 1 order by 2 desc, 1")
def e6(spark, sf):
    return PR.value_counts(table(spark, sf, "events"), "event_type")


@query(
    "e7_value_proportions",
    f"with {_DOCS_SQL} select quality as value, {R('count(*) * 1e0 / (select count(quality) from docs)', 'proportion')} from docs where quality is not null group by 1",
)
def e7(spark, sf):
    return rounded(PR.value_proportions(_docs(spark, sf), "quality"))


_HIT = "case when cast(toxic as varchar) = '1' then 1e0 else 0e0 end"


@query(
    "e8_target_rate",
    f"with {_DOCS_SQL} select source, {R(f'avg({_HIT}) * 100', 'rate')}, "
    f"{R(f'(select avg({_HIT}) * 100 from docs)', 'global_rate')} from docs where source is not null group by source",
)
def e8(spark, sf):
    return rounded(PR.target_rate(_docs(spark, sf), "source", "toxic", 1))


_TAB = ", ".join(f"count(case when signal_class = '{c}' then 1 end) as \"{c}\"" for c in CLASSES)
_PCT = ", ".join(
    f"{R(f'''count(case when signal_class = '{c}' then 1 end) * 100e0 / count(*)''')} as \"{c}\"" for c in CLASSES
)


@query("e9_crosstab", f"with {OBS_SQL} select galaxy_population, {_TAB} from obs group by 1")
def e9(spark, sf):
    return PR.crosstab(observations(spark, sf), "galaxy_population", "signal_class")


@query("e10_crosstab_pct", f"with {OBS_SQL} select spectral_type, {_PCT} from obs group by 1")
def e10(spark, sf):
    return rounded(PR.crosstab_percent(observations(spark, sf), "spectral_type", "signal_class", "QSO"))


@query("e11_box_by_class", f"with {OBS_SQL}, " + _box_sql("obs", "u", "signal_class").replace("from obs s join", "from obs s join"))
def e11(spark, sf):
    return rounded(PR.box_stats(observations(spark, sf), "u", by="signal_class"))


@query(
    "e12_density_by_class",
    f"""with {OBS_SQL}, s as (select signal_class, count(u) as n, stddev_samp(u) * pow(count(u), -0.2e0) as h,
            min(u) as mn, max(u) as mx from obs group by 1),
      t as (select *, mn - 3 * h as lo, mx + 3 * h as hi from s),
      g as (select signal_class, cast(k as integer) as point, lo + k * ((hi - lo) / 199) as x, h, n
            from t, (select unnest(range(200)) as k)),
      v as (select signal_class, u, count(*) as c from obs group by 1, 2),
      d as (select g.signal_class, point, any_value(x) as x, sum(c * exp(-0.5e0 * pow((x - u) / h, 2))) /
              (any_value(n) * any_value(h) * sqrt(2 * pi())) as density
            from g join v on v.signal_class = g.signal_class group by 1, 2)
      select signal_class, point, {RS('x')}, {R('density', 'density', 9)} from d""",
)
def e12(spark, sf):
    out = PR.kernel_density(observations(spark, sf), "u", cut=3.0, by="signal_class")
    return out.select(
        "signal_class", "point", (F.round("x", 6) + 0.0).alias("x"), F.round("density", 9).alias("density")
    )


# F ------------------------------------------------------------------------------------------------
_SPEC = FE.FeatureSpec()
_DIFF_SQL = ", ".join(R(f"{a} - {b}", f"{a}_sub_{b}") for a, b in _SPEC.differences)
_MULT_SQL = ", ".join(R(f"{a} * {b}", f"{a}_mult_{b}") for a, b in _SPEC.products)
_SPHERE_SQL = ", ".join(
    R(e, f"{n}_espatial_coordinates")
    for n, e in (("x", "cos(delta) * cos(alpha)"), ("y", "cos(delta) * sin(alpha)"), ("z", "sin(delta)"))
)


@query("f1_differences", f"with {OBS_SQL} select id, {_DIFF_SQL} from obs")
def f1(spark, sf):
    return rounded(observations(spark, sf).select("id", *FE.difference_columns(_SPEC.differences)))


@query("f2_products", f"with {OBS_SQL} select id, {_MULT_SQL} from obs")
def f2(spark, sf):
    return rounded(observations(spark, sf).select("id", *FE.product_columns(_SPEC.products)))


@query("f3_sphere", f"with {OBS_SQL} select id, {_SPHERE_SQL} from obs")
def f3(spark, sf):
    return rounded(observations(spark, sf).select("id", *FE.sphere_columns("alpha", "delta")))


@query(
    "f4_feature_table",
    f"with {OBS_SQL}, s as ({'select *, cast((row_number() over (partition by signal_class order by md5(' + chr(39) + '7|' + chr(39) + ' || cast(id as varchar)), id) - 1) % 5 as integer) as part from obs'}) "
    f"select case when part = 4 then 'test' else 'train' end as part, id, {RS(*NUMERIC)}, spectral_type, galaxy_population, "
    f"{_DIFF_SQL}, {_MULT_SQL}, {_SPHERE_SQL} from s",
)
def f4(spark, sf):
    from tabstrata.operators.folds import stratified_folds

    parts = stratified_folds(observations(spark, sf), "id", "signal_class", 5, 7, "part")
    frames = FE.engineer_all(
        {
            "train": SE.fold_train(parts, 4, "part").select("id", *FEATURES),
            "test": SE.fold_valid(parts, 4, "part").select("id", *FEATURES),
        }
    )
    tagged = [df.select(F.lit(name).alias("part"), "*") for name, df in frames.items()]
    return rounded(tagged[0].unionByName(tagged[1]))
