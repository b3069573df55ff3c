"""Hand-computed cases for probability expressions, metrics, selection and parameter spaces."""

import math

import pytest
from pyspark.sql import functions as F

from tabstrata.functions import proba as P
from tabstrata.operators import metrics as ME
from tabstrata.operators import selection as SE
from tabstrata.plans import space as SP


def one(spark, values, build):
    cols = [f"p{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(map(float, values))], ", ".join(f"{c} double" for c in cols))
    made = build(cols)
    made = made if isinstance(made, list) else [made]
    return list(df.select(*[c.alias(f"o{i}") for i, c in enumerate(made)]).first())


def test_argmax_first_wins(spark):
    assert one(spark, [0.2, 0.5, 0.5], P.argmax) == [1]


def test_zero_sum_rows(spark):
    assert one(spark, [0.5, 0.5, 0.0], lambda c: P.renormalize(P.weighted(c, [0, 0, 1]))) == [0.0, 0.0, 0.0]
    assert one(spark, [0.0, 0.0, 0.0, 0.0], P.normalize_or_uniform) == [0.25] * 4


def test_softmax_is_stable(spark):
    assert one(spark, [1000, 1000, 0], P.softmax) == [0.5, 0.5, 0.0]


def test_binary_margin(spark):
    assert one(spark, [0.3], lambda c: P.binary_columns(c[0])) == [0.7, 0.3]


def test_non_finite(spark):
    inf = float("inf")
    got = one(spark, [float("nan"), inf, -inf, 0.4], lambda c: [P.replace_non_finite(x) for x in c])
    assert got == [1e-15, 1 - 1e-15, 1e-15, 0.4]


def test_clip_and_log_loss(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 0.5, 0.5)], "y int, a double, b double")
    got = ME.log_loss(df, "y", ["a", "b"]).first()[0]
    assert got == pytest.approx((-math.log(1e-15) - math.log(0.5)) / 2)


def test_balanced_accuracy_ignores_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 1)], "y int, pred int")
    assert ME.balanced_accuracy(ME.confusion(df, "y", "pred")).first()[0] == pytest.approx(0.75)


def test_ovr_links(spark):
    assert one(spark, [0.0, 0.0], lambda c: P.ovr_probabilities(c, "log_loss")) == [0.5, 0.5]
    assert one(spark, [-3.0, -2.0], lambda c: P.ovr_probabilities(c, "modified_huber")) == [0.5, 0.5]
    assert sum(one(spark, [4.0, -2.0, 1.0], lambda c: P.ovr_probabilities(c, "hinge"))) == pytest.approx(1)
    with pytest.raises(ValueError):
        P.ovr_probabilities(["p0"], "nope")


# selector -------------------------------------------------------------------------------------------
def test_selector_arguments():
    with pytest.raises(ValueError):
        SE.ColumnSelector()
    with pytest.raises(ValueError):
        SE.ColumnSelector(features=["a"], mask=[True])
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        SE.ColumnSelector(features=["y", "a", "x"]).resolve(["a", "b"])
    with pytest.raises(TypeError):
        SE.ColumnSelector(mask=[1, 0]).resolve(["a", "b"])
    with pytest.raises(ValueError):
        SE.ColumnSelector(mask=[True]).resolve(["a", "b"])
    with pytest.raises(ValueError):
        SE.ColumnSelector(features=["z9"], synthetic_names=True).resolve(["a", "b"])


def test_selector_resolves():
    cols = ["a", "b", "c"]
    assert SE.ColumnSelector(features=["c", "a"]).resolve(cols) == ["c", "a"]
    assert SE.ColumnSelector(mask=[1, 0, 1], strict_mask=False).resolve(cols) == ["a", "c"]
    assert SE.ColumnSelector(features=[2, 0]).resolve(cols) == ["c", "a"]
    assert SE.ColumnSelector(features=["x1"], synthetic_names=True).resolve(cols) == ["b"]
    assert SE.ColumnSelector(features=["c"]).support(cols) == [False, False, True]


def test_selector_restores_order_and_types(spark):
    df = spark.createDataFrame([(1, 2.0, "s")], "a int, b double, c string")
    picker = SE.ColumnSelector(features=["c", "a"])
    back = picker.restore(picker.select(df), df.schema)
    assert back.columns == ["a", "b", "c"] and back.dtypes == df.dtypes
    assert list(back.first()) == [1, None, "s"]


def test_selection_prunes_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = SE.ColumnSelector(features=["l_tax"]).select(df.where("l_quantity > 30"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in text


# parameter space ------------------------------------------------------------------------------------
def test_space_kinds(spark):
    space = [
        SP.uniform("f", -1.0, 1.0),
        SP.log_uniform("g", 1e-3, 1e3),
        SP.integer("n", 16, 128, 16),
        SP.choice("c", None, "a", True),
        SP.uniform("only", 0.0, 1.0, when=("c", ("a",))),
    ]
    rows = SP.sample(spark, space, "s", 200).collect()
    assert {r["n"] for r in rows} == set(range(16, 129, 16))
    assert all(-1 <= r["f"] <= 1 and 1e-3 <= r["g"] <= 1e3 for r in rows)
    params = [SP.as_params(r, space) for r in rows]
    assert {p["c"] for p in params} == {None, "a", True}
    assert all(("only" in p) == (p["c"] == "a") for p in params)
    again = SP.sample(spark, space, "s", 50, start=100).orderBy("trial").collect()
    assert again == sorted(rows, key=lambda r: r["trial"])[100:150]


def test_hash_is_even(spark):
    from tabstrata.functions.hashing import unit_hash

    u = spark.range(20_000).select(unit_hash(1, "id").alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert u[0] == pytest.approx(0.5, abs=0.01) and 0 <= u[1] < 0.001 and 0.999 < u[2] < 1
