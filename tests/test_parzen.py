"""The learning sampler: densities by hand, seeded reruns, and a comparison with random search."""

import math
import statistics

import numpy as np
import pytest

from tabstrata.plans import parzen as PZ
from tabstrata.plans.search import Study
from tabstrata.plans.space import choice, integer, log_uniform, uniform

SPACE = [uniform("x", -5.0, 5.0), log_uniform("rate", 1e-4, 1.0), choice("kind", "a", "b", None), integer("n", 2, 20, 2, when=("kind", ("b",)))]


def phi(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def normal(z):
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def test_densities_by_hand():
    # one point at 0.2: gaps 0.2 to the left, 0.3 to the prior's middle; least width 1/3
    p = PZ.Parzen([0.2])
    assert p.width.tolist() == pytest.approx([1 / 3, 1.0])
    at = 0.6
    own = normal(0.4 * 3) * 3 / (phi(0.8 * 3) - phi(-0.2 * 3))
    prior = normal(0.1) / (phi(0.5) - phi(-0.5))
    assert p.density([at])[0] == pytest.approx((own + prior) / 2)
    grid = np.linspace(0, 1, 20_001)
    assert np.trapezoid(PZ.Parzen([0.1, 0.15, 0.9]).density(grid), grid) == pytest.approx(1, abs=1e-6)
    assert PZ.shares(SPACE[2], ["a", "a", None]).tolist() == pytest.approx([(2 + 1 / 3) / 4, (1 / 3) / 4, (1 + 1 / 3) / 4])


def test_unit_interval_and_back():
    assert PZ.to_unit(SPACE[1], 1e-2) == pytest.approx(0.5) and PZ.from_unit(SPACE[1], 0.5) == pytest.approx(1e-2)
    assert [PZ.from_unit(SPACE[3], PZ.to_unit(SPACE[3], v)) for v in range(2, 21, 2)] == list(range(2, 21, 2))
    assert PZ.from_unit(SPACE[3], 1.0) == 20 and PZ.from_unit(SPACE[0], 0.25) == -2.5


def test_best_trials_are_split_off():
    good, rest = PZ.split([({"i": i}, float((i * 7) % 20)) for i in range(20)])
    assert [t["i"] for t in good] == [0, 3] and len(rest) == 18


def loss(p):
    bonus = 0.0 if p["kind"] == "b" else 3.0
    return (p["x"] - 1.3) ** 2 + (math.log10(p["rate"]) + 2) ** 2 + bonus + abs(p.get("n", 12) - 12) / 10


def run(spark, sampler, seed, n=60, parallelism=1):
    def objective(p):
        yield loss(p)

    return Study("s", SPACE, sampler=sampler, seed=seed, min_trials=999).run(spark, objective, n, parallelism)


def test_beats_random_search_and_reruns_agree(spark):
    found = {s: [run(spark, s, seed).value(run(spark, s, seed).best_trial) for seed in range(5)] for s in ("tpe", "random")}
    assert statistics.median(found["tpe"]) < 0.5 * statistics.median(found["random"])
    a, b = run(spark, "tpe", 3, 30, 3), run(spark, "tpe", 3, 30, 3)
    assert [t["params"] for _, t in sorted(a.trials.items())] == [t["params"] for _, t in sorted(b.trials.items())]
    assert all(("n" in t["params"]) == (t["params"]["kind"] == "b") for t in a.trials.values())


def test_failed_and_pruned_trials_and_continuing(spark):
    def objective(p):
        if p["kind"] == "a":
            raise ValueError("no")
        yield loss(p)

    study = Study("s", SPACE, startup=4)
    study.run(spark, objective, 8).run(spark, objective, 8)
    assert sorted(study.trials) == list(range(16)) and {t["state"] for t in study.trials.values()} <= {"COMPLETE", "FAIL", "PRUNED"}
    assert all(params["kind"] != "a" for params, _ in study.outcomes())
    with pytest.raises(ValueError):
        Study("s", SPACE, sampler="other")
