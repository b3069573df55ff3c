"""The round trip of stored models keeps one scored table at a time."""

import os

import __spark_entry__ as entry
from tabstrata.plans.catalog import searching as SE
from tabstrata.runtime import shared_dir


def test_scored_tables_do_not_add_up(spark, small, monkeypatch):
    root, seen, real = shared_dir(spark).removeprefix("file:"), [], SE.artifacts.save_model
    scored = lambda: {f for f in os.listdir(root) if f.startswith("scored-")}
    start = scored()

    def save(*args):
        seen.append(len(scored() - start))
        return real(*args)

    monkeypatch.setattr(SE.artifacts, "save_model", save)
    rows = entry.queries()["s5_model_round_trip"](spark, small).collect()
    assert len(rows) == 5 and all(r["max_gap"] == 0 and r["n"] > 1000 for r in rows)
    assert seen == [0] * 5 and not scored() - start
