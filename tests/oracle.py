"""Run a registered query and its SQL over the same Parquet tables and compare all values."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def normalise(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype.kind == "f":
            pdf[c] = pdf[c].astype("float64") + 0.0
        pdf[c] = pdf[c].map(lambda v: "null" if v is None or v != v else repr(v) if not isinstance(v, str) else v)
        pdf[c] = pdf[c].str.replace(r"^np\.\w+\((.*)\)$", r"\1", regex=True)
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> list[str]:
    out = []
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return [f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"]
    if len(spark_pdf) != len(sql_pdf):
        return [f"rows {len(spark_pdf)} vs {len(sql_pdf)}"]
    for c in spark_pdf.columns:
        a, b = spark_pdf[c].dtype, sql_pdf[c].dtype
        if a.kind != b.kind and not {a.kind, b.kind} <= {"O", "T", "U"}:
            out.append(f"type of {c}: {a} vs {b}")
    a, b = normalise(spark_pdf), normalise(sql_pdf)
    for c in a.columns:
        bad = (a[c] != b[c]).to_numpy()
        if bad.any():
            i = bad.argmax()
            out.append(f"{c}: {bad.sum()} differ, e.g. {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}")
    return out
