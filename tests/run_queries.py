"""Command line: run registered queries (all, or those whose name contains an argument)."""

from __future__ import annotations

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import oracle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.duck(sf)
    sql = entry.oracle_sql()
    names = [n for n in entry.queries() if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            pdf = entry.queries()[n](spark, sf).toPandas()
            t1 = time.time()
            if n in sql:
                res = con.execute(sql[n]).fetchdf()
                diff = oracle.differences(pdf, res)
                width = [f"{c}:{pdf[c].dtype}/{res[c].dtype}" for c in res.columns if str(pdf[c].dtype) != str(res[c].dtype) and pdf[c].dtype.kind in "iuf"]
                if width:
                    print("   types", width)
                state = "ok" if not diff else "DIFF " + "; ".join(diff)[:1500]
                bad += bool(diff)
                print(f"{n}: {state} rows={len(pdf)} spark={t1-t0:.1f}s sql={time.time()-t1:.1f}s", flush=True)
            else:
                print(f"{n}: rows={len(pdf)} spark={t1-t0:.1f}s\n{pdf.head(3).to_string(max_colwidth=60)}", flush=True)
        except Exception:
            bad += 1
            print(f"{n}: ERROR\n{traceback.format_exc()[-1800:]}", flush=True)
        spark.catalog.clearCache()
    print("bad:", bad)


if __name__ == "__main__":
    main()
