"""
local[$BENCH_CPUS] and prints one JSON line. Every query is forced with a ``noop`` write
(or its driver-side fit), one warm-up pass of the JVM first."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabforge.operators import clean, profile  # noqa: E402
from tabforge.plans import catalog_models as M  # noqa: E402
from tabforge.plans import inputs as I  # noqa: E402
from tabforge.plans.catalog import LI_NUM, QUERIES  # noqa: E402
from tabforge.session import local_session  # noqa: E402


def force(df):
    df.write.format("noop").mode("overwrite").save()


def q_profile(spark, sf):
    li = I.table(spark, sf, "lineitem")
    force(profile.profile_table(li))
    force(profile.describe_numeric(li, LI_NUM))


def q_dedup_first(spark, sf):
    li = I.table(spark, sf, "lineitem")
    force(clean.dedup(li, ["l_quantity", "l_discount"], "first",
                      ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]))


def q_pipeline_transform(spark, sf):
    force(M.q_pipeline_transform(spark, sf))


def q_nb_score_batch(spark, sf):
    force(M.q_score_batch(spark, sf))


def q_random_forest(spark, sf):
    force(QUERIES["clf_random_forest"](spark, sf))


def q_roc_curve(spark, sf):
    force(M.q_roc_curve(spark, sf))


HEADLINE = {
    "profile_describe": q_profile,
    "dedup_first": q_dedup_first,
    "pipeline_transform": q_pipeline_transform,
    "nb_fit_score_batch": q_nb_score_batch,
    "random_forest_100x12": q_random_forest,
    "roc_curve": q_roc_curve,
}


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2), app="tabforge-bench")
    # warm-up: JVM, parquet readers, codegen caches
    force(I.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity")))
    times = {}
    for name, fn in HEADLINE.items():
        t0 = time.time()
        fn(spark, sf)
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
