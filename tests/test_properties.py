"""Property checks with generated tables (hypothesis)."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabforge.functions.order_stats import order_statistics
from tabforge.operators import clean, outliers, sample

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=60)


@SETTINGS
@given(vals=values, keep=st.sampled_from(["first", "last", False]))
def test_dedup_idempotent(spark, vals, keep):
    df = spark.createDataFrame([(i, v, float((v or 0) % 3)) for i, v in enumerate(vals)], "id int, v double, g double")
    once = clean.dedup(df, ["g"], keep, "id")
    twice = clean.dedup(once, ["g"], keep, "id")
    if keep is not False:
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.select("g").distinct().count() == once.count()


@SETTINGS
@given(vals=values)
def test_clip_within_bounds(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    if df.where("x is not null").count() == 0:
        return
    st_ = outliers.fit_outliers(df, ["x"], "iqr")
    lo, hi = st_.params["bounds"]["x"]
    out = [r[0] for r in st_.apply(df).collect()]
    assert all(v is None or lo - 1e-9 <= v <= hi + 1e-9 for v in out)
    assert [v is None for v in out] == [v is None for v in vals]


@SETTINGS
@given(n=st.integers(1, 300), p=st.floats(0.05, 0.6))
def test_split_disjoint_complete_exact(spark, n, p):
    df = spark.range(n).withColumnRenamed("id", "k")
    s = sample.split_random(df, "k", p)
    rows = s.collect()
    assert len(rows) == n and len({r.k for r in rows}) == n
    assert sum(r.split == "test" for r in rows) == math.ceil(p * n)


@SETTINGS
@given(vals=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=80))
def test_order_statistics_match_sort(spark, vals):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    ks = set(range(0, len(vals), max(1, len(vals) // 7))) | {len(vals) - 1}
    got = order_statistics(df, [], {(): ks}, buckets=4, collect_limit=3)
    s = sorted(vals)
    assert all(got[((), k)] == s[k] for k in ks)
