"""Runs of several steps: what is computed once, and what the log counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanframe import prepare, run_pipeline
from cleanframe.operators import charts, frequency, impute, profile
from cleanframe.plans.prepare import PrepareOptions

CFG = {
    "conversions": {"v": "number"}, "text_columns": ["s", "absent"], "text_options": {"case": "lower"},
    "dup_null": {"drop_duplicates": True, "drop_null_rows_in": ["s"]},
    "impute_columns": ["v"], "impute_method": "median",
    "outlier_columns": ["v"], "outlier_factor": 1.5, "outlier_action": "remove",
    "filters": [{"column": "s", "operator": "!=", "value": "c"}],
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [("A", "1"), ("a ", "1"), ("B", "2"), ("b", None), (None, "3"), ("c", "4"), ("d", "900"), ("e", "x"), ("f", "3"), ("f", "3")]
    return spark.createDataFrame(rows, "s string, v string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts(log):
    return {(e.operation, e.column): e.count() for e in log.entries}


def test_logged_run_shuffles_for_duplicates_once(table):
    out, log = run_pipeline(table, CFG)
    assert "Exchange" not in plan(out) and all("cleanframe-distinct" in f for f in out.inputFiles())
    got = counts(log)
    # reading the log started no shuffle of the table either: its counts come from the write and from scans
    assert got["dedup", None] == 2 and got["required", None] == 1 and got["convert", "v"] == 1
    assert got["impute", "v"] == 2 and got["remove", None] == 1 and got["filter", "s"] == 1
    assert sorted(r.s for r in out.collect()) == ["a", "b", "b", "e", "f"]


def test_written_and_lazy_runs_agree(table):
    (a, log_a), (b, log_b) = run_pipeline(table, CFG), run_pipeline(table, CFG, materialise=False)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert counts(log_a) == counts(log_b)


def test_ordered_fill_is_counted_on_the_written_table(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, None)], "i int, v double")
    out, log = run_pipeline(df, {"impute_columns": ["v"], "impute_method": "forward"}, row_id="i")
    assert counts(log) == {("impute", "v"): 2}
    assert [r.v for r in out.orderBy("i").collect()] == [None, 5.0, 5.0, 5.0]


def test_empty_table_and_unknown_columns(spark):
    df = spark.createDataFrame([], "s string, v string")
    out, log = run_pipeline(df, {**CFG, "drop_columns": ["absent"], "rename": {"absent": "x"}})
    assert out.columns == ["s", "v"] and out.count() == 0 and counts(log)["dedup", None] == 0


def test_prepared_text_is_computed_once(table):
    done = prepare(table, {"rules": [{"column": "s", "find": "a", "replace": "z", "mode": "exact"}]})
    assert all("cleanframe-structured" in f for f in done.df.inputFiles())
    assert sorted(map(str, done.df.collect())) == sorted(map(str, prepare(table, {
        "rules": [{"column": "s", "find": "a", "replace": "z", "mode": "exact"}]}, materialise=False).df.collect()))


def test_options_keep_their_defaults():
    options = PrepareOptions.of({"text": {"case": "title"}, "rename": None, "columns": {}})
    assert options.text.case == "title" and options.text.strip and not options.text.accents
    assert options.rename == {} and options.dedup and not PrepareOptions.of({"dedup": False}).dedup


@pytest.mark.parametrize("shape", ["normal", "heavy", "far"])
def test_density_matches_the_sum_over_all_values(spark, shape):
    rng = np.random.default_rng(5)
    x = {"normal": rng.normal(50, 9, 3_000), "heavy": rng.standard_cauchy(2_000), "far": np.r_[rng.normal(0, 1, 500), 1e6]}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = [r for r in charts.density_comparison(df, df, "v", 120).collect() if r.moment == "before"]
    grid = np.linspace(x.min(), x.max(), 120)
    q1, q3 = np.quantile(x, [0.25, 0.75])
    width = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    expected = np.array([np.exp(-((g - x) / width) ** 2 / 2).sum() for g in grid]) / (len(x) * width * np.sqrt(2 * np.pi))
    got = sorted(got, key=lambda r: r.value)
    assert np.allclose([r.value for r in got], grid)
    assert np.allclose([r.density for r in got], expected, rtol=0, atol=1e-10 * expected.max())


def test_density_needs_no_python(spark):
    df = spark.range(1_000).select(F.col("id").cast("double").alias("v"))
    assert "Python" not in plan(charts.density_comparison(df, df, "v")) and "Pandas" not in plan(charts.density_comparison(df, df, "v"))


def test_decimals_keep_all_digits(spark):
    near = ["0.12345678901234567890", "0.12345678901234567891", "0.12345678901234567891", None]
    df = spark.createDataFrame([(v, "7.5") for v in near], "a string, b string")
    df = df.select(F.col("a").cast("decimal(38,20)").alias("a"), F.col("b").cast("decimal(5,2)").alias("b"))
    assert {r["column"]: r["distinct"] for r in profile.distinct_counts(df).collect()} == {"a": 2, "b": 1}
    assert str(frequency.modes(df, ["a"])["a"][0]) == near[1]
    filled = impute.impute(df, ["a"], "mode")
    assert sorted(str(r.a) for r in filled.collect()) == [near[0]] + [near[1]] * 3
