import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanframe.operators import charts, frequency, impute, kinds, outliers, profile, quantiles, rows, rules
from cleanframe.schema import nan_to_null


def frame(spark, values, dtype="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def values(df, name="v"):
    return [r[name] for r in df.orderBy("i").collect()]


# --- kinds ----------------------------------------------------------------------------------

def kind_of(spark, cells):
    return kinds.infer_kinds(frame(spark, cells, "string").select("v"))[0]["v"]


@pytest.mark.parametrize("cells, kind", [
    (["sim", "não", "Sim", " - "], "boolean"),
    (["sim", "não", "s", "n"], "categorical" if 4 / 4 <= 0.5 else "text"),
    (["1", "0", "1"], "boolean"),
    (["1.234,56", "R$ 10,00", "3", "NA"], "numeric"),
    (["1"] * 9 + ["x"], "numeric"),
    (["1"] * 8 + ["x"] * 2, "categorical"),
    (["01/02/2024", "2024-03-04", None], "date"),
    (["05/06"] * 2, "categorical"),
    ([None, "NA", ""], "text"),
    ([f"word {i}" for i in range(30)], "text"),
    (["a", "b", "a", "b"], "categorical"),
    ([f"v{i % 15}" for i in range(20)], "categorical"),
    ([f"v{i % 19}" for i in range(20)], "text"),
])
def test_infer_kind(spark, cells, kind):
    assert kind_of(spark, cells) == kind


def test_infer_kind_of_typed_columns_and_overrides(spark):
    df = spark.sql("select 1 as a, 1.5d as b, true as c, date'2024-01-01' as d, 'x' as e, array(1) as f")
    found, comma = kinds.infer_kinds(df, {"e": "categórico", "missing": "text"})
    assert found == {"a": "numeric", "b": "numeric", "c": "boolean", "d": "date", "e": "categorical", "f": "text"}
    assert comma == {"e": False}


def test_repeated_values_make_a_category(spark):
    df = spark.range(1000).selectExpr("concat('w', id) as words", "concat('w', id % 7) as few", "concat('w', id % 510) as close")
    assert kinds.infer_kinds(df)[0] == {"words": "text", "few": "categorical", "close": "text"}


def test_convert_kinds(spark):
    df = spark.sql("select '1,5' as a, true as b, timestamp_ntz'1970-01-01 00:00:01' as c, 3 as d, ' Sim' as e")
    out = kinds.convert_kinds(df, {"a": "numeric", "b": "numeric", "c": "numeric", "d": "text", "e": "boolean"}, {"a": True}).first()
    assert tuple(out) == (1.5, 1.0, 1e9, "3", True)


def test_convert_integer_rounds_half_even(spark):
    df = frame(spark, ["0.5", "1.5", "2.5", "x"], "string")
    assert values(kinds.convert_types(df, {"v": "inteiro"})) == [0, 2, 2, None]


def test_wide_tables_are_read_in_passes(spark):
    from cleanframe.session import aggregate_row

    df = spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(7)])
    row = aggregate_row(df, [F.max(f"c{i}").alias(f"m{i}") for i in range(7)], at_once=3)
    assert row == {f"m{i}": 9 + i for i in range(7)}


# --- rules ----------------------------------------------------------------------------------

def rule(column, find, replace="", mode="exact", case=False):
    return {"column": column, "find": find, "replace": replace, "mode": mode, "case": case}


def test_rules_on_numbers(spark):
    df = frame(spark, [1, 2, None], "long")
    assert values(rules.apply_rules(df, [rule("v", "2", "2,5")]).df) == [1.0, 2.5, None]
    assert values(rules.apply_rules(df, [rule("v", "2,0", "7")]).df) == [1, 7, None]
    assert values(rules.apply_rules(df, [rule("v", "2")]).df) == [1, None, None]
    assert values(rules.apply_rules(df, [rule("v", "2", "two")]).df) == ["1", "two", None]


def test_rules_on_text(spark):
    df = frame(spark, ["Ab", "ab", "xaby", "ab ", None], "string")
    assert values(rules.apply_rules(df, [rule("v", "AB", "z")]).df) == ["z", "z", "xaby", "ab ", None]
    assert values(rules.apply_rules(df, [rule("v", "ab", "z", case=True)]).df) == ["Ab", "z", "xaby", "ab ", None]
    assert values(rules.apply_rules(df, [rule("v", "AB", "", "contains")]).df) == [None, None, "xy", None, None]
    assert values(rules.apply_rules(df, [rule("v", "ab", r"$1\2", "contains")]).df) == [r"$1\2", r"$1\2", r"x$1\2y", r"$1\2 ", None]
    assert values(rules.apply_rules(df, [rule("v", r"^(?P<h>.)(b)", r"\g<h>-\2$", "regex")]).df) == ["A-b$", "a-b$", "xaby", "a-b$ ", None]


def test_group_names_with_underscores(spark):
    df = spark.sql("select * from values (1, 'ab-ab'), (2, 'ab-cd') as t(i, v)")
    done = rules.apply_rules(df, [rule("v", r"^(?P<first_part>\w+)-(?P=first_part)$", r"\g<first_part>2", "regex")])
    assert done.errors == [None] and values(done.df) == ["ab2", "ab-cd"]


def test_literal_with_regex_quotes(spark):
    df = frame(spark, [r"a\Eb.c", "a.c"], "string")
    assert values(rules.apply_rules(df, [rule("v", r"A\EB.", "x", "contains")]).df) == ["xc", "a.c"]


def test_rule_without_column_keeps_other_types(spark):
    df = spark.createDataFrame([(0, 1, "1", True), (1, 2, "x1", False)], "i int, n int, t string, b boolean")
    out = rules.apply_rules(df, [rule(None, "1", "9", "contains")]).df
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(0, 1, "9", True), (1, 2, "x9", False)]
    # exact: numbers and text, and a type change only where it hits
    out = rules.apply_rules(df, [rule(None, "2", "two")]).df
    assert dict(out.dtypes)["n"] == "string" and dict(out.dtypes)["i"] == "int"
    out = rules.apply_rules(df, [rule(None, "True", "yes")]).df
    assert [r["b"] for r in out.orderBy("i").collect()] == ["yes", "false"]


def test_rule_errors(spark):
    df = frame(spark, ["a"], "string")
    done = rules.apply_rules(df, [rule("v", "(", "x", "regex"), rule("v", "a", "b")])
    assert done.errors[0] and done.errors[1] is None
    assert values(done.df) == ["b"]
    assert [r["hits"] for r in done.hit_counts().orderBy("rule").collect()] == [0, 1]
    with pytest.raises(ValueError):
        rules.apply_rules(df, [rule("missing", "a", "b")])


# --- rows -----------------------------------------------------------------------------------

def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "b", 2)], "i int, k string, x int")
    assert rows.drop_duplicates(df.drop("i")).count() == 3
    assert sorted(r["i"] for r in rows.drop_duplicates(df, "i").collect()) == [1, 3, 4]
    assert sorted(r["i"] for r in rows.drop_duplicates_on(df, ["k"], ["i"]).collect()) == [1, 3]
    assert sorted(r["i"] for r in rows.drop_duplicates_on(df, ["k"], ["i"], "last").collect()) == [2, 4]
    assert sorted(r["i"] for r in rows.drop_repeated(df, ["k", "x"]).collect()) == [3, 4]
    once = rows.drop_duplicates(df.drop("i"))
    assert rows.drop_duplicates(once).count() == once.count()


def test_filters(spark):
    df = spark.createDataFrame([(1, 1.0, "Ab", True), (2, None, None, None), (3, 3.0, "c", False)], "i int, v double, t string, b boolean")

    def kept(column, operator, value=""):
        done = rows.apply_filters(df, [{"column": column, "operator": operator, "value": value}])
        return sorted(r["i"] for r in done.df.collect())

    assert kept("v", "!=", "1") == [3]
    assert kept("v", ">=", "1,0") == [1, 3]
    assert kept("v", "==", "x") == [1, 2, 3]
    assert kept("t", "contém", "AB") == [1]
    assert kept("t", "não contém", "ab") == [2, 3]
    assert kept("v", "contains", "3.0") == [3]
    assert kept("t", "é nulo") == [2]
    assert kept("b", "==", "sim") == [1]
    assert kept("b", "!=", "true") == [3]


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, None)], "a int, b int, c int")
    assert rows.drop_null_columns(df, 50.0).columns == ["a", "c"]
    assert rows.drop_null_columns(df.limit(0), 0.0).columns == ["a", "b", "c"]


# --- statistics -------------------------------------------------------------------------------

@pytest.mark.parametrize("few", [4096, 20])
def test_exact_quantiles_match_numpy(spark, few):
    rng = np.random.default_rng(3)
    a = rng.normal(size=5_000)
    hot = np.where(rng.random(5_000) < 0.4, 7.0, rng.exponential(size=5_000).round(2))  # one value fills 40%
    df = spark.createDataFrame(pd.DataFrame({"a": a, "hot": hot, "none": [None] * 5_000}).astype(float)).repartition(4)
    df = nan_to_null(df)
    wanted = [0.0, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0]
    found = quantiles.exact_quantiles(df, {"a": wanted, "hot": wanted, "none": wanted}, {"a": 5_000, "hot": 5_000, "none": 0}, few)
    assert found["a"] == pytest.approx(np.quantile(a, wanted).tolist(), abs=1e-12)
    assert found["hot"] == pytest.approx(np.quantile(hot, wanted).tolist(), abs=1e-12)
    assert found["none"] == [None] * 7


def test_order_statistics_of_extreme_values(spark):
    rng = np.random.default_rng(5)
    tiny = 1 + np.arange(3_000) * 2.0 ** -52  # neighbours among the doubles
    wide = np.concatenate([-(10.0 ** rng.uniform(-320, 308, 1_500)), [0.0, -0.0, np.inf, -np.inf], 10.0 ** rng.uniform(-320, 308, 1_496)])
    df = spark.createDataFrame(pd.DataFrame({"tiny": rng.permutation(tiny), "wide": rng.permutation(wide)})).repartition(4)
    ranks = [0, 1, 700, 1_499, 1_500, 1_501, 2_998, 2_999]
    for few in (4096, 1):
        found = quantiles.order_statistics(df, {"tiny": ranks, "wide": ranks}, few)
        for name, values in (("tiny", tiny), ("wide", wide)):
            assert [found[name, r] for r in ranks] == np.sort(values)[ranks].tolist()


def test_known_statistics(spark):
    one = profile.numeric_stats(frame(spark, [1.0, 2.0, 4.0, 9.0, 20.0]), ["v"])["v"]
    assert one.kurtosis == pytest.approx(1.8954319, abs=1e-6)
    assert profile.numeric_stats(frame(spark, [1.0, 2.0, 3.0, 100.0]), ["v"])["v"].skew == pytest.approx(1.4691838, abs=1e-6)


def test_degenerate_statistics(spark):
    constant = profile.numeric_profile(frame(spark, [5.0] * 6).select("v")).first()
    assert (constant["skewness"], constant["kurtosis"], constant["std"], constant["outliers"]) == (0.0, 0.0, 0.0, 0)
    single = profile.numeric_profile(frame(spark, [5.0]).select("v")).first()
    assert (single["std"], single["kurtosis"], single["skewness"]) == (0.0, 0.0, 0.0)
    assert profile.numeric_profile(frame(spark, [None, None]).select("v")).count() == 0
    empty = frame(spark, [1.0]).limit(0)
    assert profile.quality(empty).first()["quality"] == 100.0
    assert [r["null_pct"] for r in profile.null_table(empty).collect()] == [0.0, 0.0]
    assert profile.full_profile(empty, {"i": "numeric", "v": "numeric"}, order_by=["i"]).count() == 2


def test_nan_is_missing(spark):
    df = nan_to_null(frame(spark, [1.0, float("nan"), 3.0]))
    stats = profile.numeric_stats(df, ["v"])["v"]
    assert (stats.n, stats.mean, stats.median) == (2, 2.0, 2.0)


@pytest.mark.parametrize("cells, pattern", [
    ([1, 2], ""), ([None, None], "whole column empty"), ([None, 1, 2], "nulls at the start"),
    ([1, None, None], "nulls at the end"), ([1, None, None, None, 2], "nulls in one block"),
    ([1, None, None, 2], "nulls scattered"), ([1, None, None, None, 2, None], "nulls scattered"), ([None, 1, None], "nulls scattered"),
])
def test_null_pattern(spark, cells, pattern):
    df = frame(spark, cells, "int")
    assert profile.null_patterns(df, ["v"], ["i"]).first()["pattern"] == pattern
    assert profile.null_patterns(df.withColumnRenamed("i", "a.i"), ["v"], ["a.i"]).first()["pattern"] == pattern
    two = df.withColumn("half", F.expr("i div 2"))
    assert profile.null_patterns(two, ["v"], ["half", "i"]).first()["pattern"] == pattern


def test_mode_ties_go_to_the_smallest(spark):
    assert frequency.modes(frame(spark, list("babac"), "string"), ["v"])["v"] == ("a", 2)
    assert frequency.modes(frame(spark, [10, 9, 9, 10], "int"), ["v"])["v"] == (9, 2)
    assert frequency.modes(frame(spark, [None], "int"), ["v"]) == {}


# --- outliers ------------------------------------------------------------------------------------

def test_clip_keeps_nulls_and_rounds_integers(spark):
    df = frame(spark, [1, 2, 3, 4, 100, None], "long")
    low, high = outliers.outlier_bounds(df, ["v"])["v"]
    assert (low, high) == (-1.0, 7.0)
    assert values(outliers.treat_outliers(df, ["v"], action="clip")) == [1, 2, 3, 4, 7, None]
    assert values(outliers.treat_outliers(df, ["v"], action="null")) == [1, 2, 3, 4, None, None]
    assert values(outliers.treat_outliers(df, ["v"])) == [1, 2, 3, 4, None]


def test_big_integers_inside_the_bounds_are_untouched(spark):
    big = 2**53 + 1
    df = frame(spark, [big, big + 2, big + 4, None], "long")
    assert values(outliers.treat_outliers(df, ["v"], action="clip")) == [big, big + 2, big + 4, None]


def test_removal_is_the_union_over_columns(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"i": range(300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    bounds = outliers.outlier_bounds(df, ["a", "b"], factor=0.5)
    kept = {r["i"] for r in outliers.treat_outliers(df, ["a", "b"], factor=0.5).collect()}
    flagged = outliers.flag_outliers(df, bounds)
    assert kept == {r["i"] for r in flagged.where("not a_outlier and not b_outlier").collect()}


def test_column_without_values_has_no_outliers(spark):
    df = frame(spark, [None, None])
    assert outliers.treat_outliers(df, ["v"]).count() == 2
    assert outliers.treat_outliers(df, ["v"], "z-score", action="clip").count() == 2


# --- imputation -----------------------------------------------------------------------------------

def test_constant_fills(spark):
    df = frame(spark, [1, 2, None], "long")
    assert values(impute.impute(df, ["v"], "média")) == [1, 2, 2]  # 1.5 rounds half to even
    assert values(impute.impute(df, ["v"], "mode")) == [1, 2, 1]
    assert values(impute.impute(df, ["v"], "fixed", "7,5")) == [1, 2, 8]
    assert values(impute.impute(df, ["v"], "fixed", "x")) == [1, 2, None]
    text = frame(spark, ["b", "a", None], "string")
    assert values(impute.impute(text, ["v"], "mean")) == ["b", "a", None]
    assert values(impute.impute(text, ["v"], "auto")) == ["b", "a", "a"]
    flags = frame(spark, [True, False, True, None], "boolean")
    assert values(impute.impute(flags, ["v"], "mode")) == [True, False, True, True]
    assert values(impute.impute(frame(spark, [None, None], "string"), ["v"], "auto")) == [None, None]


def test_quality_never_falls(spark):
    df = frame(spark, [1.0, None, 3.0, 50.0])
    before = profile.quality(df).first()["quality"]
    for method in ("mean", "median", "mode"):
        assert profile.quality(impute.impute(df, ["v"], method)).first()["quality"] >= before


# --- charts --------------------------------------------------------------------------------------

def test_histogram_edges(spark):
    df = frame(spark, [0.0, 1.0, 2.0, 3.0, 10.0])
    assert [r["rows"] for r in charts.histogram(df, "v", 5).collect()] == [2, 2, 0, 0, 1]
    assert [r["rows"] for r in charts.card_histogram(df, "v", 5).collect()] == [3, 1, 0, 0, 1]


def test_histograms_match_numpy_and_pandas(spark):
    rng = np.random.default_rng(2)
    x = (rng.integers(0, 300, 4_000) / 10).astype(float)
    df = frame(spark, x.tolist())
    assert [r["rows"] for r in charts.histogram(df, "v").orderBy("bin").collect()] == np.histogram(x, 30)[0].tolist()
    expected = pd.cut(pd.Series(x), 14, include_lowest=True).value_counts(sort=False).tolist()
    assert [r["rows"] for r in charts.card_histogram(df, "v").orderBy("bin").collect()] == expected


def test_histogram_of_constant_column(spark):
    df = frame(spark, [5.0] * 3)
    bins = charts.histogram(df, "v", 4).orderBy("bin").collect()
    assert (bins[0]["start"], bins[-1]["end"], [b["rows"] for b in bins]) == (4.5, 5.5, np.histogram([5.0] * 3, 4)[0].tolist())
    expected = pd.cut(pd.Series([5.0] * 3), 14, include_lowest=True).value_counts(sort=False).tolist()
    assert [r["rows"] for r in charts.card_histogram(df, "v").orderBy("bin").collect()] == expected
    assert charts.card_histogram(frame(spark, [None]), "v").count() == 0


def test_density_of_constant_column_is_zero(spark):
    df = frame(spark, [5.0] * 3)
    assert {r["density"] for r in charts.density_comparison(df, df, "v").collect()} == {0.0}


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(500, 4)) + 1e6, columns=list("abcd"))
    pdf["b"] += pdf["a"] * 2
    pdf.loc[pdf.index % 3 == 0, "c"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "a"] = np.nan
    pdf["k"] = 0.1
    pdf["k2"] = np.where(pdf["c"].isna(), np.nan, 3.3)
    df = nan_to_null(spark.createDataFrame(pdf))
    expected = pdf.corr()
    found = charts.correlations(df, list(pdf.columns))
    for i, a in enumerate(pdf.columns):
        for j in range(i, len(pdf.columns)):
            want, got = expected.iloc[i, j], found[i, j]
            assert (got is None and np.isnan(want)) or got == pytest.approx(want, abs=1e-9), (a, j)


def test_top_values_with_and_without_others(spark):
    df = frame(spark, ["a", "a", "b", None, "c"], "string")
    whole = [tuple(r) for r in charts.top_values(df, "v").collect()]
    assert sorted(whole) == [("(null)", 1, 20.0, False), ("a", 2, 40.0, False), ("b", 1, 20.0, False), ("c", 1, 20.0, False)]
    cut = [tuple(r) for r in charts.top_values(df, "v", 2).collect()]
    assert cut == [("a", 2, 40.0, False), ("(null)", 1, 20.0, False), ("others (2)", 2, 40.0, True)]


def test_outlier_sample_is_stable_and_limited(spark):
    df = frame(spark, [float(i % 10) for i in range(200)] + [1000.0 + i for i in range(30)])
    first = charts.outlier_sample(df, "v", ["i"], limit=10).collect()
    again = charts.outlier_sample(df.repartition(5), "v", ["i"], limit=10).collect()
    assert len(first) == 10 and first == again and all(r["value"] >= 1000 for r in first)
