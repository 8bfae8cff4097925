import contextlib
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanframe.operators import frequency, order, profile, rows


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def gappy(n=3_000):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"i": np.arange(n), "ts": rng.permutation(n), "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))})
    pdf["v"] = np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n).round(3))
    pdf.loc[(pdf.ts > 900) & (pdf.ts < 1700), "v"] = np.nan  # longer than a chunk
    pdf.loc[pdf.ts < 5, "v"] = np.nan
    pdf["s"] = np.where(rng.random(n) < 0.5, None, pdf.i.astype(str))
    return pdf


PANDAS = {"forward": lambda s: s.ffill(), "backward": lambda s: s.bfill(), "interpolate": lambda s: s.interpolate(limit_direction="both")}


@pytest.fixture(scope="module")
def data(spark):
    pdf = gappy()
    df = spark.createDataFrame(pdf).repartition(7).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf.sort_values("ts"), df


@pytest.mark.parametrize("method", list(PANDAS))
@pytest.mark.parametrize("options", [{"chunks": 16}, {"position": "ts", "rows_per_chunk": 100}])
def test_fill_matches_pandas(data, method, options):
    pdf, df = data
    out = order.fill_ordered(df, {"v": method}, ["ts"], **options).toPandas().sort_values("ts")
    assert np.allclose(out.v.to_numpy(float), PANDAS[method](pdf.v).to_numpy(), equal_nan=True)
    assert out.s.isna().sum() == pdf.s.isna().sum() and list(out.columns) == list(pdf.columns)


@pytest.mark.parametrize("method", list(PANDAS))
def test_fill_within_a_hot_key_matches_pandas(data, method):
    pdf, df = data
    out = order.fill_ordered(df, {"v": method}, ["ts"], ["k"], chunks=16).toPandas().sort_values("ts")
    expected = pdf.groupby("k").v.transform(PANDAS[method])
    assert np.allclose(out.v.to_numpy(float), expected.to_numpy(), equal_nan=True)


def test_several_columns_and_methods_in_one_pass(data):
    pdf, df = data
    out = order.fill_ordered(df, {"v": "interpolate", "s": "forward"}, ["ts"], chunks=8).toPandas().sort_values("ts")
    assert np.allclose(out.v.to_numpy(float), PANDAS["interpolate"](pdf.v).to_numpy(), equal_nan=True)
    assert out.s.isna().sum() == pdf.s.ffill().isna().sum() and out.s.dropna().tolist() == pdf.s.ffill().dropna().tolist()


def test_interpolation_example(spark):
    df = spark.createDataFrame(list(enumerate([None, 1, None, None, 4, None])), "i int, v int")
    out = order.fill_ordered(df, {"v": "interpolate"}, ["i"], chunks=3)
    assert [r["v"] for r in out.orderBy("i").collect()] == [1, 1, 2, 3, 4, 4]


def test_position_carries_other_columns(data):
    pdf, df = data
    out = order.with_position(df, ["ts"], chunks=9).toPandas()
    assert (out.position == out.ts).all() and set(out.i) == set(pdf.i)


def test_ordered_fill_needs_an_order(spark):
    with pytest.raises(ValueError):
        order.fill_ordered(spark.createDataFrame([(1, None)], "i int, v int"), {"v": "forward"})


def test_rows_are_shuffled_by_chunk(data):
    _, df = data
    text = plan(order.fill_ordered(df, {"v": "forward"}, position="ts", rows_per_chunk=100))
    # rows meet in chunks; only the table of one row per chunk is ordered in one task
    assert "hashpartitioning(__chunk" in text


def test_values_cross_many_empty_chunks(spark):
    """Texts, null keys and chunks without any value between giver and taker."""
    texts = {3: "a" * 5_000, 40: "b", 170: "c" * 9_000}
    df = spark.createDataFrame([(i, None if i % 2 else "k", texts.get(i)) for i in range(200)], "i int, k string, s string")
    got = order.fill_ordered(df, {"s": "forward"}, position="i", rows_per_chunk=10).collect()
    assert len(got) == 200 and all(r.s == (texts[max(t for t in texts if t <= r.i)] if r.i >= 3 else None) for r in got)
    back = order.fill_ordered(df, {"s": "backward"}, ["i"], ["k"], chunks=9).collect()
    for r in back:
        later = [t for t in texts if t >= r.i and t % 2 == r.i % 2]
        assert r.s == (texts[min(later)] if later else None)


def test_rows_are_shuffled_once_after_the_cut(spark):
    df = spark.range(3_000).select(F.col("id").alias("ts"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    for options in ({"position": "ts", "rows_per_chunk": 100}, {"partition_by": ["k"], "chunks": 8}):
        text = plan(order.fill_ordered(df, {"v": "interpolate"}, ["ts"], **options))
        exchanges = [part for part in text.split("\n\n") if "REPARTITION_BY_COL" in part]
        assert len(exchanges) == 1, text


def test_chunks_follow_the_rows(spark):
    df = spark.range(1_000).select(F.col("id").alias("ts"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert order.cut(df, ["ts"], rows_per_chunk=10).count == 100
    assert order.cut(df, ["ts"]).count == least


def test_first_duplicate_is_cut_before_the_shuffle(data):
    _, df = data
    text = plan(rows.drop_duplicates_on(df, ["k"], ["ts"]))
    assert text.count("WindowGroupLimit") >= 2


def test_top_values_are_cut_before_the_shuffle(data):
    _, df = data
    assert plan(frequency.ranked(frequency.value_frequency(df, ["k", "s"]), 4)).count("WindowGroupLimit") >= 2


def test_null_pattern_shuffles_no_rows(data):
    _, df = data
    text = plan(profile.null_patterns(df.select("ts", "v"), ["v"], ["ts"]))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text
