import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowpane.operators import ordered as O


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 4000
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdef"), n))
    # half of all rows share one timestamp
    ts = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 100, n))
    return pd.DataFrame({"key": key, "ts": ts, "id": rng.permutation(n), "v": rng.integers(0, 30, n) / 10.0})


@pytest.fixture(autouse=True, params=[0, 100_000], ids=["hot_values", "broadcast"])
def table_size_rule(request, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_ROWS", request.param)


def test_position_equals_pandas(spark, skewed):
    got = O.with_position(spark.createDataFrame(skewed), ["key"], ["ts", "id"]).toPandas()
    want = skewed.sort_values(["key", "ts", "id"]).assign(pos=lambda d: d.groupby("key").cumcount())
    m = got.merge(want, on=["key", "ts", "id"])
    assert len(m) == len(skewed) and (m["pos_x"] == m["pos_y"]).all()
    assert (got.groupby("key")["pos"].max() + 1 == got.groupby("key")["n_rows"].max()).all()


def test_position_is_the_same_with_one_partition(one_partition, skewed):
    got = O.with_position(one_partition.createDataFrame(skewed), ["key"], ["ts", "id"]).toPandas()
    want = skewed.sort_values(["key", "ts", "id"]).assign(pos=lambda d: d.groupby("key").cumcount())
    assert got.merge(want, on=["key", "ts", "id", "pos"]).shape[0] == len(skewed)


def test_one_hot_key_is_spread_over_ranges(spark, skewed):
    seg = O.range_segments(spark.createDataFrame(skewed).where("key = 'hot'"), ["key"], ["ts", "id"])
    assert seg.select(O.SEG).distinct().count() > 4


def test_ranges_follow_the_size_of_the_table(spark, skewed, monkeypatch):
    """More ranges than the shuffle has partitions; half of the rows share a timestamp and no range is twice the mean."""
    df = spark.createDataFrame(skewed)
    assert O.planned_ranges(df) is None
    monkeypatch.setattr(O, "RANGE_BYTES", 4000)
    n = O.planned_ranges(df)
    assert n > 20
    sizes = O.range_segments(df, ["key"], ["ts", "id"]).groupBy(O.SEG).count().toPandas()["count"]
    assert len(sizes) > 15 and sizes.max() <= 2 * len(skewed) / len(sizes)
    got = O.with_position(df, ["key"], ["ts", "id"]).toPandas()
    want = skewed.sort_values(["key", "ts", "id"]).assign(pos=lambda d: d.groupby("key").cumcount())
    assert got.merge(want, on=["key", "ts", "id", "pos"]).shape[0] == len(skewed)


def test_ranges_do_not_follow_estimates_of_joins(spark, skewed, monkeypatch):
    """The estimate of a join is the product of its sides; a few rows must not become thousands of ranges."""
    df = spark.createDataFrame(skewed)
    monkeypatch.setattr(O, "RANGE_BYTES", 1 << 20)
    few = df.where("id < 50").join(df.select("id"), "id").join(df.select("id"), "id")
    assert O.planned_ranges(few) > 1000
    seg = O.range_segments(few, ["key"], ["ts", "id"])
    assert seg.rdd.getNumPartitions() <= 16 and seg.agg({O.SEG: "max"}).first()[0] < 8
    got = O.with_position(few, ["key"], ["ts", "id"]).toPandas()
    want = few.toPandas().sort_values(["key", "ts", "id"]).assign(pos=lambda d: d.groupby("key").cumcount())
    assert got.merge(want, on=["key", "ts", "id", "pos"]).shape[0] == len(want)


def test_ranges_of_a_written_table_follow_its_rows(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed)
    monkeypatch.setattr(O, "RANGE_ROWS", len(skewed) // 20)
    assert O.planned_ranges(df) is None and O.planned_ranges(df, len(skewed)) >= 20


def test_running_totals_with_next(spark, skewed):
    df = O.value_counts(spark.createDataFrame(skewed), ["key"], "v")
    got = O.running_totals(df, ["key"], ["v"], ["n"], following="v").toPandas().sort_values(["key", "v"])
    want = skewed.groupby(["key", "v"]).size().rename("n").reset_index()
    want["cum"] = want.groupby("key")["n"].cumsum()
    want["next"] = want.groupby("key")["v"].shift(-1)
    assert np.array_equal(got["n_cum"], want["cum"])
    assert np.allclose(got["v_next"].astype(float), want["next"], equal_nan=True)


def test_quantiles_equal_numpy(spark, skewed):
    probs = [0.0, 0.013, 0.5, 0.777, 1.0]
    got = O.exact_quantiles(spark.createDataFrame(skewed), ["key"], "v", probs).toPandas()
    for k, g in skewed.groupby("key"):
        mine = got[got["key"] == k].set_index("prob")["value"]
        assert np.allclose([mine[p] for p in probs], np.quantile(g["v"], probs))


def test_average_ranks(spark, skewed):
    got = O.average_ranks(spark.createDataFrame(skewed), ["key"], "v").toPandas()
    want = skewed.assign(r=skewed.groupby("key")["v"].rank()).drop_duplicates(["key", "v"])
    m = got.merge(want, on=["key", "v"])
    assert len(m) == len(got) and np.allclose(m["avg_rank"], m["r"])


def test_forward_fill_crosses_ranges(spark):
    n = 3000
    v = [float(i) if i in (5, 2000) else None for i in range(n)]
    df = spark.createDataFrame([(i, v[i]) for i in range(n)], "i int, v double")
    got = O.forward_fill(df, [], ["i"], ["v"]).orderBy("i").toPandas()["v"].to_numpy()
    assert np.array_equal(got, np.repeat([0.0, 5.0, 2000.0], [5, 1995, 1000]))


def test_join_by_value_keeps_every_row(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("v")))
    ranks = O.average_ranks(df, ["key"], "v").select("key", "v", "n", "avg_rank")
    got = O.join_by_value(df, ranks, ["key", "v"])
    assert got.count() == len(skewed)
    assert got.where("avg_rank is null").count() == 0
    assert got.select("id").distinct().count() == len(skewed)
