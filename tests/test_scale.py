import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewise import scale


def hot_rows(n=400, seed=1):
    """Two thirds of the rows belong to one key."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.66, 7, rng.integers(0, 6, n))
    return pd.DataFrame({"k": key, "id": np.arange(n), "v": rng.integers(0, 50, n) / 4.0})


def test_ordinal_blocks(spark):
    pdf = hot_rows()
    df = spark.createDataFrame(pdf)
    out = scale.ordinal(df, ["k"], ["id"], "o", block=F.floor(F.col("id") / 16)).toPandas().sort_values("id")
    want = pdf.sort_values("id").groupby("k").cumcount()
    assert out["o"].tolist() == want.tolist()


def test_previous_and_running_sum_over_pieces(spark):
    pdf = hot_rows()
    pdf["o"] = pdf.groupby("k").cumcount()
    df = spark.createDataFrame(pdf)
    lag = scale.previous(df, ["k"], "o", {"p": "v"}, span=5).toPandas().sort_values("id")
    want = pdf.groupby("k")["v"].shift(1)
    assert len(lag) == len(pdf)
    assert lag["p"].fillna(-1).tolist() == want.fillna(-1).tolist()
    run = scale.running_sum(df, ["k"], "o", {"s": F.col("v")}, span=5).toPandas().sort_values("id")
    assert np.allclose(run["s"], pdf.groupby("k")["v"].cumsum())
    before = scale.running_sum(df, ["k"], "o", {"s": F.col("v")}, inclusive=False, span=5).toPandas().sort_values("id")
    assert np.allclose(before["s"], pdf.groupby("k")["v"].cumsum() - pdf["v"])


def test_quantiles_are_exact(spark):
    pdf = hot_rows(3000)
    pdf.loc[pdf["k"] == 3, "v"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = scale.quantiles(df, ["k"], {"m": ("v", 0.5), "p": ("v", 0.9)}, accuracy=50).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        values = g["v"].dropna()
        if values.empty:
            assert pd.isna(out.loc[k, "m"])
            continue
        assert np.isclose(out.loc[k, "m"], values.median())
        assert np.isclose(out.loc[k, "p"], np.percentile(values, 90))
    whole = scale.quantiles(df, [], {"m": ("v", 0.5)}, accuracy=50).toPandas()
    assert np.isclose(whole["m"][0], pdf["v"].median())


def test_quantiles_of_any_group_size(spark):
    """Groups of 1 to 400 rows with the default accuracy: the bracket must widen for small groups."""
    rng = np.random.default_rng(9)
    pdf = pd.concat([pd.DataFrame({"k": n, "v": rng.normal(size=n)}) for n in (1, 2, 3, 10, 57, 400)])
    out = scale.quantiles(spark.createDataFrame(pdf), ["k"], {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("v", 0.0), "d": ("v", 1.0)}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(out.loc[k, ["a", "b", "c", "d"]].astype(float), np.percentile(g["v"], [50, 90, 0, 100]))


def test_quantiles_survive_a_bracket_that_misses_its_rank(spark, monkeypatch):
    """Summaries that merged badly must not end the query: the bracket is widened for the groups it failed."""
    real = F.percentile_approx

    def shifted(column, percentage, accuracy):
        ends = real(column, percentage, accuracy)
        return F.transform(ends, lambda e, i: F.when(i < 4, e + F.when(F.max("k") == 1, 3.0).otherwise(-3.0)).otherwise(e))

    monkeypatch.setattr(F, "percentile_approx", shifted)
    df = spark.range(0, 4000).select((F.col("id") % 2).alias("k"), (F.floor(F.col("id") / 2) / 100).alias("v"))
    out = {r["k"]: r["m"] for r in scale.quantiles(df, ["k"], {"m": ("v", 0.5)}, accuracy=1000).collect()}
    assert np.isclose(out[0], 9.995) and np.isclose(out[1], 9.995)


def exchanges(df):
    """Shuffles in the plan of a query as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_ordinal_of_small_keys_needs_one_shuffle(spark):
    df = spark.createDataFrame(hot_rows())
    numbered = scale.ordinal(df, ["k"], ["id"], "o", block=F.floor(F.col("id") / 16))
    assert exchanges(numbered.groupBy("k").agg(F.max("o"))) == 1


def test_ordinal_of_large_keys_keeps_rows_without_key_or_block(spark):
    rows = [(k, i if i > 2 else None, i) for k in (1, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, id int, n int")
    out = scale.ordinal(df, ["k"], ["id", "n"], "o", block=F.floor(F.col("id") / 8), span=10).collect()
    assert sorted((r.k or 0, r.n, r.o) for r in out) == sorted((k, i, i) for k in (1, 0) for i in range(50))


def test_quantiles_of_small_and_large_groups_agree(spark):
    pdf = hot_rows(2000)
    df = spark.createDataFrame(pdf)
    wanted = {"p10": ("v", 0.1), "m": ("v", 0.5), "u": ("v", 0.35)}
    runs = [sorted(map(tuple, scale.quantiles(df, ["k"], wanted, upper=["u"], small=small).collect())) for small in (0, 500, 4096)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == pdf["k"].nunique()
    want = pdf.groupby("k")["v"].quantile(0.1)
    assert np.allclose([r[1] for r in runs[0]], [want[r[0]] for r in runs[0]])


def test_quantiles_of_small_groups_take_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), (1, 2.0), (2, None)], "k int, v double")
    out = {r.k: r.m for r in scale.quantiles(df, ["k"], {"m": ("v", 0.5)}).collect()}
    assert out == {None: 2.5, 1: 2.0, 2: None}


def test_brackets_survive_a_missed_rank(spark, monkeypatch):
    """As above for groups that are too large for a row."""
    real = F.percentile_approx

    def shifted(column, percentage, accuracy):
        ends = real(column, percentage, accuracy)
        return F.transform(ends, lambda e, i: F.when(i < 4, e + F.when(F.max("k") == 1, 3.0).otherwise(-3.0)).otherwise(e))

    monkeypatch.setattr(F, "percentile_approx", shifted)
    df = spark.range(0, 4000).select((F.col("id") % 2).alias("k"), (F.floor(F.col("id") / 2) / 100).alias("v"))
    out = {r["k"]: r["m"] for r in scale.quantiles(df, ["k"], {"m": ("v", 0.5)}, accuracy=1000, small=100).collect()}
    assert np.isclose(out[0], 9.995) and np.isclose(out[1], 9.995)
