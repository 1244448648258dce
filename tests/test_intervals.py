import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise import scale
from framewise.operators import intervals as I
from framewise.operators import kernels as N


def best_of(t0, t1, cands):
    rows = [(min(t1, c1) - max(t0, c0), -c0, i) for i, c0, c1 in cands if min(t1, c1) - max(t0, c0) > 0]
    return max(rows, default=None)


@pytest.mark.parametrize("block, span", [(4, 3), (4096, 65536)])
def test_best_overlap_against_all_pairs(spark, block, span):
    """Overlapping, nested, touching and empty intervals, ties and a key without candidates."""
    rng = np.random.default_rng(7)
    truth, cands = [], []
    for k, n in ((1, 60), (2, 25), (3, 4)):
        for rows, m in ((truth, n), (cands, 0 if k == 3 else 2 * n)):
            start = rng.integers(0, 40, m)
            rows += [(k, i, float(s), float(s + w)) for i, (s, w) in enumerate(zip(start, rng.integers(0, 12, m)))]
    cands.append((1, 999, -5.0, 80.0))
    a, b = (spark.createDataFrame(r, f"k int, {n} bigint, start double, end double") for r, n in ((truth, "t"), (cands, "c")))
    got = {(r["k"], r["t"]): (r["c"], r["overlap"]) for r in I.best_overlap(a, b, ["k"], "t", "c", 7.0, block, span).collect()}
    assert len(got) == len(truth)
    for k, t, t0, t1 in truth:
        for drop in (999, None):
            want = best_of(t0, t1, [(i, c0, c1) for kk, i, c0, c1 in cands if kk == k])
        assert got[k, t] == ((want[2], want[0]) if want else (None, None)), (k, t, t0, t1)
    few = b.where("c <> 999")
    got = {(r["k"], r["t"]): (r["c"], r["overlap"]) for r in I.best_overlap(a, few, ["k"], "t", "c", 7.0, block, span).collect()}
    for k, t, t0, t1 in truth:
        want = best_of(t0, t1, [(i, c0, c1) for kk, i, c0, c1 in cands if kk == k and i != 999])
        assert got[k, t] == ((want[2], want[0]) if want else (None, None)), (k, t, t0, t1)


@pytest.mark.parametrize("block", [2, 8, 4096])
def test_points_against_all_intervals(spark, block):
    rng = np.random.default_rng(1)
    points = [(k, i, float(x)) for k in (1, 2, None) for i, x in enumerate(rng.integers(0, 60, 80))] + [(1, 500, None), (7, 1, 3.0)]
    spans = [(k, int(i), float(s), float(s + w)) for k in (1, 2) for i, (s, w) in enumerate(zip(rng.integers(0, 60, 50), rng.integers(-1, 30, 50)))]
    p, i = spark.createDataFrame(points, "k int, p bigint, x double"), spark.createDataFrame(spans, "k int, i bigint, start double, end double")
    got = {(r["k"], r["p"]): r["i"] for r in I.point_in_interval(p, i, ["k"], "x", "p", "i", 10.0, block).collect()}
    assert len(got) == len(points)
    for k, q, x in points:
        held = [n for kk, n, a, b in spans if kk == k and x is not None and a <= x <= b]
        assert got[k, q] == min(held, default=None)


def test_ten_thousand_intervals_in_one_bin(spark):
    """Every interval holds nearly every point: as pairs they would be 100 million rows."""
    n = 10_000
    spans = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") / n).alias("start"), (F.lit(2.0) - F.col("id") / n).alias("end"))
    points = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("p"), (F.lit(0.5) + F.col("id") / n).alias("x"))
    made = I.point_in_interval(points, spans, ["k"], "x", "p", "i", 100.0)
    assert made.agg(F.count("i"), F.max("i")).first() == (n, 0)
    truth = spans.select("k", F.col("i").alias("t"), "start", "end")
    best = I.best_overlap(truth, spans.withColumn("start", F.col("start") + 0.25 / n), ["k"], "t", "i", 100.0)
    assert best.agg(F.count("i")).first()[0] == n


def test_groups_are_never_cut():
    pdf = pd.DataFrame({"a": [1, 1, 2, 2, 2, None, None, 3], "b": range(8)})
    frames = [pdf.iloc[i : i + 2] for i in range(0, 8, 2)]
    for least in (1, 3, 100):
        parts = list(N.whole_groups(iter(frames), ["a"], least))
        assert pd.concat(parts)["b"].tolist() == list(range(8))
        sets = [set(p["a"].fillna(-1)) for p in parts]
        assert sum(map(len, sets)) == len(set.union(*sets))


def test_running_max_over_pieces(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.where(rng.random(300) < 0.7, 1, 2), "o": np.arange(300), "v": rng.integers(0, 1000, 300)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("v") % 3 != 0, F.col("v")))
    out = scale.running_max(df, ["k"], "o", "v", "m", span=9).toPandas().sort_values("o")
    want = pdf.assign(v=pdf["v"].where(pdf["v"] % 3 != 0)).groupby("k")["v"].cummax().groupby(pdf["k"]).ffill()
    assert out["m"].fillna(-1).tolist() == want.fillna(-1).tolist()
