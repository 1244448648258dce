"""Joins of records and votes of samples."""

import numpy as np
import pandas as pd

from framewise.operators import joins as J
from framewise.operators import kernels as N
from framewise.operators import metrics as M


def test_cache_join_reads_both_sides_once(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "k int, fp string")
    prev = spark.createDataFrame([(1, "a", True), (2, "x", True), (3, "c", False), (9, "z", True), (None, "e", True)], "k int, fp string, has_plan boolean")
    out = J.cache_join(cur, prev, "k", "fp")
    states = sorted((r.k or 0, r.state) for r in out.collect())
    assert states == [(0, "new"), (0, "removed"), (1, "cached"), (2, "changed"), (3, "changed"), (4, "new"), (9, "removed")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_side_majority_evaluates_candidates_once(spark):
    rows = [(p, s, o, side, 0.1 * s, 0.1 * s + 0.2, 0.5, 1.0, 0.5) for p, sides in ((1, "lrl"), (2, "rl"), (3, "rrl"), (4, "nnn"))
            for o, (s, c) in enumerate(enumerate(sides)) for side in [{"l": "left", "r": "right", "n": "none"}[c]]]
    rows += [(1, 0, 9, "right", 0.0, 1.0, 1.0, 1.0, 0.1), (5, 0, 0, "left", 0.0, 1.0, 1.0, 1.0, 0.1)]
    cand = spark.createDataFrame(rows, "plan int, sample int, ord int, side string, x0 double, x1 double, height double, area double, probability double")
    cand.createOrReplaceTempView("cand_rows")
    seen = spark.createDataFrame([(1, 3), (2, 2), (3, 3), (4, 3), (5, 3)], "plan int, n_detected int")
    out = M.side_majority(cand, seen, ["plan"], "sample")
    got = {r.plan: (r.side, r.n, round(r.screen_x, 6), round(r.screen_width, 6), round(r.confidence, 6)) for r in out.collect()}
    assert got == {1: ("left", 2, 0.2, 0.2, 0.333333), 2: ("left", 1, 0.2, 0.2, 0.25), 3: ("right", 2, 0.15, 0.2, 0.333333)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # the detected counts alone; samples are read from the staged rows


def test_azimuth_search_keeps_its_arrays_small(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 2000
    shots = [pd.Series(rng.uniform(lo, hi, n)) for lo, hi in ((200, 1200), (-100, 100), (-50, 50), (20, 70), (150, 190), (0.5, 0.9), (0.3, 0.7), (0.35, 0.65), (1, 2))]
    counts = rng.integers(0, 5, n)
    people = [pd.Series([rng.uniform(lo, hi, c) for c in counts]) for lo, hi in ((-200, 200), (-200, 200), (150, 190), (0, 1), (0, 1.5))]
    search = N.azimuth_search().func
    sizes, real = [], np.cos
    monkeypatch.setattr(np, "cos", lambda x: sizes.append(np.size(x)) or real(x))
    out = search(*shots, *people)
    assert max(sizes) <= 61 * 1024
    for i in (0, 255, 256, 1999):
        alone = search(*[c[i:i + 1].reset_index(drop=True) for c in (*shots, *people)])
        assert alone.iloc[0].tolist() == out.iloc[i].tolist()
