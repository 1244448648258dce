import numpy as np
import pandas as pd

from framewise.operators import boundaries as BD
from framewise.operators import windows as W


def brute(pdf, threshold, gap):
    out = []
    for video, g in pdf.sort_values("frame").groupby("video"):
        last = None
        for r in g.itertuples():
            if r.frame == 0 or (r.change >= threshold and r.time - last >= gap):
                out.append((video, r.frame))
                last = r.time
    return sorted(out)


def test_boundaries_match_the_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(v, f, float(f), float(rng.random())) for v, n in ((1, 300), (2, 1), (3, 40)) for f in range(n)]
    pdf = pd.DataFrame(rows, columns=["video", "frame", "time", "change"])
    df = spark.createDataFrame(pdf).repartition(3)
    for threshold, gap in ((0.3, 3.0), (0.0, 7.0), (0.95, 2.0)):
        out = BD.detect_boundaries(df, ["video"], threshold, gap, span=11).collect()
        assert sorted((r["video"], r["frame"]) for r in out) == brute(pdf, threshold, gap)


def test_minimum_distance_counts_from_the_last_accepted(spark):
    rows = [(1, i, float(i), s) for i, s in enumerate([0.0, 0.9, 0.0, 0.9, 0.9, 0.9, 0.9])]
    df = spark.createDataFrame(rows, "video int, frame int, time double, change double")
    out = BD.detect_boundaries(df, ["video"], 0.5, 3.0, span=2).collect()
    assert sorted(r["frame"] for r in out) == [0, 3, 6]


def test_gap_is_a_difference_of_times(spark):
    """Frames 0.1 s apart and a gap of 0.3: i / 10 + 0.3 is rounded, the difference of two times decides."""
    rows = [(1, i, i / 10, 0.9) for i in range(40)] + [(2, i, i / 10, 0.9) for i in range(400)]
    pdf = pd.DataFrame(rows, columns=["video", "frame", "time", "change"])
    for span in (7, 65536):
        out = BD.detect_boundaries(spark.createDataFrame(pdf), ["video"], 0.5, 0.3, span=span).collect()
        assert sorted((r["video"], r["frame"]) for r in out) == brute(pdf, 0.5, 0.3)


def test_edge_fragments_match_the_loops(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for v in range(60):
        lengths = rng.integers(1, 9, rng.integers(1, 8)) / 4.0
        cuts = np.concatenate([[0.0], np.cumsum(lengths)])
        shots = [(float(a), float(b)) for a, b in zip(cuts, cuts[1:])]
        rows += [(v, i, a, b) for i, (a, b) in enumerate(shots)]
        while len(shots) > 1 and shots[-1][1] - shots[-1][0] < 1.0:
            shots[-2:] = [(shots[-2][0], shots[-1][1])]
        while len(shots) > 1 and shots[0][1] - shots[0][0] < 1.0:
            shots[:2] = [(shots[0][0], shots[1][1])]
        want[v] = shots
    df = spark.createDataFrame(rows, "v int, shot_idx int, start double, end double")
    got = {}
    for r in W.merge_edge_fragments(df, ["v"], 1.0).collect():
        got.setdefault(r["v"], []).append((r["start"], r["end"]))
    assert {v: sorted(s) for v, s in got.items()} == want


def test_false_cuts_keep_the_total_length(spark):
    rows = [(1, i, float(i), float(i + 1), 0.7 if i in (2, 3) else 0.1, 0.0, 0.0, 1.0, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "v int, shot_idx int, start double, end double, inlier double, tx double, ty double, scale double, content double")
    out = sorted((r["start"], r["end"], r["merged"]) for r in W.merge_false_cuts(df, ["v"]).collect())
    assert out == [(0.0, 1.0, 0), (1.0, 4.0, 2), (4.0, 5.0, 0), (5.0, 6.0, 0)]
