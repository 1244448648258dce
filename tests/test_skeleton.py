import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import kernels as N
from framewise.operators import skeleton as H

HUMAN = [("root", -1, (0, 0, 0)), ("pelvis", 0, (0, 0, 95)), ("spine_01", 1, (0, 0, 20)), ("neck_01", 2, (0, 0, 35)), ("head", 3, (0, 0, 12)),
         ("clavicle_l", 2, (0, 5, 30)), ("upperarm_l", 5, (0, 15, 0)), ("lowerarm_l", 6, (0, 25, -5)), ("hand_l", 7, (0, 25, -5)),
         ("clavicle_r", 2, (0, -5, 30)), ("upperarm_r", 9, (0, -15, 0)), ("lowerarm_r", 10, (0, -25, -5)), ("hand_r", 11, (0, -25, -5)),
         ("thigh_l", 1, (0, 10, -5)), ("calf_l", 13, (0, 0, -42)), ("foot_l", 14, (0, 0, -42)),
         ("thigh_r", 1, (0, -10, -5)), ("calf_r", 16, (0, 0, -42)), ("foot_r", 17, (0, 0, -42)), ("thumb_01_l", 8, (0, 3, 0))]


def human(spark, mesh=1):
    rows = [(mesh, i, p if p >= 0 else None, n, *[float(v) for v in t], 0.0, 0.0, 0.0, 1.0) for i, (n, p, t) in enumerate(HUMAN)]
    return spark.createDataFrame(rows, "mesh int, bone_idx bigint, parent_idx bigint, name string, x double, y double, z double, qx double, qy double, qz double, qw double")


def test_pose_without_rotation_adds_up(spark):
    out = {r["bone_idx"]: (r["x"], r["y"], r["z"]) for r in H.component_pose(human(spark)).collect()}
    assert out[4] == (0.0, 0.0, 162.0) and out[8] == (0.0, 70.0, 135.0)


def test_roles_of_a_named_skeleton(spark):
    roles = {r["role"]: HUMAN[r["bone_idx"]][0] for r in H.infer_roles(human(spark)).collect()}
    assert roles["Root"] == "root" and roles["Pelvis"] == "pelvis" and roles["Neck"] == "neck_01"
    assert roles["LeftHand"] == "hand_l" and roles["RightFoot"] == "foot_r" and roles["LeftCalf"] == "calf_l"
    assert len(roles) == 19 and len(set(roles.values())) == 19


def test_posture_of_two_and_four_legs(spark):
    rows = [(b, r, 0.0, x, z) for b, hand, neck in ((1, 90.0, (0.0, 150.0)), (2, 5.0, (60.0, 62.0))) for r, x, z in (
        ("LeftFoot", 0.0, 0.0), ("RightFoot", 0.0, 0.0), ("LeftHand", 0.0, hand), ("RightHand", 0.0, hand), ("Head", 0.0, neck[1] + 15), ("Pelvis", 0.0, 60.0), ("Neck", neck[0], neck[1]))]
    df = spark.createDataFrame(rows, "b int, role string, x double, y double, z double")
    assert {r["b"]: r["upright_biped"] for r in H.posture(df, "b").collect()} == {1: True, 2: False}


def test_motion_bone_stops_below_the_root(spark):
    rows = [(1, 0, None, 0.0), (1, 1, 0, 0.0), (1, 2, 1, 0.5), (1, 3, 2, 0.2)]
    df = spark.createDataFrame([(m, b, p, 0.0, 0.0, z) for m, b, p, z in rows], "mesh int, bone_idx bigint, parent_idx bigint, x double, y double, z double")
    out = H.motion_bone(df, df.where("bone_idx = 3").select("mesh", F.col("bone_idx").alias("start_idx"))).first()
    assert out["bone_idx"] == 1


def test_a_chain_of_a_hundred_bones_has_no_depth_limit(spark):
    rows = [(1, i, i - 1 if i else None, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for i in range(100)]
    bones = spark.createDataFrame(rows, "mesh int, bone_idx int, parent_idx int, x double, y double, z double, qx double, qy double, qz double, qw double")
    deep = {r["bone_idx"]: r for r in H.hierarchy_stats(bones).collect()}
    assert deep[99]["depth"] == 99 and deep[0]["descendants"] == 99
    assert {r["bone_idx"]: r["z"] for r in H.component_pose(bones).collect()} == {i: float(i + 1) for i in range(100)}


def test_random_trees_compose_as_a_walk_from_the_root_does(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for mesh in range(6):
        order = rng.permutation(40)
        up = [None if mesh % 2 == 0 and k < 2 or k == 0 else int(order[rng.integers(max(0, k - 3), k)]) for k in range(40)]
        pose = {}
        for k, bone in enumerate(order):
            q = rng.normal(size=4)
            q /= np.linalg.norm(q)
            t = rng.normal(size=3)
            rows.append((mesh, int(bone), up[k], *map(float, t), *map(float, q)))
            pt, pq = pose[up[k]] if up[k] is not None else (np.zeros(3), np.array([0, 0, 0, 1.0]))
            turn = lambda v: v + 2 * pq[3] * np.cross(pq[:3], v) + 2 * np.cross(pq[:3], np.cross(pq[:3], v))  # noqa: B023, E731
            pose[int(bone)] = pt + turn(t), np.append(pq[3] * q[:3] + q[3] * pq[:3] + np.cross(pq[:3], q[:3]), pq[3] * q[3] - pq[:3] @ q[:3])
        want |= {(mesh, b): np.concatenate(p) for b, p in pose.items()}
    df = spark.createDataFrame(rows, "mesh int, bone_idx bigint, parent_idx bigint, x double, y double, z double, qx double, qy double, qz double, qw double")
    got = {(r["mesh"], r["bone_idx"]): [r[c] for c in H.POSE] for r in H.component_pose(df).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_bones_in_a_loop_are_refused(spark):
    rows = [(1, i, up, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for i, up in ((0, None), (1, 3), (2, 1), (3, 2))]
    df = spark.createDataFrame(rows, "mesh int, bone_idx bigint, parent_idx bigint, x double, y double, z double, qx double, qy double, qz double, qw double")
    with pytest.raises(Exception, match="loop"):
        H.component_pose(df).collect()


def test_posture_of_bodies_with_composite_keys(spark):
    """Bodies are told apart by all keys: pair 0 with sample 1000 isn't pair 1 with sample 0."""
    up = {"LeftFoot": 0.0, "RightFoot": 0.0, "LeftHand": 9.0, "RightHand": 9.0, "Head": 17.0, "Pelvis": 10.0, "Neck": 15.0}
    rows = [(p, s, r, 0.0, 0.0, z if p else -z) for p, s in ((0, 1000), (1, 0)) for r, z in up.items()]
    df = spark.createDataFrame(rows, "pair long, sample long, role string, x double, y double, z double")
    got = {(r["pair"], r["sample"]): r["hand_above_foot"] for r in H.posture(df, ["pair", "sample"]).collect()}
    assert set(got) == {(0, 1000), (1, 0)} and got[0, 1000] is None and abs(got[1, 0] - 9 / 17) < 1e-12


def test_roles_tie_whatever_the_noise_of_their_sums(spark):
    """0.20 + 0.39 is more than 0.15 + 0.44 by rounding noise only; the first bone is taken."""
    pick = N.pick_roles(["Pelvis", "LeftFoot"], ["", "Pelvis"], [True, True])
    # bone 0 is the pelvis, bones 1 and 2 hang on it, bone 3 on bone 2; names, then places, of both roles bone by bone
    rows = [([-1, 0, 0, 2], [0.7] + [0.0] * 7, [0.2, 0.0, 0.0, 0.15, 0.0, 0.0, 0.0, 0.20])]
    df = spark.createDataFrame(rows, "p array<bigint>, ns array<double>, ss array<double>")
    assert df.select(pick("p", "ns", "ss").alias("r")).first()["r"]["bone"] == [0, 1]
