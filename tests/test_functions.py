"""Column functions at their edges."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.functions import vector as V


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def floats(*values):
    return F.array(*[F.lit(v).cast("float") for v in values])


def test_template_keeps_nulls(spark):
    assert list(one(spark, S.template("a/{}/{}", F.lit("x"), F.lit(3)), S.template("a/{}", F.lit(None).cast("string")))) == ["a/x/3", None]
    with pytest.raises(ValueError):
        S.template("{}", F.lit(1), F.lit(2))


def test_capture_is_null_without_a_match(spark):
    text = F.lit("(:language  turn on\nthe stove )")
    assert list(one(spark, S.capture(text, r"(?s)\(:language\s+(.+?)\s*\)"), S.capture(text, "(zzz)"))) == ["turn on\nthe stove", None]


def test_key_and_step_caps(spark):
    row = one(spark, S.key_of(F.lit("a")), *[S.step_cap(F.lit(s)) for s in ("libero_spatial", "libero_object", "libero_10", "libero_90", "x")], S.step_cap(F.lit("libero_10"), 9))
    assert list(row) == ["e" + hashlib.sha1(b"a").hexdigest(), 250, 280, 520, 400, 300, 9]


def test_selectors(spark):
    texts = [F.lit(t) for t in ("1, 22,", "a,1", " , ", "99999999999999999999")]
    assert [list(x) for x in one(spark, *[S.csv_items(t) for t in texts])] == [["1", "22"], ["a", "1"], [], ["99999999999999999999"]]
    assert list(one(spark, *[S.csv_ids(t) for t in texts])) == [[1, 22], None, None, [None]]
    assert list(one(spark, S.selected(F.lit(1), None), S.selected(F.lit(1), []), S.selected(F.lit(1), [1, 2]))) == [True, False, True]


def test_clip_leaves_null_and_nan(spark):
    values = F.array(F.lit(2.0), F.lit(-2.0), F.lit(0.25), F.lit(None).cast("double"), F.lit(float("nan")))
    got = one(spark, V.clip(values))[0]
    assert got[:4] == [1.0, -1.0, 0.25, None] and math.isnan(got[4])
    with pytest.raises(Exception, match="action must have 7 values, got 3"):
        one(spark, V.clip_action(floats(1, 2, 3)))


def test_observation_fixture(spark):
    position, turn, joints = floats(0.1, 0.2, 0.3), floats(0, 0, 0, 1), floats(0.04, -0.04)
    state, width, half = one(spark, V.proprioception(position, turn, joints), V.gripper_width(joints), V.gripper_width(floats(0.5)))
    assert np.allclose(state, [0.1, 0.2, 0.3, 0, 0, 0, 0.04, -0.04]) and abs(width - 0.08) < 1e-6 and half == 0.5
    assert one(spark, V.proprioception(F.lit(None).cast("array<float>"), turn, joints))[0] is None
    with pytest.raises(Exception, match="proprioception must have 8 values, got 7"):
        one(spark, V.proprioception(position, turn, floats(0.5)))


def test_axis_angle(spark):
    half = math.sqrt(0.5)
    quarter, none, zero = one(spark, V.axis_angle(floats(0, 0, half, half)), V.axis_angle(floats(0, 0, 0, -1)), V.axis_angle(floats(0, 0, 0, 0)))
    assert np.allclose(quarter, [0, 0, math.pi / 2], atol=1e-6) and none == [0, 0, 0]
    assert np.allclose(zero, [0, 0, 0])


def test_image_is_turned(spark):
    image = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    assert one(spark, V.derotate(image))[0] == [[4, 3], [2, 1]]


def test_gripper_is_made_binary(spark):
    got = one(spark, V.binarize_gripper(floats(0, 0, 0, 0, 0, 0, 0.6)), V.binarize_gripper(floats(0, 0, 0, 0, 0, 0, 0.5)))
    assert [x[-1] for x in got] == [-1.0, 1.0]


def test_noise_depends_on_its_key_only(spark):
    rows = spark.createDataFrame([(f"k{n}",) for n in range(9)], "key string")
    drawn = lambda frame: {r[0]: r[1] for r in frame.select("key", V.keyed_noise("n", F.col("key"), F.lit(7), F.lit(2))).collect()}
    a, b = drawn(rows.repartition(3)), drawn(rows.orderBy(F.desc("key")).coalesce(1))
    assert a == b and np.array_equal(np.array(a["k4"], dtype=np.float32), V.noise("n", "k4", 7, 2))


def test_batched_rows_of_other_lengths(spark):
    from tracelake.operators.traces import batched_rows

    rows = spark.createDataFrame([(1, 2, [1.0, 2.0], [5.0], "x"), (2, 0, [], [], "y"), (3, 1, None, [6.0], None)], "id long, n int, a array<double>, b array<double>, c string")
    got = [tuple(r) for r in batched_rows(rows, F.col("n"), ["id"], ["a", "b", "c"]).orderBy("id", "index").collect()]
    assert got == [(1, 0, 1.0, 5.0, "x"), (1, 1, 2.0, 5.0, "x"), (3, 0, None, 6.0, None)]
    with pytest.raises(Exception, match="a has 2 values in a batch of 3"):
        batched_rows(rows.limit(1), F.lit(3), ["id"], ["a"]).collect()
