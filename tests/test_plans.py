"""Planners over small catalogs, and what is wrong with a plan."""

import pytest
from pyspark.sql import functions as F

from tracelake.plans import grid, validate
from tracelake.sources.files import assert_revision, list_files


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def registry(spark, suite="libero_spatial", n=10):
    rows = [(suite, k, f"task_{k}", f"do {k}", f"b/{k}", f"i/{k}") for k in range(n)]
    return spark.createDataFrame(rows, "suite string, task_id long, task_name string, instruction string, bddl_path string, init_path string")


def test_task_plan(spark):
    plan = grid.task_plan(registry(spark), task_ids=(1, 3), episodes=2, seed=11)
    rows = plan.orderBy("episode_id").collect()
    assert [r["episode_id"] for r in rows] == [f"libero/libero_spatial/{t}/{k}/11" for t in (1, 3) for k in (0, 1)]
    assert {(r["task_key"], r["task_name"]) for r in rows} == {("1", "task_1"), ("3", "task_3")}
    with pytest.raises(ValueError, match=r"lacks task ids \[7\]"):
        grid.task_plan(registry(spark, n=7), task_ids=(1, 7))
    assert {r["max_steps"] for r in rows} == {250} and len({r["episode_key"] for r in rows}) == 4 and all(r["episode_key"][0] == "e" for r in rows)


@pytest.mark.parametrize(("how", "message"), [({"episodes": 0}, "positive"), ({"episodes": 51}, "<= 50"), ({"suite": "x"}, "unknown suite"), ({"task_ids": [10]}, "task ids")])
def test_task_plan_errors(spark, how, message):
    with pytest.raises(ValueError, match=message):
        grid.task_plan(registry(spark), **how)


def test_paraphrases(spark, tmp_path):
    root = put(
        tmp_path,
        {
            "REVISION": "r1\n",
            "bddl_files/act_lexical_addition_eval3_ver7.bddl": "(define (:language  put it\n there ) )",
            "bddl_files/obj_same_polarity_eval8_ver2.bddl": "(:language other)",
            "bddl_files/deep/act_x_eval1_ver1.bddl": "(:language not listed)",
            "bddl_files/notes.bddl": "",
        },
    )
    rows = grid.paraphrase_plan(spark, root, revision="r1", episodes=2).orderBy("task_id", "init_state_id").collect()
    assert [r["task_id"] for r in rows] == [3, 3, 8, 8] and [r["task_name"] for r in rows[::2]] == [grid.GOAL_TASKS[3], grid.GOAL_TASKS[8]]
    assert rows[0]["instruction"] == "put it\n there" and rows[0]["perturbation"] == "act"
    assert grid.paraphrase_plan(spark, root, paraphrase_types=["obj"]).count() == 1
    assert grid.paraphrase_plan(spark, root, task_ids=[]).count() == 0
    with pytest.raises(RuntimeError, match="is at revision r1, not at r2"):
        grid.paraphrase_plan(spark, root, revision="r2")


def test_perturbations_fall_back_to_the_suite(spark, tmp_path):
    root = put(
        tmp_path,
        {
            "bddl_files/01_visual_noise_glare/bddl/libero_goal/turn_on_the_stove.bddl": "(:language turn on)",
            "bddl_files/libero_spatial_lan/pick_up_the_bowl.bddl": "(:language pick up)",
            "init_files/libero_goal/turn_on_the_stove.pruned_init": "",
            "init_files/libero_spatial_lan/pick_up_the_bowl.pruned_init": "",
        },
    )
    goal = grid.perturbation_plan(spark, root, "libero_goal", episodes=1).collect()
    spatial = grid.perturbation_plan(spark, root, "libero_spatial", episodes=1).collect()
    assert [(r["task_key"], r["init_path"], r["instruction"], r["max_steps"]) for r in goal] == [("01_visual_noise_glare:turn_on_the_stove", "init_files/libero_goal/turn_on_the_stove.pruned_init", "turn on", 300)]
    assert [(r["suite_variant"], r["perturbation"], r["init_path"]) for r in spatial] == [("libero_spatial_lan", "lan", "init_files/libero_spatial_lan/pick_up_the_bowl.pruned_init")]
    assert grid.perturbation_plan(spark, root, "libero_goal", perturbations=["lan"]).count() == 0
    with pytest.raises(ValueError):
        grid.perturbation_plan(spark, root, "libero_90")


def test_two_tier_lookup_has_no_fan_out(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "s string, g string")
    lookup = spark.createDataFrame([("a", "1"), ("a", "2"), ("x", "9")], "key string, hit string")
    assert sorted(tuple(r) for r in grid.two_tier(rows, lookup, "s", "g", "key", "hit", "v").select("s", "v").collect()) == [("a", "1"), ("b", "9"), ("c", None)]


def test_listing_is_relative(spark, tmp_path):
    root = put(tmp_path, {"a/b.txt": "12", "c.txt": ""})
    assert sorted(tuple(r) for r in list_files(spark, root, "*.txt").collect()) == [("a/b.txt", 2), ("c.txt", 0)]
    assert list_files(spark, root, "*.zip", folder="a").count() == 0
    with pytest.raises(RuntimeError):
        assert_revision(spark, root, "r")


def plan(spark, **changes):
    return grid.task_plan(registry(spark), task_ids=(0, 1), episodes=2).withColumns({k: F.lit(v) if not hasattr(v, "alias") else v for k, v in changes.items()})


def test_validation(spark):
    good = plan(spark)
    validate.validate(good)
    with pytest.raises(ValueError, match="produced no episodes"):
        validate.validate(good.where("false"))
    with pytest.raises(ValueError, match="null 'suite'"):
        validate.validate(plan(spark, suite=F.when(F.col("init_state_id") == 0, F.col("suite"))))
    with pytest.raises(ValueError, match="duplicate episode keys"):
        validate.validate(good.union(good))
    with pytest.raises(ValueError, match="duplicate episode ids"):
        validate.validate(plan(spark, episode_id="x"))
    with pytest.raises(ValueError, match="missing required columns"):
        validate.validate(good.drop("seed"))
    assert validate.duplicates(good.union(good), "episode_key").count() == 4


def test_prepared_plans_are_checked_in_one_pass(spark, tmp_path):
    good, count = plan(spark), iter(range(100))
    folder = lambda: str(tmp_path / str(next(count)))
    whole = validate.canonical(good)
    executions = spark._jsparkSession.sharedState().statusStore().executionsCount
    before = executions()
    made = validate.prepared(good, folder())
    assert executions() - before <= 3  # the write with its counts, and the hash that finds repeated keys
    assert made.n_rows == 4 and made.content_hash == validate.plan_hash(whole) and sorted(made.rows.collect()) == sorted(whole.collect())
    assert validate.prepared(good, folder(), rows_in_bucket=1).content_hash == validate.plan_hash(whole, rows_in_bucket=1)
    wrong = {
        "produced no episodes": good.where("false"),
        "null 'suite'": plan(spark, suite=F.when(F.col("init_state_id") == 0, F.col("suite"))),
        "duplicate episode keys": good.union(good),
        "duplicate episode ids": plan(spark, episode_id="x"),
        "missing required columns": good.drop("seed"),
    }
    for message, rows in wrong.items():
        with pytest.raises(ValueError, match=message):
            validate.prepared(rows, folder())


def test_index_by_window_and_by_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    for limit in (10_000, 10):
        got = validate.dense_index(rows, "k", window_rows=limit).collect()
        assert sorted((r["episode_index"], r["k"]) for r in got) == [(k, k) for k in range(1000)]
    assert sorted(r["n"] for r in validate.cohorts(rows, 300, "k").groupBy("cohort").agg(F.count("*").alias("n")).collect()) == [100, 300, 300, 300]


def test_hashes(spark):
    whole = validate.canonical(plan(spark))
    assert validate.plan_hash(whole) == validate.plan_hash(whole.repartition(3)) != validate.plan_hash(validate.canonical(plan(spark, instruction="other")))
    assert validate.plan_hash(whole, rows_in_bucket=1) == validate.plan_hash(whole.repartition(3), rows_in_bucket=1) != validate.plan_hash(whole)
    assert validate.exact_hash(whole) == validate.exact_hash(whole.repartition(3))
    assert [r["episode_index"] for r in whole.orderBy("episode_index").collect()] == [0, 1, 2, 3]
    dry = validate.dry_run(whole, function="f@1", out="x", video=None).first()
    assert (dry["benchmark"], dry["benchmark_revision"], dry["function"], dry["out"], dry["video"]) == ("libero", "installed", "f@1", "x", None)
    summed = validate.summary(whole).first()
    assert (summed["suite"], summed["episodes"], summed["tasks"], summed["max_steps"]) == ("libero_spatial", 4, 2, 250)


def test_files_that_are_not_selected_are_never_opened(spark, tmp_path):
    long = "(:language too long to be opened here)"
    files = {"bddl_files/act_a_b_eval1_ver1.bddl": "(:language a + b)", "bddl_files/obj_x_eval2_ver1.bddl": long, "bddl_files/libero_goal_lan/pick + place.bddl": "(:language c)", "bddl_files/libero_goal_swap/x.bddl": long}
    root = put(tmp_path / "a catalog", files)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", len(long) - 1)  # opening a longer file is an error
    try:
        assert [r["instruction"] for r in grid.paraphrase_plan(spark, root, paraphrase_types=["act"]).collect()] == ["a + b"]
        assert [r["instruction"] for r in grid.perturbation_plan(spark, root, "libero_goal", perturbations=["lan"], episodes=1).collect()] == ["c"]
        with pytest.raises(Exception, match="exceeds the max length"):
            grid.paraphrase_plan(spark, root).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
