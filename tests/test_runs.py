"""Runs of the closed-form trial: golden signatures, resume after each kind of damage."""

import json
import math
import os
import pathlib
import shutil
import subprocess
import sys
import threading

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelake import report
from tracelake.operators import compaction, ledger, runner, store
from tracelake.operators import metrics as M
from tracelake.operators.audit import damage, leftovers, missing_media
from tracelake.operators.runner import TrialSpec, run_plan, same_seed, task_profile
from tracelake.operators.signature import exact_signature, identity, signature
from tracelake.plans.grid import expand_grid
from tracelake.plans.validate import canonical, plan_hash
from tracelake.schemas import STEP_SCHEMA

# Signatures that a right run of the closed-form trial has.
EPISODES_SHA256 = "b4d7cd10f80d2dca273f3806e0ac801bdaee6b807d6ee01409ad846aaf208e61"
STEPS_SHA256 = "ca63c19601b22f71a34f148485cfb2b6b6b6fa2d8c8c09bc0aadad2e7d7e721a"
EPISODE_COLUMNS = ["episode_index", "episode_id", "task_id", "init_state_id", "success", "length", "reward"]
STEP_COLUMNS = ["episode_index", "episode_id", "frame_index", "timestamp", "action", "reward", "next.done", "observation.state", "observation.eef_position", "observation.gripper"]


def tasks(spark, ids=(0, 1, 2), **changes):
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(k,) for k in ids], "task_id long")
    columns = {"suite": F.lit("mock"), "suite_variant": none, "perturbation": none, "task_key": F.col("task_id").cast("string"), "task_name": F.concat(F.lit("mock "), "task_id"), "instruction": F.concat(F.lit("perform mock task "), "task_id"), "bddl_path": none, "init_path": none}
    return rows.withColumns(columns | {k: F.lit(v) for k, v in changes.items()})


def plan(spark, max_steps=20, **changes):
    return expand_grid(tasks(spark, **changes), "mock", "1", 2, 7, max_steps)


def trace(row):
    length, task, base = 5 + row["task_id"] % 3, row["task_id"], len(row["instruction"]) % 7
    steps = []
    for k in range(length):
        t, done = k + 1, k + 1 >= length
        move = max(-1.0, min(1.0, 0.03 * t + 0.01 * base))
        steps.append(
            {
                "frame_index": k, "timestamp": k / 20, "action": [move] * 6 + [1.0 if t % 2 else -1.0], "reward": float(done and task % 2 == 0), "next.done": done,
                "observation.state": [0.1 * k, 0.2, 0.3, 0, 0, 0, 0.04 - 0.001 * k, -0.04], "observation.eef_position": [0.1 * t, 0.2, 0.3],
                "observation.gripper": float(np.float32(0.04 - 0.001 * t) - np.float32(-0.04)),
            }
        )
    return {"success": task % 2 == 0, "reward": float(task % 2 == 0), "steps": steps}


def spec(made=None, fail_at=None, together=False, size=7):
    """A factory that notes in a file that it was called."""

    class Trial:
        def __init__(self):
            if made:
                pathlib.Path(made).touch()

        def run(self, row):
            if fail_at == row["episode_id"]:
                raise RuntimeError("broken trial")
            out = trace(row)
            for step in out["steps"]:
                step["action"] = step["action"][:size]
            return out

    class Batch(Trial):
        def run_batch(self, rows):
            return [self.run(r) for r in rows]

    return TrialSpec(Batch if together else Trial, "mock", "1")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A whole run in each layout, to be copied."""
    out = tmp_path_factory.mktemp("base")
    return {layout: run_plan(plan(spark), spec(), str(out / layout), layout=layout).path for layout in ("key", "bucket")}


def copied(spark, base, to, layout="key"):
    """A copy of a run below the folder ``to``, which a run of the same plan resumes."""
    return store.read_run(spark, str(shutil.copytree(base[layout], to / pathlib.Path(base[layout]).name)))


def golden(run):
    assert (run.episodes.count(), run.steps.count()) == (6, 36)
    assert exact_signature(run.episodes, ["episode_index"], EPISODE_COLUMNS) == EPISODES_SHA256
    assert exact_signature(run.steps, ["episode_index", "frame_index"], STEP_COLUMNS) == STEPS_SHA256


def test_clean_run_and_metrics(spark, tmp_path):
    run = run_plan(plan(spark), spec(), str(tmp_path))
    golden(run)
    assert [tuple(r) for r in M.metrics(run.episodes, "task_id").orderBy("task_id").collect()] == [(0, 2, 2, 5.0), (1, 2, 0, 6.0), (2, 2, 2, 7.0)]
    assert abs(M.success_rate(run.episodes).first()[0] - 2 / 3) < 1e-12
    timings = run.timings().collect()
    assert sum(t["transitions"] for t in timings) == 36 and {t["batch_fallback"] for t in timings} == {"no_batch_api"}
    assert M.failures(run.episodes, run.steps).count() == 12
    whole = signature(run.steps.drop("observation.gripper"), "episode_key", F.col("frame_index") % 4).first()[0]
    assert whole == signature(run.steps.drop("observation.gripper").repartition(5), "episode_key", F.col("frame_index") % 4).first()[0]
    made = tmp_path / "made"
    golden(run_plan(plan(spark), spec(made=str(made)), str(tmp_path)))
    assert not made.exists()  # nothing pending: the function isn't even made


def test_batches_give_the_same(spark, tmp_path):
    run = run_plan(plan(spark), spec(together=True), str(tmp_path), cohort_size=4, batch=3)
    golden(run)
    assert {t["batch_fallback"] for t in run.timings().collect()} == {None}


def test_bucket_layout(spark, tmp_path):
    run = run_plan(plan(spark), spec(), str(tmp_path), layout="bucket")
    golden(run)
    store.append_buckets(run.steps.where("frame_index > 0"), f"{run.path}/steps", 9 * 10**15)  # a later attempt that isn't complete
    store.append_buckets(run.episodes, f"{run.path}/episodes", 9 * 10**15)
    golden(store.read_run(spark, run.path))


def test_failure_loses_one_cohort(spark, tmp_path):
    with pytest.raises(Exception, match="broken trial"):
        run_plan(plan(spark), spec(fail_at="mock/mock/0/1/7"), str(tmp_path), cohort_size=1)
    (path,) = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert store.read_run(spark, str(path)).episodes.count() == 1
    golden(run_plan(plan(spark), spec(), str(tmp_path), cohort_size=1))


def test_steps_without_their_episode_are_written_again(spark, tmp_path, base):
    run = copied(spark, base, tmp_path)
    shutil.rmtree(pathlib.Path(run.path, "episodes"))
    assert store.read_run(spark, run.path).episodes.count() == 0
    run = run_plan(plan(spark), spec(), str(tmp_path))
    golden(run)
    assert M.complete_keys(run.episodes, run.steps).count() == 6


def test_broken_file_and_stray_folder(spark, tmp_path, base):
    run = copied(spark, base, tmp_path)
    file = next(pathlib.Path(run.path, "steps").glob("episode_key=*/*.parquet"))
    file.write_bytes(b"truncated parquet")
    pathlib.Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    spark.range(3).withColumnRenamed("id", "junk").coalesce(1).write.parquet(f"{run.path}/steps/rogue")
    assert store.completed(spark, run.path).count() == 5
    golden(run_plan(plan(spark), spec(), str(tmp_path)))


def test_gaps_leave_an_episode_pending(spark, tmp_path, base):
    run = copied(spark, base, tmp_path)
    keys = [r["episode_key"] for r in run.episodes.orderBy("episode_index").select("episode_key").take(3)]
    for key, damage in zip(keys, ["frame_index > 0", "frame_index <> 2", "frame_index < 3"], strict=True):
        store.write_partitions(run.steps.where(f"episode_key = '{key}' AND {damage}").checkpoint(), f"{run.path}/steps")
    assert {r[0] for r in store.completed(spark, run.path).collect()} == {r[0] for r in run.episodes.select("episode_key").collect()} - set(keys)
    golden(run_plan(plan(spark), spec(), str(tmp_path)))


def steps_files(run):
    return sorted(p for p in pathlib.Path(run.path, "steps").glob("*=*/*.parquet"))


def cut_short(file):
    file.write_bytes(file.read_bytes()[:50])
    pathlib.Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)


def empty_attempt(spark, run):
    store.append_buckets(run.steps.where("frame_index > 0"), f"{run.path}/steps", 9 * 10**15)
    store.append_buckets(run.episodes, f"{run.path}/episodes", 9 * 10**15)


def split_file(spark, run, drop=""):
    """An episode's steps in two files of its folder."""
    key = run.episodes.first()["episode_key"]
    rows = run.steps.where(f"episode_key = '{key}'{drop}").checkpoint()
    store.write_partitions(rows.repartition(2, "frame_index"), f"{run.path}/steps")


FAULTS = {
    "cut": lambda spark, run: cut_short(steps_files(run)[0]),
    "gone": lambda spark, run: steps_files(run)[-1].unlink(),
    "no steps": lambda spark, run: shutil.rmtree(pathlib.Path(run.path, "steps")),
    "no episodes": lambda spark, run: shutil.rmtree(pathlib.Path(run.path, "episodes")),
    "no ledger": lambda spark, run: shutil.rmtree(pathlib.Path(run.path, "ledger")),
    "broken ledger": lambda spark, run: [cut_short(p) for p in pathlib.Path(run.path, "ledger").glob("*.parquet")],
    "stray": lambda spark, run: spark.range(3).withColumnRenamed("id", "junk").coalesce(1).write.parquet(f"{run.path}/steps/rogue"),
    "junk": lambda spark, run: pathlib.Path(steps_files(run)[0].parent, "junk.parquet").write_bytes(b"no parquet"),
    "twice": lambda spark, run: shutil.copy(steps_files(run)[0], steps_files(run)[0].with_name("copy.parquet")),
}
KEY_FAULTS = FAULTS | {"split": split_file, "split with a gap": lambda spark, run: split_file(spark, run, " AND frame_index <> 1")}
BUCKET_FAULTS = {name: FAULTS[name] for name in ("cut", "gone", "no episodes", "twice")} | {"bad attempt": empty_attempt}


@pytest.mark.parametrize("layout", ["key", "bucket"])
def test_ledger_tells_what_a_whole_scan_does(spark, tmp_path, monkeypatch, base, layout):
    read = []
    monkeypatch.setattr(ledger, "steps_of", lambda s, root, paths, own=ledger.steps_of: read.extend(paths) or own(s, root, paths))
    for fault, make in (KEY_FAULTS if layout == "key" else BUCKET_FAULTS).items():
        run = copied(spark, base, tmp_path / fault, layout)
        make(spark, run)
        read.clear()
        found = sorted(map(tuple, store.completed(spark, run.path).collect()))
        assert found == sorted(map(tuple, store.completed(spark, run.path, whole=True).collect())), fault
        most = {"no ledger": 6, "broken ledger": 6, "bad attempt": 6, "twice": 3, "split": 4, "split with a gap": 4, "cut": 1, "junk": 1}.get(fault, 0)
        assert len(read) <= most, fault  # the run noted its own files
        if fault in ("cut", "junk"):
            read.clear()
            assert store.completed(spark, run.path).count() == len(found) and read == []  # what can't be read isn't tried again


def test_ledger_gives_way_to_a_scan_of_many_files(spark, tmp_path, monkeypatch, base):
    run = copied(spark, base, tmp_path)
    shutil.rmtree(pathlib.Path(run.path, "ledger"))
    monkeypatch.setattr(ledger, "FILES", 3)
    assert store.completed(spark, run.path).count() == 6 and not pathlib.Path(run.path, "ledger").exists()


class Killed(Exception):
    pass


def killed_at(number):
    left = [number]

    def step(name):
        left[0] -= 1
        if left[0] < 0:
            raise Killed(name)

    return step


def many_attempts(spark, out):
    run = run_plan(plan(spark), spec(), out, layout="bucket", cohort_size=3)
    empty_attempt(spark, run)  # newer and not complete
    store.append_buckets(run.steps, f"{run.path}/steps", 5)  # older and complete
    store.append_buckets(run.episodes, f"{run.path}/episodes", 5)
    return run


def test_compaction_survives_being_killed_anywhere(spark, tmp_path):
    run = many_attempts(spark, str(tmp_path))
    files = lambda: [p for p in pathlib.Path(run.path).glob("*/key_bucket=*/*.parquet")]
    before, steps = len(files()), 0
    while True:
        try:
            compaction.compact(spark, run.path, checkpoint=killed_at(steps))
        except Killed:
            steps += 1 if steps < 2 else 20
            golden(store.read_run(spark, run.path))
            continue
        break
    golden(store.read_run(spark, run.path))
    assert store.completed(spark, run.path).count() == 6
    assert steps > 20 and len(files()) == 12 < before / 2 and compaction.compact(spark, run.path) == 0
    made = tmp_path / "made"
    golden(run_plan(plan(spark), spec(made=str(made)), str(tmp_path), layout="bucket"))
    assert not made.exists()


def test_compaction_of_nothing(spark, tmp_path):
    store.write_manifest(spark, str(tmp_path), "a", {})
    assert compaction.compact(spark, str(tmp_path)) == 0


def test_a_run_leaves_nothing_staged(spark, tmp_path):
    with pytest.raises(Exception, match="broken trial"):
        run_plan(plan(spark), spec(fail_at="mock/mock/0/1/7"), str(tmp_path), cohort_size=1)
    run = run_plan(plan(spark), spec(), str(tmp_path), cohort_size=2)
    assert [p.name for p in tmp_path.iterdir()] == [run.run_id]
    assert {p.name for p in pathlib.Path(run.path).iterdir() if not p.name.startswith(".")} == {"manifest.json", "steps", "episodes", "timings", "ledger"}


def test_damaged_files_are_named(spark, tmp_path, base):
    run = copied(spark, base, tmp_path)
    assert damage(spark, f"{run.path}/steps", STEP_SCHEMA).count() == 0
    files = steps_files(run)
    cut_short(files[0])
    wrong = pq.read_table(files[1])
    pq.write_table(wrong.set_column(wrong.schema.get_field_index("reward"), "reward", pa.array(["x"] * len(wrong))), files[1])
    pathlib.Path(files[1].parent, f".{files[1].name}.crc").unlink(missing_ok=True)
    (files[2].parent / "notes.txt").write_text("x")
    spark.range(3).coalesce(1).write.parquet(f"{run.path}/steps/rogue")
    found = {(r["path"].split("/")[0][:12], r["problem"]): (r["n_footer"], r["n_read"]) for r in damage(spark, f"{run.path}/steps", STEP_SCHEMA).collect()}
    names = [f.parent.name[:12] for f in files]
    assert found == {(names[0], "unreadable"): (None, 0), (names[1], "wrong types"): (len(wrong), 0), (names[2], "stray"): (None, None), ("rogue", "stray"): (3, None)}


def test_changed_plans_are_other_runs(spark, tmp_path):
    changes = [{}, {"instruction": "x"}, {"bddl_path": "x"}, {"init_path": "x"}, {"task_name": "x"}, {"max_steps": 21}]
    assert len({plan_hash(canonical(plan(spark, **how))) for how in changes}) == 6
    ids = {run_plan(plan(spark, **how), spec(), str(tmp_path)).run_id for how in changes[:2]}
    assert len(ids) == 2
    assert store.read_manifests(spark, f"{tmp_path}/*/manifest.json").select("run_id").distinct().count() == 2


def test_wrong_action_length_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="action must have 7 values, got 6"):
        run_plan(plan(spark), spec(size=6), str(tmp_path))


@pytest.mark.parametrize(("declared", "message"), [({"action_dim": 6}, "actions of 6 values"), ({"control_mode": "absolute"}, "declares control mode"), ({"run": None}, "without run")])
def test_declarations_are_checked_when_a_function_is_made(spark, tmp_path, declared, message):
    class Wrong:
        def run(self, row):
            return trace(row)

    for name, value in declared.items():
        setattr(Wrong, name, value)
    with pytest.raises(Exception, match=message):
        run_plan(plan(spark), TrialSpec(Wrong, "mock", "1"), str(tmp_path))


def test_a_batch_has_one_seed():
    rows = [{"seed": s, "n": n} for n, s in enumerate([7, 7, 7, 8, 8, 7])]
    assert [[r["n"] for r in part] for part in same_seed(rows, 2)] == [[0, 1], [2], [3, 4], [5]]
    assert list(same_seed([], 2)) == []


def test_code_and_environment_are_part_of_the_identity(spark, tmp_path):
    more = ({}, {"implementation": "a"}, {"environment": {"numpy": "2"}})
    runs = [run_plan(plan(spark, ids=(0,)), spec(), str(tmp_path), **how) for how in more]
    assert len({r.run_id for r in runs}) == 3
    config = store.read_manifests(spark, f"{runs[2].path}/manifest.json").first()["config"]
    assert config["schema_version"] == 1 and config["environment"]["numpy"] == "2" and config["implementation"] == ""


def test_report(spark, tmp_path, capsys):
    run = run_plan(plan(spark), spec(), str(tmp_path))
    assert [tuple(r) for r in report.grouped(spark, run.path, " task_id, init_state_id,").collect()][:2] == [(0, 0, 1, 1, 5.0), (0, 1, 1, 1, 5.0)]
    report.main([run.path])
    assert "|6       |4        |6.0" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no column x"):
        report.grouped(spark, run.path, "x")


def test_report_starts_as_a_script(tmp_path):
    script = pathlib.Path(report.__file__)
    alone = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for command in ([sys.executable, str(script)], [sys.executable, "-m", "tracelake.report"]):
        where = script.parent.parent if "-m" in command else tmp_path
        done = subprocess.run([*command, "--help"], cwd=where, env=alone, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0 and "--group-by" in done.stdout, done.stderr


CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from tests.test_runs import plan, spec
from tracelake.operators.runner import TrialSpec, execute, score, task_profile
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[2]).config("spark.eventLog.compress", "false").getOrCreate()
rows = plan(spark).withColumn("episode_index", __import__("pyspark.sql.functions").sql.functions.lit(0).cast("long"))
made = spec()
usual, wide = execute(rows, made).count(), execute(rows, TrialSpec(made.factory, "mock", "1", task_cpus=2)).count()
scored = score(spark.range(4), lambda: lambda frame: frame, "id long", profile=task_profile(2)).count()
assert (usual, wide, scored) == (6, 6, 4)
spark.stop()
"""


def test_resources_hold_for_the_stage_of_the_function(tmp_path):
    (tmp_path / "events").mkdir()
    env = os.environ | {"PYTHONPATH": os.getcwd(), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", CLUSTER, f"file://{tmp_path}/shared", f"file://{tmp_path}/events"], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    logs = [json.loads(line) for path in (tmp_path / "events").rglob("*") if path.is_file() and not path.name.endswith(".crc") for line in path.read_text().splitlines() if line.startswith("{")]
    added = {e["Resource Profile Id"]: e["Task Resource Requests"]["cpus"]["Amount"] for e in logs if e["Event"] == "SparkListenerResourceProfileAdded"}
    used = {e["Stage Info"]["Resource Profile Id"] for e in logs if e["Event"] == "SparkListenerStageSubmitted"}
    assert sorted(added[k] for k in used if k) == [2.0, 2.0] and 0 in used


def test_profiles_are_checked():
    assert task_profile() is None and TrialSpec(object, "f", "1").profile() is None
    both = TrialSpec(object, "f", "1", task_cpus=4, task_gpus=0.5).profile().taskResources
    assert {name: request.amount for name, request in both.items()} == {"cpus": 4.0, "gpu": 0.5}
    with pytest.raises(ValueError, match="negative"):
        task_profile(-1)


def test_specs_are_checked():
    for bad in ({"function_id": ""}, {"revision": ""}, {"control_mode": "absolute"}):
        with pytest.raises(ValueError):
            TrialSpec(**({"factory": object, "function_id": "f", "revision": "1"} | bad))


def test_manifest_is_written_once(spark, tmp_path):
    store.write_manifest(spark, str(tmp_path), "a", {"x": 1})
    store.write_manifest(spark, str(tmp_path), "a", {"x": 1})
    with pytest.raises(RuntimeError, match="conflict"):
        store.write_manifest(spark, str(tmp_path), "a", {"x": 2})
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".manifest.json")] == ["manifest.json"]
    with pytest.raises(FileNotFoundError):
        store.read_run(spark, str(tmp_path / "none"))
    assert identity({"b": 1, "a": "é"}) == identity({"a": "é", "b": 1}) and len(identity({})) == 16


def test_of_two_writers_at_once_one_wins(spark, tmp_path):
    for k in range(8):
        root, errors, begin = str(tmp_path / str(k)), [], threading.Barrier(2)

        def write(n, root=root, errors=errors, begin=begin):
            begin.wait()
            try:
                store.write_manifest(spark, root, f"run{n}", {"x": n, "long": "y" * 100_000})
            except RuntimeError as error:
                errors.append((n, str(error)))

        writers = [threading.Thread(target=write, args=(n,)) for n in range(2)]
        [w.start() for w in writers]
        [w.join() for w in writers]
        ((lost, message),) = errors
        assert "conflict" in message and store.read_run(spark, root).run_id == f"run{1 - lost}"


def test_a_manifest_that_was_never_finished(spark, tmp_path):
    (tmp_path / "manifest.json").write_text("{")
    with pytest.raises(RuntimeError, match="never finished"):
        store.write_manifest(spark, str(tmp_path), "a", {})


def test_empty_run_and_sources(spark, tmp_path):
    store.write_manifest(spark, str(tmp_path), "a", {})
    run = store.read_run(spark, str(tmp_path))
    assert run.episodes.count() == run.steps.count() == run.timings().count() == 0
    assert tuple(M.metrics(run.episodes).first()) == (0, None, None) and math.isnan(M.success_rate(run.episodes).first()[0])
    full = run_plan(plan(spark), spec(), str(tmp_path / "out"))
    rows = store.read_sources(spark, f"{full.path}/episodes", full.episodes.schema)
    assert rows.where("source_path LIKE '%/episode_key=e%'").count() == 6
    with pytest.raises(ValueError, match="NaN"):
        store.append_timings(spark.createDataFrame([(float("nan"),)], "wall_seconds double"), str(tmp_path / "t"))


def test_signature_rejects_nan(spark):
    with pytest.raises(ValueError):
        exact_signature(spark.createDataFrame([(float("nan"),)], "x double"), ["x"])


def test_media_audit(spark, tmp_path):
    for name, text in {"v/a.mp4": "x", "v/b.mp4": "", "v/c.mp4.tmp": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = [("e1", "v/a.mp4", None), ("e2", "v/b.mp4", "v/z.mp4")]
    episodes = spark.createDataFrame(rows, "episode_key string, primary_video_path string, wrist_video_path string")
    assert sorted(tuple(r) for r in missing_media(episodes, str(tmp_path)).collect()) == [("e2", "v/b.mp4", "empty"), ("e2", "v/z.mp4", "missing")]
    assert [r[0] for r in leftovers(episodes, str(tmp_path)).collect()] == ["v/c.mp4.tmp"]


def test_a_ledger_is_written_by_several_tasks(spark, tmp_path):
    """Many keys in a few files: their rows are written and met where they are, not in one task."""
    root, conf = str(tmp_path), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("episode_key"), F.col("id").cast("string").alias("episode_id"), F.lit(0).cast("long").alias("frame_index"))
    steps = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in STEP_SCHEMA if f.name not in rows.columns})
    store.append_buckets(steps.select([f"`{f.name}`" for f in STEP_SCHEMA]), f"{root}/steps", 1, buckets=2)
    (tmp_path / "steps" / "key_bucket=0" / "torn.parquet").write_bytes(b"PAR1")
    spark.conf.set(conf, "false")
    try:
        ledger.note(spark, root)
    finally:
        spark.conf.unset(conf)
    noted = ledger.read_ledger(spark, root)
    sizes = [r["n"] for r in noted.groupBy(F.input_file_name()).agg(F.count("episode_key").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
    assert [(r["path"], r["length"]) for r in noted.where("episode_key is null").collect()] == [("key_bucket=0/torn.parquet", 4)]
    assert noted.where("episode_key is not null").select("episode_key").distinct().count() == 20_000 and ledger.note(spark, root) is not None
    assert ledger.read_ledger(spark, root).count() == 20_001


def test_cohorts_run_the_same_code(spark, tmp_path):
    """After the first cohorts nothing is compiled: a cohort's number is no part of its code."""
    compiled, counter = [], spark.sparkContext._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    run = run_plan(plan(spark, ids=range(4)), spec(), str(tmp_path), cohort_size=2, layout="bucket", checkpoint=lambda: compiled.append(counter.getCount()))
    assert len(compiled) == 4 and compiled[1] == compiled[3]
    assert run.episodes.count() == 8 and store.read_attempts(spark, f"{run.path}/steps", STEP_SCHEMA).select("attempt").distinct().count() == 4


def test_a_new_run_is_not_numbered_again(spark, tmp_path, monkeypatch):
    """All rows are pending, so their index tells their cohort; those that a resume finds pending are numbered."""
    asked = []
    monkeypatch.setattr(runner, "cohorts", lambda *args, own=runner.cohorts, **more: asked.append(more["n_rows"]) or own(*args, **more))
    golden(run := run_plan(plan(spark), spec(), str(tmp_path), cohort_size=2))
    assert asked == []
    for path in list(pathlib.Path(run.path, "episodes").glob("episode_key=*"))[:4]:
        shutil.rmtree(path)
    golden(run_plan(plan(spark), spec(), str(tmp_path), cohort_size=3))
    assert asked == [4]


def test_ledger_decodes_paths(spark, tmp_path, base):
    run = copied(spark, base, tmp_path, "bucket")
    odd = steps_files(run)[0].with_name("a b%20+c.parquet")
    shutil.copy(steps_files(run)[0], odd)
    known = ledger.steps_of(spark, run.path, [f"{odd.parent.name}/{odd.name}"])
    assert {r["path"] for r in known.select("path").collect()} == {f"{odd.parent.name}/a%20b%2520+c.parquet"}  # decoded once a key
    ledger.note(spark, run.path)
    assert f"{odd.parent.name}/{odd.name}" in {r["path"] for r in ledger.read_ledger(spark, run.path).where("episode_key is not null").collect()}
