"""Recorded datasets, file listings and paths of every scheme."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators.audit import missing_media
from tracelake.sources import datasets as D
from tracelake.sources import files


def test_readers_are_pinned(spark, tmp_path):
    root = tmp_path / "set"
    spark.createDataFrame([(0, 1.0)], "frame_index long, `stats/x` double").write.parquet(f"{root}/data/a")
    spark.createDataFrame([(0, ["t"], 3)], "episode_index long, tasks array<string>, length long").write.parquet(f"{root}/meta/episodes/a")
    spark.createDataFrame([(0,)], "task_index long").write.parquet(f"{root}/meta/tasks.parquet")
    (root / "REVISION").write_text("r1\n")
    source = D.RecordedSource(str(root), "r1", frames="data/*/*.parquet", episodes="meta/episodes/*/*.parquet")
    assert D.frames(spark, source).columns == ["frame_index"] and D.frames(spark, source, include_stats=True).columns == ["frame_index", "stats/x"]
    assert D.episodes(spark, source).select("episode_index", "tasks", "length").limit(5).count() == 1
    assert D.tasks(spark, str(root), "meta/tasks.parquet").columns == D.tasks(spark, source, "meta/*.parquet").columns == ["task_index"]
    with pytest.raises(ValueError, match="which files hold its tasks"):
        D.tasks(spark, source)
    with pytest.raises(ValueError, match="conflicts"):
        D.frames(spark, source, revision="r2")
    with pytest.raises(RuntimeError, match="is at revision"):
        D.frames(spark, D.RecordedSource(str(root), "r2", frames="data/*/*.parquet"))
    with pytest.raises(ValueError, match="org/name"):
        D.frames(spark, "/some/path", revision="r1")
    assert D.RecordedSource("org/name", "r", "/sub/").path() == "org/name/sub"


ROOTS = [
    ("hdfs:///catalog", "hdfs://nn:8020/catalog/"),
    ("hdfs://nn:8020/catalog/", "hdfs://nn:8020/catalog/"),
    ("s3a://bucket/cat", "s3a://bucket/cat/"),
    ("s3a://bucket/", "s3a://bucket/"),
    ("file:/tmp/a b", "file:///tmp/a b/"),
    ("/tmp/a", "file:/tmp/a/"),
    ("viewfs://store/in", "viewfs://store/in/"),
]


@pytest.mark.parametrize(("root", "written"), ROOTS)
def test_paths_are_relative_to_roots_of_every_scheme(spark, root, written):
    names = ["bddl_files/a.bddl", "x/y=1/b c+d.bddl", "plain"]
    rows = spark.createDataFrame([(written + n,) for n in names], "path string")
    assert [r[0] for r in rows.select(files.relative(root, "path")).collect()] == names


def test_uris_have_three_parts(spark, tmp_path):
    assert files.parsed("hdfs://nn:8020/a/b") == ("hdfs", "nn:8020", "/a/b") and files.parsed("s3a://bucket/k") == ("s3a", "bucket", "/k")
    assert files.parsed("hdfs:///a") == ("hdfs", "", "/a") and files.parsed("file:/a") == ("file", "", "/a") and files.parsed("/a b:c") == ("", "", "/a b:c")
    assert files.parsed(files.qualified(spark, str(tmp_path))) == ("file", "", str(tmp_path))
    assert files.arrow_store("viewfs://store/in") is None and files.arrow_store("file:/a")[1] == "/a"


def made(root, names):
    for name, text in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


NAMES = {"a.x": "1", "deep/er/b.x": "22", "deep/c d+e%20é.y": "333", "deep/empty.x": "", "k=1/f.x": "4", ".hidden.x": "1", "_no/g.x": "1", "deep/_g.x": "1", "other.z": "1"}


def test_listing_is_done_by_tasks(spark, tmp_path):
    made(tmp_path, NAMES)
    root = str(tmp_path)
    found = files.list_files(spark, root, "*.{x,y}")
    assert dict(map(tuple, found.collect())) == {"a.x": 1, "deep/er/b.x": 2, "deep/c d+e%20é.y": 3, "deep/empty.x": 0, "k=1/f.x": 1}
    assert dict(map(tuple, files.list_files(spark, root, "?.x", folder="deep/er/").collect())) == {"deep/er/b.x": 2}
    assert files.list_files(spark, root, folder="nowhere").count() == files.list_files(spark, f"{root}/nowhere").count() == 0
    plan = found._jdf.queryExecution().logical().toString()
    assert "LocalRelation" not in plan and "a.x" not in plan  # names are in checkpointed rows only


def test_listing_where_arrow_has_no_file_system(spark, tmp_path):
    made(tmp_path, NAMES)
    root, nothing = str(tmp_path), lambda uri: None
    for how in ({}, {"folder": "deep"}, {"names": "*.x"}, {"folder": "nowhere"}):
        full = {r for r in map(tuple, files.list_files(spark, root, **how).collect()) if r[1]}
        assert set(map(tuple, files.list_files(spark, root, store=nothing, **how).collect())) == full


def test_contents_of_chosen_files(spark, tmp_path):
    made(tmp_path, NAMES)
    rows = files.read_contents(spark, f"file:{tmp_path}/", lambda path: path.startswith("deep/"))
    assert dict(map(tuple, rows.collect())) == {"deep/er/b.x": "22", "deep/c d+e%20é.y": "333"}


def test_audit_of_many_files(spark, tmp_path):
    made(tmp_path, {f"v/{k % 7}/{k}.mp4": "x" if k % 50 else "" for k in range(1, 1500)})
    paths = F.concat(F.lit("v/"), (F.col("id") % 7).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".mp4"))
    episodes = spark.range(1, 1510).select(F.col("id").cast("string").alias("episode_key"), paths.alias("primary_video_path"), F.lit(None).cast("string").alias("wrist_video_path"))
    found = {r["episode_key"]: r["problem"] for r in missing_media(episodes, str(tmp_path)).collect()}
    assert found == {str(k): "empty" for k in range(50, 1500, 50)} | {str(k): "missing" for k in range(1500, 1510)}
