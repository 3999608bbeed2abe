import json

import pytest
from pyspark.sql import functions as F

from runsight.sources import logs, snapshots, tables

from .conftest import rows


def test_csv_tables_infer_types_and_keep_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('x,s\n1,"two\nlines"\n2,"a ""quoted"" word"\n')
    df = tables.load_table(spark, str(path), line_breaks=True)
    assert dict(df.dtypes)["x"] == "int" and rows(df) == [(1, "two\nlines"), (2, 'a "quoted" word')]


def test_parquet_by_suffix(spark, tmp_path):
    for name in ("a.parquet", "b.pq"):
        spark.range(3).write.parquet(str(tmp_path / name))
        assert tables.load_table(spark, str(tmp_path / name)).count() == 3


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"instruction": "i", "output": "o"},\n {"instruction": "j"}]')
    (tmp_path / "a.jsonl").write_text('{"instruction": "i"}\n\n  \n{"instruction": "j"}\n')
    (tmp_path / "a.csv").write_text("instruction,output\n1,2\n")
    assert rows(tables.load_records(spark, str(tmp_path / "a.json")), "instruction") == [("i",), ("j",)]
    assert tables.load_records(spark, str(tmp_path / "a.jsonl")).where("instruction is not null").count() == 2
    assert rows(tables.load_records(spark, str(tmp_path / "a.csv"))) == [("1", "2")]
    with pytest.raises(ValueError, match=".jsonl"):
        tables.load_records(spark, str(tmp_path / "a.txt"))


def test_text_table_from_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t": "x", "l": "pos", "z": 1}]')
    (tmp_path / "a.csv").write_text("t,l\nx,pos\n")
    for name in ("a.json", "a.csv"):
        assert rows(tables.load_text_table(spark, str(tmp_path / name), "t", "l")) == [("x", "pos")]


def _images(folder, names):
    for name in names:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 10)


def test_image_folders(spark, tmp_path):
    _images(tmp_path / "one", [f"{c}/{i}.png" for c in "ab" for i in range(5)])
    df = tables.load_image_folder(spark, str(tmp_path / "one"))
    assert df.count() == 10 and df.where("is_val").count() == 2 and {r["class"] for r in df.collect()} == {"a", "b"}
    _images(tmp_path / "two", ["train/a/1.png", "train/b/2.png", "val/a/3.png", "other/a/4.png"])
    df = tables.load_image_folder(spark, str(tmp_path / "two"))
    assert df.count() == 3 and df.where("is_val").count() == 1


def test_labels_count_empty_folders(spark, tmp_path):
    _images(tmp_path / "d", ["a/1", "a/2", "c/1"])
    (tmp_path / "d" / "b").mkdir()
    assert sorted(r["label"] for r in tables.load_labels(spark, str(tmp_path / "d")).collect()) == [0, 0, 2]
    (tmp_path / "l.csv").write_text("label,x\n1,2\n0,3\n")
    assert rows(tables.load_labels(spark, str(tmp_path / "l.csv"))) == [(0,), (1,)]
    (tmp_path / "m.csv").write_text("y,x\n1,2\n")
    assert tables.load_labels(spark, str(tmp_path / "m.csv")) is None
    assert tables.load_labels(spark, str(tmp_path / "gone")) is None


def test_folder_sizes(spark, tmp_path):
    _images(tmp_path / "u", ["a/1", "a/u/2", "b/1"])
    assert rows(tables.dir_usage(spark, str(tmp_path / "u"))) == [("a", 20 / 1048576), ("b", 10 / 1048576)]


def test_logs_are_empty_before_the_first_write(spark, tmp_path):
    assert logs.read_results(spark, str(tmp_path / "r")).count() == 0
    assert logs.read_journal(spark, str(tmp_path / "j")).columns[0] == "run_id"
    assert logs.read_scoreboard(spark, str(tmp_path / "s")).count() == 0
    assert logs.read_predictions(spark, str(tmp_path / "p")) is None
    assert snapshots.read_checkpoint(spark, str(tmp_path / "c")).count() == 0


def test_results_append_and_read_one_run(spark, tmp_path):
    path = str(tmp_path / "r")
    log = spark.range(20).select(
        F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("run_id"), F.col("id").alias("experiment_id"), F.lit("c").alias("commit_hash"), F.lit("m").alias("metric_name"),
        F.lit(0.5).alias("metric_value"), F.lit("keep").alias("status"), F.lit("d").alias("description"), F.current_timestamp().alias("timestamp"),
    )
    logs.append_results(log, path)
    logs.append_results(log.withColumn("experiment_id", F.col("experiment_id") + 20), path)
    assert logs.read_results(spark, path).count() == 40
    one = logs.read_results(spark, path, run_id="r3")
    assert one.count() == 8 and one.select("experiment_id").distinct().count() == 8


def test_checkpoints_are_scanned_flat_and_nested(spark, tmp_path):
    state = {"run_id": "n", "experiment_count": 3, "best_metric": 0.5, "total_keeps": 1, "total_reverts": 2, "cost_spent_usd": 1.5, "new_field": 1}
    for folder, body in {
        "run-a": json.dumps({"schema_version": 1, "state": state}, indent=2), "run-b": json.dumps({"run_id": "f", "experiment_count": 2}), "run-c": "{broken", "other": json.dumps(state), "run-d": "{}",
    }.items():
        path = tmp_path / folder / ".state"
        path.mkdir(parents=True)
        (path / "checkpoint.json").write_text(body)
    out = rows(snapshots.run_status(snapshots.scan_checkpoints(spark, str(tmp_path))), "run_id", "experiments", "best_metric", "cost_usd", "keeps", "reverts")
    assert out == [("f", 2, None, 0.0, 0, 0), ("n", 3, 0.5, 1.5, 1, 2), ("unknown", 0, None, 0.0, 0, 0)]
    base = tmp_path / "run-a"
    assert rows(snapshots.scan_checkpoints(spark, str(base)), "state.run_id") == [("n",)]


def test_states_of_many_runs_in_one_file_are_scanned_line_by_line(spark, tmp_path):
    (tmp_path / "folder=0").mkdir()
    lines = [json.dumps({"schema_version": 1, "state": {"run_id": f"r{i}", "experiment_count": i}}) for i in range(3)]
    (tmp_path / "folder=0" / "part-0").write_text("\n".join([*lines, "{broken", json.dumps({"run_id": "f"})]) + "\n")
    found = snapshots.scan_checkpoints(spark, str(tmp_path), prefix="folder=", file="part-*", lines=True)
    assert rows(snapshots.run_status(found), "run_id", "experiments") == [("f", 0), ("r0", 0), ("r1", 1), ("r2", 2)]


def test_run_status_writes_no_file_per_run(spark, tmp_path, monkeypatch):
    from runsight.queries import files

    spark.range(900).selectExpr("id AS event_id", "id % 300 AS user_id", "'purchase' AS event_type", "1.0D AS value", "'' AS props", "timestamp_seconds(id) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(files, "scratch", lambda _: str(tmp_path / "states"))
    out = files.run_status(spark, str(tmp_path))
    assert rows(out, "run_id", "experiments") == sorted((f"run-{i}", 3) for i in range(300))
    assert len(list((tmp_path / "states").rglob("part-*"))) <= logs.BUCKETS


def test_checkpoint_round_trip_ignores_unknown_and_fills_missing(spark, tmp_path):
    path = str(tmp_path / "c")
    snapshots.write_checkpoint(spark.createDataFrame([("r", 4, "x")], "run_id string, experiment_count long, unknown string"), path)
    row = snapshots.read_checkpoint(spark, path).first()
    assert (row["run_id"], row["experiment_count"], row["best_metric"]) == ("r", 4, None) and "unknown" not in row


def test_answers_share_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\0three\n\0")
    (tmp_path / "b.txt").write_text("four\0")
    assert rows(logs.read_answers(spark, str(tmp_path), end="\0"), "value") == [("four",), ("one\ntwo\n",), ("three\n",)]
    assert logs.read_answers(spark, str(tmp_path / "b.txt")).first()["value"] == "four\0"
    assert logs.read_answers(spark, str(tmp_path / "none"), end="\0").count() == 0


def test_read_answers_writes_no_file_per_conversation(spark, tmp_path, monkeypatch):
    from runsight.queries import files

    turns = spark.range(900).selectExpr("id % 300 AS conv_id", "CAST(id AS int) AS turn", "'user' AS role", "'x' AS text")
    turns.unionByName(spark.sql("SELECT CAST(NULL AS long) AS conv_id, 1 AS turn, 'user' AS role, 'x' AS text")).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(files, "scratch", lambda _: str(tmp_path / "texts"))
    out = {(r.conv_id, r.n) for r in files.read_answers(spark, str(tmp_path)).collect()}
    assert out == {(i, 3) for i in range(300)} | {(None, 1)}
    assert len(list((tmp_path / "texts").rglob("part-*"))) < 100


def test_artifact_priority(spark):
    files = spark.createDataFrame([("a", "best_adapter"), ("a", "best_model.pt"), ("b", "notes"), ("c", "best_adapter")], "run_id string, name string")
    assert rows(snapshots.choose_artifact(files)) == [("a", "best_model.pt"), ("c", "best_adapter")]


def test_short_lived_tables_go_and_lasting_ones_stay(spark):
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    from runsight.session import materialize, short_lived

    with short_lived(spark):
        gone, kept = materialize(spark.range(3)), materialize(spark.range(4), lasting=True)
        assert gone.count() == 3
    assert kept.count() == 4
    with pytest.raises((PySparkException, Py4JError)):
        gone.collect()


def test_shuffle_files_go_with_the_query_that_wrote_them(spark):
    from runsight.session import materialize, shuffles_given_up

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    shuffles = lambda: {f for f in files() if f.startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(name)
    with shuffles_given_up(spark):
        kept = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert not shuffles() - before
    assert kept.count() == 7 and spark.conf.get(name) == setting
