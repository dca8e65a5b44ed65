"""Files in and out, and streams against batches."""

import json

from pyspark.sql import functions as F

from docquarry.sources import files
from docquarry.streaming import streams


def test_folder_and_json_lines(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 text")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pdf").write_bytes(b"x")
    assert files.folder(spark, str(tmp_path), "*.pdf").count() == 1
    assert files.folder(spark, str(tmp_path), "*.pdf", recursive=True, content=False).count() == 2
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    path = str(tmp_path / "x.jsonl")
    assert sorted(r["id"] for r in files.json_lines(spark, path, "id long").collect()) == [1, 2]
    assert files.malformed(spark, path, spark.createDataFrame([], "id long").schema).count() == 1


def test_listing_by_prefix_time_and_size(spark, tmp_path):
    import os

    for name, size in (("in/2024-01/a.pdf", 200), ("in/2024-02/b.pdf", 50), ("in/2025-01/c.pdf", 300), ("in/2024-01/d.txt", 400), ("out/2024-01/e.pdf", 200)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    os.utime(tmp_path / "in/2024-01/a.pdf", (1_000_000_000, 1_000_000_000))
    names = lambda df: sorted(r["name"] for r in df.collect())
    root = str(tmp_path)
    assert names(files.folder(spark, root, "*.pdf", recursive=True, prefix="in/2024-")) == ["a.pdf", "b.pdf"]
    assert names(files.folder(spark, root, "*.pdf", recursive=True, prefix="in/", least=files.LEAST, most=files.MOST)) == ["a.pdf", "c.pdf"]
    assert names(files.folder(spark, root, "*.pdf", recursive=True, prefix="in/", after="2020-01-01T00:00:00")) == ["b.pdf", "c.pdf"]
    assert [(r["name"], r["size"]) for r in files.listing(spark, root, "*.txt").collect()] == [("d.txt", 400)]
    plan = files.folder(spark, root, recursive=True, least=100)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), GreaterThanOrEqual(length,100)" in plan


def test_small_files_share_tasks(spark, tmp_path):
    spark.range(60).selectExpr("cast(id as string) text").coalesce(2).transform(lambda df: files.write_files(df, str(tmp_path / "f"), "text") or df)
    read = lambda: files.folder(spark, str(tmp_path / "f"), "*.txt")
    with files.bundles(spark, 16 << 10, 8 << 10):
        assert read().rdd.getNumPartitions() >= 20
    with files.bundles(spark):
        df = read()
        assert df.rdd.getNumPartitions() <= 4 and df.count() == 60


def test_a_rerun_reaches_open_targets_only(spark, tmp_path):
    df, written, down = spark.range(3), [], [True]

    def flaky(x):
        if down[0]:
            raise ConnectionError("down")
        written.append(("b", x.count()))

    targets = {"a": lambda x: written.append(("a", x.count())), "b": flaky}
    status = lambda rows: sorted((r["target"], r["attempt"], r["went"], r["error"]) for r in rows.collect())
    assert status(files.load(df, targets, str(tmp_path / "l"), 7)) == [("a", 1, True, ""), ("b", 1, False, "down")]
    down[0] = False
    assert status(files.load(df, targets, str(tmp_path / "l"), 7)) == [("a", 1, True, ""), ("b", 1, False, "down"), ("b", 2, True, "")]
    files.load(df, targets, str(tmp_path / "l"), 7)
    files.load(df, {"a": targets["a"]}, str(tmp_path / "l"), 8)
    assert written == [("a", 3), ("b", 3), ("a", 3)]


def test_a_day_is_rewritten_alone_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = spark.sql("select id, date_add(date '2024-02-27', cast(id as int)) d, 1 v from range(5)")
    files.write_by_day(rows, path, "d")
    files.write_by_day(rows.where("id = 2").withColumn("v", F.lit(2)), path, "d")
    read = spark.read.parquet(path)
    assert sorted((r["id"], r["v"]) for r in read.collect()) == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 1)]
    one = read.where("year = 2024 and month = 2 and day = 29")
    assert [r["id"] for r in one.collect()] == [2]
    assert one._jdf.queryExecution().executedPlan().execute().getNumPartitions() == 1
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_manifest_reports_missing_truth(spark, tmp_path):
    (tmp_path / "t1.json").write_text("{}")
    rows = spark.createDataFrame([(1, "t1.json"), (2, "t2.json")], "id int, truth_path string")
    found, missing = files.manifest(rows, files.folder(spark, str(tmp_path), "*.json"))
    assert [r["id"] for r in found.collect()] == [1] and [r["id"] for r in missing.collect()] == [2]


def test_all_layouts_give_regions(spark, tmp_path):
    cell = {"text": "Total", "bbox": [1, 2, 3, 4], "confidence": 0.9}
    low = {"text": "noise", "bbox": [1, 2, 3, 4], "confidence": 0.2}
    shapes = {"pages": {"pages": [{"elements": [cell, low]}]}, "text_regions": {"text_regions": [cell, low]}, "text_blocks": {"text_blocks": [cell]}, "tokens": {"tokens": ["Total", "noise"], "bboxes": [[1, 2, 3, 4], [0, 0, 0, 0]], "confidences": [0.9, 0.1]}}
    for layout, record in shapes.items():
        path = tmp_path / f"{layout}.jsonl"
        path.write_text(json.dumps({"id": 1, **record}))
        df = files.json_lines(spark, str(path), f"id long, {files.LAYOUTS[layout]}")
        assert [(r["text"], r["x"], r["h"]) for r in files.regions_of(df, "id", layout).collect()] == [("Total", 1.0, 4.0)], layout


def test_sinks(spark, tmp_path):
    df = spark.sql("select 1 id, 'ocr' stage, date '2024-03-05' day, 'wrong' error union all select 2, 'parsed', date '2024-03-06', 'missing'")
    files.write_stage(df, str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s")).where("stage = 'ocr'")
    assert read.count() == 1 and "PartitionFilters: [isnotnull(stage" in read._jdf.queryExecution().executedPlan().toString()
    files.write_by_day(df, str(tmp_path / "d"), "day")
    assert (tmp_path / "d" / "year=2024" / "month=03" / "day=05").exists()
    files.write_error_log(df, str(tmp_path / "e"))
    assert files.replay(spark, str(tmp_path / "e"), "id long, error string").count() == 2

    def broken(_):
        raise ValueError("no room")

    got = files.write_targets(df, {"bad": broken, "csv": lambda x: files.write_csv(x, str(tmp_path / "c"))})
    assert [(n, ok) for n, ok, _ in got] == [("bad", False), ("csv", True)]
    files.write_parent_and_child(df.select("id"), df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "line_items")).count() == 2


def test_stream_sinks(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([(1, 1, 500.0, "2024-01-01 00:00:00"), (2, 1, 400.0, "2024-01-01 01:00:00"), (3, 1, 10.0, "2024-01-01 02:00:00"), (4, 1, 10.0, "2024-01-03 00:00:00")], "event_id int, tenant long, quantity double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), rows.schema)
    seen = []
    streams.to_targets(stream, lambda df, epoch: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 4
    streams.to_parquet(streams.once_each(stream, "event_id"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("x")
    assert streams.run(files.folder_stream(spark, str(tmp_path / "files")), "files_test").count() == 1


def test_events_of_a_folder_are_streamed(spark, data, tmp_path):
    from docquarry.plans import streams as P

    rows = spark.read.parquet(f"{data}/events.parquet").limit(60)
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert streams.run(P.events(spark, str(tmp_path)).select("event_id"), "of_folder").count() == rows.count() == 60
    assert streams.run(P.events(spark, data).select("event_id"), "of_file").count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_stream_results_are_files_of_the_shared_folder(spark, data):
    from docquarry.plans import streams as P

    shared = spark.conf.get("spark.checkpoint.dir")
    usage = P.usage(spark, data)
    for mode, df in (("append", usage), ("update", streams.usage_windows(usage, "1 day")), ("complete", usage.groupBy("tenant").count())):
        out = streams.run(df, f"files_{mode}", mode)
        assert out.count() > 0 and out.columns == df.columns
        assert all(f.startswith(f"file://{shared}/") for f in out.inputFiles())




def test_a_file_for_each_row_is_written_by_its_task(spark, tmp_path):
    rows = spark.sql("select id, if(id = 3, null, if(id in (4, 5), 'same', concat('täxt\\n', id))) text, if(id = 7, null, id % 2) shelf from range(40)").repartition(3)
    files.write_files(rows, f"file://{tmp_path}/by", "text", "shelf")
    files.write_files(rows.where("id < 9"), str(tmp_path / "flat"), "text")
    files.write_files(rows.where("id >= 9"), str(tmp_path / "flat"), "text")
    want = sorted((r["text"] or "") + "\n" for r in rows.collect())
    for folder, shelves in (("by", {"shelf=0", "shelf=1", "shelf=__HIVE_DEFAULT_PARTITION__"}), ("flat", set())):
        left = [p for p in (tmp_path / folder).rglob("*") if p.is_file()]
        # a checksum beside each would have been a process each
        assert all(p.name.startswith("part-") and p.suffix == ".txt" for p in left) and {p.parent.name for p in left} - {"flat"} == shelves
        assert sorted(p.read_text(encoding="utf-8") for p in left) == want
        assert files.folder(spark, str(tmp_path / folder), "*.txt", recursive=True).count() == 40
    many = tmp_path / "many"
    many.mkdir()
    for k in range(1100):
        (many / f"{k}.txt").write_text("x")
    df = files.bundled(files.folder(spark, str(many), "*.txt"), 2)
    assert df.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and df.count() == 1100


def test_a_micro_batch_lists_and_reads_its_files_in_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(300):
        (tmp_path / "in" / f"{k}.txt").write_text("x")
    with files.bundles(spark):
        q = streams.to_parquet(files.folder_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"))
        q.awaitTermination()
    seen = spark.sparkContext.statusTracker()
    tasks = sum(seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup(str(q.runId)) for s in seen.getJobInfo(j).stageIds)
    assert 0 < tasks <= 10 * spark.sparkContext.defaultParallelism and spark.read.parquet(str(tmp_path / "out")).count() == 300
