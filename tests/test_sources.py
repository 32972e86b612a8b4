import re

import pytest
from pulsegrid.sources import files, readers
from pulsegrid.streaming import windows
from pyspark.sql import functions as F


def test_recordings_store_and_results(spark, tmp_path):
    names = readers.CAMPAIGNS[1]
    for subject, condition, n in (("S01", "C1", 3), ("S02", "C2", 0)):
        folder = tmp_path / "in" / subject / condition
        folder.mkdir(parents=True)
        rows = [" ".join(str(i + j / 10) for j in range(len(names) - 1)) + " _" for i in range(n)]
        (folder / "rec.txt").write_text(" ".join(names) + "\n" + "\n".join(rows) + ("\n" if rows else ""))
    got = readers.read_recordings(spark, str(tmp_path / "in"))
    rows = got.orderBy("idx").collect()
    assert [(r["subject"], r["condition"], r["idx"], r["trigger"]) for r in rows] == [("S01", "C1", i, "_") for i in range(3)]
    assert readers.read_recordings(spark, str(tmp_path / "in"), drop_first=True).count() == 2
    readers.write_store(got, str(tmp_path / "store"))
    assert readers.read_store(spark, str(tmp_path / "store"), "S01", "C1").count() == 3
    with pytest.raises(KeyError):
        readers.read_store(spark, str(tmp_path / "store"), "S09", "C1")
    names = [r["name"] for r in readers.select_files(spark, str(tmp_path / "in"), "rec", ".txt", "ec").collect()]
    assert names == ["rec.txt"] * 2
    results = spark.createDataFrame([("a", 1.5), ("b", None), ("c", float("nan"))], "rec string, v double")
    readers.export_results(results, str(tmp_path / "json"))
    assert sorted((r["rec"], r["v"]) for r in readers.import_results(spark, str(tmp_path / "json"), "rec string, v double").collect() if r["v"]) == [("a", 1.5)]
    with pytest.raises(Exception):
        readers.export_results(results, str(tmp_path / "json"))


def test_wearables_logs_and_tables(spark, tmp_path):
    for kind, lines in {"eda": ["100.0", "4.0", *map(str, range(9))], "acc": ["100.0,100.0,100.0", "32.0,32.0,32.0", *["64,0,-32"] * 40]}.items():
        (tmp_path / kind / "r1").mkdir(parents=True)
        (tmp_path / kind / "r1" / f"{kind}.csv").write_text("\n".join(lines))
    got = readers.read_wearable(spark, {"eda": str(tmp_path / "eda"), "acc": str(tmp_path / "acc")}).orderBy("tick").collect()
    assert [r["tick"] for r in got] == list(range(10))
    assert [r["eda"] for r in got] == [0, None, 1, None, 2, None, 3, None, 4, None] and got[3]["accel_x"] == 1 and got[3]["accel_z"] == -0.5
    (tmp_path / "m.csv").write_text("junk\nTimestamp,Shimmer EDA uS\nms,uS\n0,1.5\n1,x\n")
    rows = readers.read_mapped(spark, str(tmp_path / "m.csv"), {"eda": "EDA", "temp": "Temp"}, skip=1).orderBy("tick").collect()
    assert [(r["eda"], r["temp"]) for r in rows] == [(1.5, 0.0), (None, 0.0)]
    (tmp_path / "k.csv").write_text("cell|v\nA|1\nB|2\n")
    kpi = readers.read_kpi(spark, str(tmp_path / "k.csv"), "cell string, v int", "|")
    readers.write_csv(kpi, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    log = tmp_path / "log" / "S" / "C"
    log.mkdir(parents=True)
    (log / "can.txt").write_text("Time Event Score\n1.5 go 2\n")
    assert readers.read_log(spark, str(tmp_path / "log")).first().asDict() == {"subject": "S", "condition": "C", "time": 1.5, "trigger": "go", "score": 2.0}
    (tmp_path / "ivl.csv").write_text("subject,condition,slalom,start,end\nS,C,0,1,2\n")
    assert readers.read_intervals(spark, str(tmp_path / "ivl.csv")).first()["end"] == 2.0


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = windows.windowed_statistics(stream, ["user_id"], "value", size="1 day", late="60 days").writeStream.format("memory").queryName("streamed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r["user_id"], r["start"], r["n"], round(r["mean"], 9))
    assert sorted(map(key, spark.table("streamed").collect())) == sorted(map(key, windows.windowed_statistics(events, ["user_id"], "value", size="1 day").collect()))
    assert windows.phase_sessions(events, ["user_id"], "1 day").agg(F.sum("n")).first()[0] == events.count()


def test_files_of_recordings_stay_whole_when_partitions_are_coalesced(spark):
    from pulsegrid.jobs import registry

    found, sf = registry.queries(), "/root/testdata/sf0.01"
    changed = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        values = spark.read.parquet(f"{sf}/events.parquet").agg(F.count("*"), F.round(F.sum("value"), 2)).first()
        for name in ("s6_wearables", "s7_mapped_columns"):
            assert found[name](spark, sf).agg(F.count("*"), F.round(F.sum("eda"), 2)).first() == values, name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_store_without_folders_takes_no_file_a_recording(spark, tmp_path):
    rows = spark.range(600).selectExpr("cast(id div 3 as string) AS subject", "concat('C', (id div 3) % 2) AS condition", "id % 3 AS idx", "id AS v").repartition(3)
    path = str(tmp_path / "store")
    readers.write_store(rows, path, folders=False)
    assert readers.select_files(spark, path, "part-", ".parquet").count() <= 16
    assert [r["v"] for r in readers.read_store(spark, path, "7", "C1").orderBy("idx").collect()] == [21, 22, 23]
    with pytest.raises(KeyError):
        readers.read_store(spark, path, "7", "C0")


def test_a_file_for_each_group_comes_from_its_task(spark, tmp_path):
    """Written whole under its name by the task, without the checksum file and the commit that Hadoop adds to each."""
    path = str(tmp_path / "files")
    sizes = {"a": 3, "b/c=%": 25_000, None: 2}
    rows = [(k, i, None if i == 1 else f"{k} {i}") for k, n in sizes.items() for i in range(n)]
    files.write_lines(spark.createDataFrame(rows, "k string, i int, value string").repartition(3), path, ["k"], ["i"], "top\n")
    found = [p for p in (tmp_path / "files").rglob("*") if p.is_file() and p.name != "_SUCCESS"]
    assert {p.parent.name for p in found} == {"k=a", "k=b%2Fc%3D%25", "k=__HIVE_DEFAULT_PARTITION__"} and len(found) == 3
    for p in found:
        k = {"k=a": "a", "k=b%2Fc%3D%25": "b/c=%"}.get(p.parent.name)
        assert p.read_text().split("\n") == ["top", *("" if i == 1 else f"{k} {i}" for i in range(sizes[k])), ""]
    assert {r["k"]: r["count"] for r in spark.read.text(path).where("value <> 'top'").groupBy("k").count().collect()} == sizes
    with pytest.raises(FileExistsError):
        files.write_lines(spark.createDataFrame(rows, "k string, i int, value string"), path, ["k"], ["i"])


def test_store_and_csv_files_read_back(spark, tmp_path):
    rows = spark.range(300).selectExpr("cast(id % 7 as string) AS subject", "'C' AS condition", "id AS idx", "id / 3 AS x", "timestamp_seconds(id) AS t", "if(id % 5 = 0, null, 'a b') AS z")
    for mode in ("errorifexists", "overwrite", "ignore"):
        readers.write_store(rows, str(tmp_path / "store"), mode)
        assert len([p for p in (tmp_path / "store").rglob("part-*.snappy.parquet")]) == 7
        back = spark.read.schema(rows.schema).parquet(str(tmp_path / "store")).select(*rows.columns)
        assert back.exceptAll(rows).isEmpty() and back.count() == 300
    files.write_csv_files(rows, str(tmp_path / "csv"), ["subject", "condition"], ["idx"], ["idx", "x", "z"], " ")
    back = spark.read.csv(str(tmp_path / "csv"), sep=" ", header=True, schema="idx long, x double, z string")
    assert back.select("idx", "x", "z").exceptAll(rows.select("idx", "x", "z")).isEmpty() and back.count() == 300


def test_path_pattern_is_linear(spark):
    paths = ["s/c/f.csv", "file:/x/y/s=1/c=2/f", r"C:\a\b\c.txt", "c/f", "a//c/f", "/s/c/f", "n" * 200_000]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", *(c.alias(n) for n, c in readers._keys(F.col("p")).items()))
    want = [re.search(r"([^/\\]+)[/\\]([^/\\]+)[/\\][^/\\]+$", p) for p in paths[:-1]] + [None]  # tried from everywhere, the last takes minutes
    assert [(r["subject"], r["condition"]) for r in df.collect()] == [(m[1], m[2]) if m else ("", "") for m in want]
