import json

import pytest
from pyspark.sql import functions as F

from larkspur.sources import readers, writers
from larkspur.streaming import replay


def test_csv_and_parameters_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "03/04/2020"), (1, "01/02/2020")], "id int, day string")
    writers.table(df, f"{tmp_path}/t", order=["day", "id", "absent"], kind="csv")
    got = readers.csv(spark, f"{tmp_path}/t", "day string, id int", {"day": "dd/MM/yyyy"}, "id", 1).collect()
    assert [(str(r["day"]), r["id"]) for r in got] == [("2020-02-01", 1)]
    writers.parameters(spark, {"b": 1, "a": [2]}, f"{tmp_path}/p")
    assert writers.read_parameters(spark, f"{tmp_path}/p") == {"a": [2], "b": 1} and writers.read_parameters(spark, f"{tmp_path}/none") == {}
    with pytest.raises(readers.MissingInput):
        readers.csv(spark, f"{tmp_path}/absent", "id int")


def test_json_documents_keep_their_files_names(spark, tmp_path):
    (tmp_path / "7.json").write_text(json.dumps([{"id": 1, "team": {"name": "A"}}, {"id": 2}]))
    df = readers.json_documents(spark, str(tmp_path), "id long, team struct<name: string>", "file")
    assert sorted((r["id"], r["file"], r["team"] and r["team"]["name"]) for r in df.collect()) == [(1, "7", "A"), (2, "7", None)]
    noted = readers.catalogue(spark.range(3), spark.range(2).withColumn("x", F.lit(1)), ["id"])
    assert [r["id"] for r in noted.where("note IS NOT NULL").collect()] == [2]


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3, float(i), f"2024-01-01 00:{i:02d}:00") for i in range(40)], "tick long, who int, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = replay.running(stream, "who", "tick", "value").writeStream.outputMode("update").format("memory").queryName("running_state").start()
    q.processAllAvailable()
    q.stop()
    got = {r["who"]: (r["n"], r["total"], r["eff"]) for r in spark.sql("SELECT who, max(n) AS n, max(total) AS total, max(eff) AS eff FROM running_state GROUP BY who").collect()}
    want = {r["who"]: (r["n"], r["t"], r["e"]) for r in events.groupBy("who").agg(F.count("*").alias("n"), F.sum("value").alias("t"), F.max("tick").alias("e")).collect()}
    assert got == want
    q = replay.windowed(stream, "ts", ["who"], "value", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windowed").first()[0] == 40


def plain_sessions(rows, gap):
    out = []
    for who, t, v in sorted(rows):
        if out and out[-1][0] == who and t - out[-1][2] < gap:
            out[-1] = (who, out[-1][1], t, out[-1][3] + 1, out[-1][4] + v)
        else:
            out.append((who, t, t, 1, v))
    return sorted((who, a, b + gap, n, v) for who, a, b, n, v in out)


def test_sessions_go_on_over_steps_of_the_stream(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 5000), 1.0) for _ in range(150)]
    events = spark.createDataFrame(rows, "who int, s int, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for parts in (1, 3):
        got = replay.finished(lambda e: replay.sessions(e, "ts", ["who"], "value", "90 seconds"), events, "ts", parts).where("who IS NOT NULL")
        assert sorted((r["who"], r["start"].timestamp(), r["end"].timestamp(), r["n"], r["total"]) for r in got.collect()) == plain_sessions(rows, 90)


def test_sliding_windows_count_a_row_in_each_and_tables_at_rest_are_looked_up(spark):
    events = spark.createDataFrame([(i % 2, i * 60, float(i)) for i in range(30)], "who int, s int, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = replay.finished(lambda e: replay.sliding(e, "ts", ["who"], "value", "10 minutes", "5 minutes"), events, "ts").where("who IS NOT NULL")
    assert got.agg(F.sum("n")).first()[0] == 60 and got.agg(F.max("n")).first()[0] == 5
    names = spark.createDataFrame([(0, "even")], "id int, name string")
    got = replay.finished(lambda e: replay.windowed(replay.enriched(e, names, "who", "id", ["name"]), "ts", ["who", "name"], "value", "1 hour"), events, "ts").where("who IS NOT NULL")
    assert sorted((r["who"], r["name"], r["n"]) for r in got.collect()) == [(0, "even", 15), (1, None, 15)]


def test_a_stream_without_rows_ends(spark):
    events = spark.createDataFrame([], "who int, value double, ts timestamp")
    assert replay.finished(lambda e: replay.sessions(e, "ts", ["who"], "value"), events, "ts").count() == 0
