"""Restarts, replays and late rows of the streaming jobs."""
import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from ulasan.operators.dedupe import order_key
from ulasan.session import scratch_path
from ulasan.streaming import epochs, jobs

EVENTS = "event_id long, ts timestamp, event_type string"


def add_file(spark, rows, path, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def forget_last_commit(checkpoint):
    """As if the driver died between the sink's commit and Spark's."""
    local = checkpoint.removeprefix("file://")
    last = max((f for f in glob.glob(f"{local}/commits/*") if os.path.basename(f).isdigit()), key=lambda f: int(os.path.basename(f)))
    os.rename(last, f"{last}.forgotten")
    for crc in glob.glob(f"{local}/commits/.{os.path.basename(last)}.crc"):
        os.rename(crc, f"{crc}.forgotten")
    return int(os.path.basename(last))


def day(i, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i, hours=hour)


def test_an_epoch_is_replaced_whole_and_seen_only_when_committed(spark):
    sink = scratch_path(spark, "epochs")
    assert epochs.read_epochs(spark, sink) is None
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    epochs.write_epoch(frame(1, 2), sink, 0)
    epochs.write_epoch(frame(3), sink, 1)
    epochs.write_epoch(frame(1, 2, 5), sink, 0)
    frame(99).withColumns({"epoch": F.lit(2), "attempt": F.lit("dead")}).write.mode("append").partitionBy("epoch", "attempt").parquet(sink + "/data")
    assert sorted(map(tuple, epochs.read_epochs(spark, sink).select("epoch", "x").collect())) == [(0, 1), (0, 2), (0, 5), (1, 3)]


def test_scoring_finds_each_line_once_after_a_replay(spark):
    src, sink, ck = (scratch_path(spark, n) for n in ("lines", "scored", "score_ck"))
    predict = lambda rows: rows.select("row_id", F.upper("text").alias("prediction"))

    def run():
        jobs.score_stream(spark.readStream.option("maxFilesPerTrigger", 1).text(src), predict, sink, ck).awaitTermination()

    for part in (["a", " b ", "", "EXIT"], ["c", "a"]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(src)
    run()
    want = [("a", "A"), ("a", "A"), ("b", "B"), ("c", "C")]
    assert sorted(map(tuple, jobs.read_scored(spark, sink).collect())) == want
    again = forget_last_commit(ck)
    run()
    assert spark.read.parquet(sink + "/commits").where(F.col("epoch") == again).count() == 2
    assert sorted(map(tuple, jobs.read_scored(spark, sink).collect())) == want


def test_dedupe_is_exact_over_restart_and_replay_and_reads_its_days_only(spark):
    src, sink, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src).withColumn("day", F.to_date("ts"))
        jobs.dedupe_ingest(stream, "event_id", order_key(F.col("event_type")), sink, ck, day="day").awaitTermination()

    add_file(spark, [(i, day(i % 10), "b") for i in range(100)] + [(5, day(5), "a"), (1000, None, "n")], src)
    run()
    add_file(spark, [(i, day(i % 10), "c") for i in range(0, 200, 10)] + [(1000, None, "again"), (1001, None, "n")], src)
    run()
    forget_last_commit(ck)
    run()
    got = {r.event_id: r.event_type for r in jobs.read_ingested(spark, sink).collect()}
    assert jobs.read_ingested(spark, sink).count() == len(got) == 100 + 10 + 2
    assert got[5] == "a" and got[10] == "b" and got[150] == "c" and got[1000] == "n"
    batch = spark.createDataFrame([(7, dt.date(2024, 1, 3))], "event_id long, day date")
    seen = jobs._earlier(batch, "event_id", sink, 99, "day")
    read = [f for f in seen.inputFiles() if "/data/" in f]
    assert "PartitionFilters" in seen._jdf.queryExecution().executedPlan().toString()
    assert seen.count() == 10 and read
    scanned = seen._jdf.queryExecution().executedPlan().toString()
    assert "day" in scanned.split("PartitionFilters: [")[1].split("]")[0]


def test_daily_counts_take_late_rows_within_the_delay_and_evict_older_days(spark):
    src, sink, ck = (scratch_path(spark, n) for n in ("in", "daily", "ck"))

    def run(rows):
        add_file(spark, rows, src)
        q = jobs.daily_counts(spark.readStream.schema(EVENTS).parquet(src), "ts", "event_type", sink, ck, delay="2 days")
        q.awaitTermination()
        return q

    run([(i, day(0, i), "a") for i in range(5)] + [(9, day(1), "b")])
    run([(20, day(1, 5), "a"), (21, day(0, 9), "a")])                       # late by a day
    q = run([(30, day(9), "a")])
    q = run([(31, day(0, 3), "a"), (32, day(8), "a"), (33, day(9), "a")])     # the first comes too late
    got = {(r.day, r.event_type): r.n for r in jobs.read_daily(spark, sink, "event_type").collect()}
    assert got == {("2024-01-01", "a"): 6, ("2024-01-02", "b"): 1, ("2024-01-02", "a"): 1, ("2024-01-09", "a"): 1, ("2024-01-10", "a"): 2}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2          # the days of January 1 and 2 are gone
    forget_last_commit(ck)
    jobs.daily_counts(spark.readStream.schema(EVENTS).parquet(src), "ts", "event_type", sink, ck, delay="2 days").awaitTermination()
    assert {(r.day, r.event_type): r.n for r in jobs.read_daily(spark, sink, "event_type").collect()} == got
