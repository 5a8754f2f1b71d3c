from pyspark.sql import functions as F

from echolattice.config import CONSTANT_Q
from echolattice.operators.monitor import monitor as batch_monitor
from echolattice.streaming import monitor

SMALL = CONSTANT_Q.but(sample_rate=128)


def test_closed_windows_equal_the_batch_ones(spark, tmp_path):
    """Whole windows only, none before 0, both ends inclusive, each matched once, late prints dropped: what the batch gives of the recordings without them."""
    rows = [(r, i * 10, t, 5) for r, n in ((7, 60), (8, 47)) for i, t in enumerate(range(n))]
    prints = spark.createDataFrame(rows, "resource_id int, hash bigint, t1 int, f1 int")
    index = prints.where("resource_id = 7").withColumn("resource_id", F.lit(3)).withColumn("t1", F.col("t1") + 100)
    durations = spark.createDataFrame([(7, 60.0), (8, 47.0)], "resource_id int, duration double")
    timed = prints.withColumn("at", F.timestamp_seconds(F.col("t1") + F.col("resource_id") * 3))
    for k, part in enumerate((timed.where("t1 < 30"), timed.where("t1 >= 30"), spark.createDataFrame([(9, -50, 0, 0)], prints.schema).withColumn("at", F.timestamp_seconds(F.lit(10_000))), timed.where("t1 = 5"))):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if k == 0:
            stream = spark.readStream.schema(timed.schema).parquet(f"file://{tmp_path}/in")
            out = []
            run = monitor.start(stream, index, SMALL, f"file://{tmp_path}/state", lambda found, batch: out.extend(found.collect()), durations=durations).start()
        run.processAllAvailable()
    run.stop()
    want = batch_monitor(prints, index, durations, SMALL, most=1)
    key = lambda r: (r.resource_id, r.start, r.ref_id, r.score, r.query_start, r.query_stop, r.ref_start, r.ref_stop)
    got = sorted(map(key, out))
    assert got == sorted(map(key, want.collect())) and [g[:4] for g in got] == [(7, 0.0, 3, 26), (7, 20.0, 3, 26), (8, 0.0, 3, 26), (8, 20.0, 3, 26)]
