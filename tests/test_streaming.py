import datetime as dt

from quillstone.operators.intervals import periods_and_gaps
from quillstone.streaming import streams
from tests.conftest import rows


def run(query):
    query.processAllAvailable()
    query.stop()


def test_windows_equal_the_batch(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    data = [(i, t + dt.timedelta(minutes=13 * i), i % 3, "view" if i % 2 else "click", float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.tumbling(streams.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    run(s)
    assert sum(r["n"] for r in spark.sql("select * from w").collect()) == 60
    s = streams.sessions(streams.event_stream(spark, str(tmp_path / "in")), "40 minutes").writeStream.format("memory").queryName("s").outputMode("complete").start()
    run(s)
    assert {(r["user_id"], r["n"]) for r in spark.sql("select * from s").collect()} == {(0, 20), (1, 20), (2, 20)}


def test_interval_state_equals_the_batch_operator(spark, tmp_path):
    schema = "key string, start int, end int"
    parts = [[("a", 0, 5), ("b", 1, 2), ("a", 10, 12)], [("a", 5, 7), ("a", 6, 11), ("b", None, 3)], [("b", 4, 9), ("b", 9, 9)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(streams.interval_state(stream).writeStream.format("memory").queryName("iv").outputMode("update").start())
    got = {}
    for r in spark.sql("select * from iv").collect():
        got[r["key"]] = max(got.get(r["key"], (0, 0, 0)), (r["covered_days"], r["n_periods"], r["n_gaps"]))
    batch = {}
    for k, kind, s, e, _ in rows(periods_and_gaps(spark.createDataFrame(sum(parts, []), schema), "key", "start", "end")):
        c = batch.setdefault(k, [0, 0, 0])
        c[0] += e - s if kind == "PERIOD" else 0
        c[1 if kind == "PERIOD" else 2] += 1
    assert got == {k: tuple(v) for k, v in batch.items()}


def test_upsert_stream(spark, tmp_path):
    schema = "k string, p int, v string"
    for batch in ([("a", 1, "x")], [("a", 2, "y"), ("b", 1, "z")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.upsert_stream(stream, str(tmp_path / "t"), ["k"], "p", str(tmp_path / "c"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [("a", 2, "y"), ("b", 1, "z")]
