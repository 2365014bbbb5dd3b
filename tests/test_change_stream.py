"""The stateful stream of changes against its batch form, with the events in several files."""

from pyspark.sql import functions as F

from pagegrain.sources.tables import table
from pagegrain.streaming.events import change_stream, read_events

DIR = "/root/testdata/sf0.001"


def test_change_stream(spark, tmp_path):
    events = table(spark, DIR, "events").where("event_id is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = events.agg(F.percentile_approx(at, 0.5)).first()[0]
    for i, part in enumerate((at <= cut, at > cut)):
        events.where(part).coalesce(1).write.parquet(str(tmp_path / f"events/{i}"))
    stream = read_events(spark, str(tmp_path / "events/*"))
    out = change_stream(stream, ("error",))
    run = out.writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.job, r.event_id, r.status, r.progress) for r in spark.table("changes").collect()}
    want, jobs = set(), {}
    for e in events.orderBy("ts", "event_id").collect():
        now = (e.event_type, min(100, int(e.value // 5)))
        last = jobs.get(e.user_id)
        if last is None or (last != now and last[0] != "error"):
            want.add((e.user_id, e.event_id, *now))
        if last is None or last[0] != "error":
            jobs[e.user_id] = now
    assert got == want and got
