"""Jobs as a stream of events against the same rule on a table."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fieldstone.streaming import jobs, leases

START = dt.datetime(2024, 1, 1)
SCHEMA = "job_id long, at timestamp, event string"


def test_rule():
    go = lambda *events: [(s, n, why) for _, s, n, why in sum(run(events), [])]

    def run(events):
        state, out = (None, 0, 0), []
        for at, event in events:
            state, more = leases.applied(state, at, event, 30, 5, 3)
            out.append(more)
        return out

    assert go((0, "ENQUEUED"), (1, "CLAIMED"), (2, "FAILED"), (3, "CLAIMED"), (7, "CLAIMED")) == [("QUEUED", 0, "ENQUEUED"), ("RUNNING", 1, "CLAIMED"), ("QUEUED", 1, "FAILED"), ("RUNNING", 2, "CLAIMED")]
    assert go((0, "ENQUEUED"), *((t, e) for k in range(3) for t, e in ((10 * k, "CLAIMED"), (10 * k + 1, "FAILED"))))[-1] == ("DEAD", 3, "FAILED")
    assert go((0, "ENQUEUED"), (1, "CLAIMED"), (31, "SUCCEEDED"))[-1] == ("QUEUED", 1, "LEASE_EXPIRED")
    assert go((0, "SUCCEEDED"), (1, "CLAIMED"), (2, "ENQUEUED"), (3, "ENQUEUED")) == [("QUEUED", 0, "ENQUEUED")]


def test_stream_with_restart_equals_the_table(spark, tmp_path):
    chance = random.Random(6)
    rows = []
    for job in range(25):
        at = START + dt.timedelta(seconds=chance.randrange(4000))
        rows.append((job, at, "ENQUEUED"))
        for _ in range(chance.randrange(0, 8)):
            at += dt.timedelta(seconds=chance.choice([20, 90, 700, 2000]))
            rows.append((job, at, chance.choice(["CLAIMED", "CLAIMED", "FAILED", "FAILED", "SUCCEEDED", "ENQUEUED"])))
    chance.shuffle(rows)  # events come in any order
    end = START + dt.timedelta(days=3)
    source, out = str(tmp_path / "events"), str(tmp_path / "changes")

    def arrive(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = leases.changes(jobs.read(spark, source, SCHEMA, files=1), late="1 day")
        with leases.store(spark):
            jobs.drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append"))

    arrive(rows[: len(rows) // 2])
    drain()
    arrive(rows[len(rows) // 2 :])
    drain()  # a new query, from the checkpoint
    arrive([(-1, end, "ENQUEUED")])  # moves the watermark on, beyond all leases
    drain()
    plain = lambda df: sorted((r.job_id, r.at, r.status, r.attempts, r.reason) for r in df.where("job_id >= 0").collect())
    got = plain(spark.read.parquet(out))
    want = plain(leases.changes_by_batch(spark.createDataFrame(rows, SCHEMA), "2024-01-03"))
    assert got == want and {x[2] for x in got} >= {"QUEUED", "RUNNING", "SUCCEEDED"} and any(x[4] == "LEASE_EXPIRED" for x in got)
    assert spark.read.parquet(out).where(F.col("status") == "DEAD").count() == sum(x[2] == "DEAD" for x in want)
