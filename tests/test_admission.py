"""Starts of calls against the waiting worker itself, and windows that close against a plain count."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import admission, extraction
from loomgraph.streaming import incremental


def waited(rows, calls, seconds):
    """Starts by the throttle of a worker whose clock stands still but for its sleep."""
    out = {}
    for key in {r[1] for r in rows}:
        now = [0]
        throttle = extraction.Throttle(calls, seconds * 1_000_000, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
        for seq, _, at in sorted((r for r in rows if r[1] == key and r[2] is not None), key=lambda r: (r[2], r[0])):
            now[0] = max(now[0], at)
            throttle.wait()
            out[seq] = now[0]
    return out


@pytest.mark.parametrize("calls,seconds,turns", [(1, 5, 2), (3, 7, 1), (4, 60, 1000), (2, 0, 3)])
def test_starts_equal_the_waiting_worker(spark, calls, seconds, turns):
    rng = random.Random(calls * seconds + turns)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *[rng.randrange(90) * 1_000_000 for _ in range(9)]])) for i in range(120)]
    requests = spark.createDataFrame(rows, "seq long, who string, at long")
    found = admission.admitted(requests, "who", "at", "seq", calls, seconds, turns).collect()
    assert len(found) == len(rows)
    want = waited(rows, calls, seconds)
    assert {r.seq: r.begins for r in found} == {seq: want.get(seq) for seq, _, _ in rows}


def test_no_requests_and_no_calls(spark):
    none = spark.createDataFrame([], "seq long, who string, at long")
    assert admission.admitted(none, "who", "at", "seq").collect() == []
    with pytest.raises(ValueError):
        admission.admitted(none, "who", "at", "seq", calls=0)


def test_late_events_and_repeats_are_left_out_and_windows_close_once(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=d, hours=h)
    batches = [
        [(1, day(0), "a"), (2, day(0, 5), "a"), (1, day(0), "a"), (3, None, "a")],
        [(4, day(5), "b"), (2, day(0, 5), "a")],  # 2 again, while its id is still known
        [(5, day(0, 9), "a"), (6, day(3, 1), "b"), (7, day(9), "a")],  # 5 is late, 6 is not
        [(8, day(20), "a")],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
        incremental.append(incremental.closed_counts(stream), str(tmp_path / "out"), str(tmp_path / "mark")).start().awaitTermination()
        found = spark.read.schema("start timestamp, event_type string, n long").parquet(str(tmp_path / "out"))
        seen.append(sorted((int((r.s - day(0).timestamp()) // 86400), r.event_type, r.n) for r in found.select(F.unix_seconds("start").alias("s"), "event_type", "n").collect()))
    assert seen[1] == [(0, "a", 2)]
    assert seen[2] == [(0, "a", 2), (3, "b", 1), (5, "b", 1)]
    assert seen[3] == [(0, "a", 2), (3, "b", 1), (5, "b", 1), (9, "a", 1)]
