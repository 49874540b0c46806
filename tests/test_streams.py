"""Streams against batches: turn loops, joins in time."""

import datetime as dt
import random

from lodestone.streaming import events, turns

DAY = dt.datetime(2024, 1, 1)
at = lambda hours: DAY + dt.timedelta(hours=hours)
TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


def streamed(spark, folder, batches, schema):
    """A stream with one batch for each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        files = sorted((p.stat().st_mtime_ns, p) for p in folder.glob("part-*"))
        import os

        os.utime(files[-1][1], (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_turn_loop_stream_equals_batch(spark, tmp_path):
    rows = [
        [(1, 0, "user", "hi", at(0)), (1, 1, "agent", "yes", at(1)), (2, 0, "user", "a", at(0)), (3, 0, None, None, at(2))],
        [(1, 2, "user", "FINISH now", at(3)), (2, 1, "agent", "b", at(5)), (5, 0, "user", "x", None)],
        [(1, 3, "user", "after the end", at(4)), (4, 0, "user", "late starter", at(60))],
        [(2, 2, "agent", "never heard: expired", at(61)), (4, 1, "user", "more", at(62))],
    ]
    flat = spark.createDataFrame([r for b in rows for r in b], TURNS)
    got = events.collect_changes(turns.turn_loop(streamed(spark, tmp_path / "in", rows, TURNS), 3, "finish", "1 day", "1 hour"))
    states = {r.conv_id: (r.turns, r.roles, r.state, r.ended) for r in turns.latest_change(got).collect()}
    assert states[1] == (3, "agent:1,user:2", "COMPLETED", at(3)) and states[4] == (2, "user:2", "PENDING", at(62))
    assert states[2] == (2, "agent:1,user:1", "EXPIRED", at(5)) and states[3] == (1, ":1", "EXPIRED", at(2)) and 5 not in states
    whole = {r.conv_id: (r.turns, r.roles, r.state, r.ended) for r in turns.turn_loop(flat, 3, "finish", "1 day", "1 hour").collect()}
    assert whole == states
    seen = {(r.conv_id, r.state) for r in got.collect()}
    assert {(1, "PENDING"), (1, "COMPLETED"), (2, "PENDING"), (2, "EXPIRED")} <= seen


def test_join_in_time_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    schema = "id long, ts timestamp, text string"
    refs = [[(i, at(i + 0.01 * b), f"r{i}-{b}") for i in range(8 * b, 8 * b + 8)] for b in range(4)] + [[(None, at(40), "no id"), (90, None, "no time"), (99, at(41), "alone")]]
    hyps = [[(i, at(i + rnd.choice([-0.2, 0.3, 2.0])), f"h{i}-{b}") for i in range(8 * b, 8 * b + 8) for _ in range(2)] for b in range(4)] + [[(None, at(40), "no id"), (98, at(41), "alone")]]
    (tmp_path / "s").mkdir()
    flat = [spark.createDataFrame([r for b in x for r in b], schema) for x in (refs, hyps)]
    for how in ("inner", "leftOuter"):
        sides = [streamed(spark, tmp_path / f"{name}-{how}", x, schema) for name, x in (("ref", refs), ("hyp", hyps))]
        stream = turns.paired_in_time(*sides, "1 hour", "48 hours", how)
        got = sorted(map(tuple, events.collect_stream(stream).collect()), key=str)
        whole = sorted(map(tuple, turns.paired_in_time(*flat, "1 hour", "48 hours", how).collect()), key=str)
        matched = [r for r in whole if r[4] is not None]
        # outer rows of references that the last watermark does not rule out yet are still to come
        assert [r for r in got if r[4] is not None] == matched and len(matched) > 10 and set(got) <= set(whole)
