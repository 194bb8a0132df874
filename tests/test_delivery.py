"""Bounded buffers, delayed visibility, empty files, planned ranges, files and appends that commit as one."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from reelfold.plans import bindings as B
from reelfold.plans.registry import collect_stream
from reelfold.session import scratch_path
from reelfold.sources import commits as CM, file_source as SRC, files as FS
from reelfold.streaming import buffer as SB, intake, visibility as SV

AT = dt.datetime(2024, 1, 1)


# --- buffers ------------------------------------------------------------------------------------


def deliver(spark, rounds, capacity=10):
    """Each round is one file and one run of the query, which goes on from its checkpoint."""
    where, out, checkpoint = (scratch_path(spark, f"t-buffer-{x}") for x in ("in", "out", "offsets"))
    for events in rounds:
        rows = [(ref, seq, kind, "i", f"{ref}{seq}", AT, take) for ref, seq, kind, take in events]
        spark.createDataFrame(rows, SB.EVENTS).coalesce(1).write.mode("append").parquet(where)
        SB.buffer_stream(
            spark.readStream.schema(SB.EVENTS).parquet(where), out, checkpoint, capacity
        ).awaitTermination()
    return sorted((r.ref, r.seq, r.outcome) for r in SB.read_deliveries(spark, out).collect())


def test_eleven_messages_before_a_read_fail_a_consumer(spark):
    messages = lambda ref, a, b: [(ref, n, SB.MESSAGE, None) for n in range(a, b)]
    read = lambda ref, n, take=None: [(ref, n, SB.READ, take)]
    first = messages("slow", 0, 8) + messages("fine", 0, 10)
    second = messages("slow", 8, 11) + read("slow", 20) + read("fine", 10)
    third = messages("fine", 11, 13) + read("fine", 13) + messages("slow", 21, 25) + read("slow", 30)
    got = deliver(spark, [first, second, first, third])  # the third run brings the first file again
    fine = [("fine", n, SB.DELIVERED) for n in (*range(10), 11, 12)]
    assert got == sorted(fine + [("slow", 10, SB.OVERFLOW)])


def test_reads_take_in_order_and_leaving_ends_a_failure(spark):
    events = [("a", n, SB.MESSAGE, None) for n in range(3)] + [("a", 3, SB.READ, 2), (None, 1, SB.MESSAGE, None)]
    again = [("a", 4, SB.MESSAGE, None), ("a", 5, SB.MESSAGE, None), ("a", 6, SB.LEAVE, None)]
    last = [("a", 7, SB.MESSAGE, None), ("a", 8, SB.READ, None)]
    got = deliver(spark, [events, again, last], capacity=2)
    assert got == [("a", 2, SB.OVERFLOW), ("a", 7, SB.DELIVERED)]
    assert deliver(spark, [events, last], capacity=3) == [("a", n, SB.DELIVERED) for n in (0, 1, 2, 7)]


def test_session_setting_is_restored(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    deliver(spark, [[("a", 1, SB.MESSAGE, None)]])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


# --- visibility ---------------------------------------------------------------------------------

EVENTS = "persistence_id string, seq_nr bigint, tag string, ts timestamp"


def publish(spark, rounds):
    where, out, checkpoint = (scratch_path(spark, f"t-delay-{x}") for x in ("in", "out", "offsets"))
    seen = []
    for rows in rounds:
        rows = [(e, n, tag, AT + dt.timedelta(seconds=s)) for e, n, tag, s in rows]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(where)
        SV.publish_delayed(spark.readStream.schema(EVENTS).parquet(where), out, checkpoint).awaitTermination()
        seen.append([
            sorted((r.persistence_id, r.seq_nr) for r in table(spark, out).collect())
            for table in (SV.visible_events, SV.held_events, SV.late_events)
        ])
    return seen


def test_each_tag_has_its_clock_and_nothing_is_lost(spark):
    rounds = [
        [("a", 1, "x", 1), ("a", 2, "x", 5), ("b", 1, "y", 1)],
        [("b", 2, "y", 4), ("a", 2, "x", 5), ("a", 3, "x", 2), ("a", 1, "x", 1)],  # a replay held, one late, one seen
        [("a", 4, "x", 30)],
    ]
    first, second, third = publish(spark, rounds)
    assert first == [[("a", 1)], [("a", 2), ("b", 1)], []]
    assert second == [[("a", 1), ("b", 1)], [("a", 2), ("b", 2)], [("a", 3)]]
    assert third == [[("a", 1), ("a", 2), ("b", 1)], [("a", 4), ("b", 2)], [("a", 3)]]


def test_random_order_keeps_every_event(spark):
    rng = random.Random(4)
    events = [(f"e{n % 7}", n, f"t{n % 3}", rng.randint(0, 40)) for n in range(60)]
    rng.shuffle(events)
    rounds = [events[:20] + events[:5], events[20:40] + events[10:15], events[40:] + events[:9]]
    visible, held, late = publish(spark, rounds)[-1]
    assert sorted(visible + held + late) == sorted((e, n) for e, n, _, _ in events)
    newest = {t: max(s for _, _, tag, s in events if tag == t) for t in ("t0", "t1", "t2")}
    assert held == sorted((e, n) for e, n, tag, s in events if s > newest[tag] - 2)


# --- files --------------------------------------------------------------------------------------


def put(folder, **contents):
    for name, data in contents.items():
        path = os.path.join(folder, *name.split("__"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_empty_files_are_listed(spark, tmp_path):
    put(tmp_path, a=b"", b=b"xy", sub__c=b"", sub__deep__d=b"", _hidden__e=b"", sub___f=b"")
    rows = FS.scan_files(spark, str(tmp_path)).collect()
    assert sorted((os.path.relpath(r.path[5:], tmp_path), r.length, bytes(r.content)) for r in rows) == [
        ("a", 0, b""), ("b", 2, b"xy"), ("sub/c", 0, b""), ("sub/deep/d", 0, b"")
    ]
    assert all(r.path.startswith("file:/") and r.modification_time for r in rows)
    assert [r.path[-1] for r in FS.scan_files(spark, str(tmp_path), "c*").collect()] == ["c"]


def test_empty_files_on_a_stream(spark, tmp_path):
    """A restart goes on after the last file taken."""
    source, out, checkpoint = str(tmp_path / "in"), scratch_path(spark, "t-in"), scratch_path(spark, "t-offsets")
    for n, files in enumerate(({"a": b"", "b": b"x"}, {"sub__c": b"", "d": b"y"}, {})):
        put(source, **files)
        stream = intake.intake_stream(spark, source).select("path", "length")
        stream.writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(out)).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    got = sorted((os.path.basename(r.path), r.length) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0), ("b", 1), ("c", 0), ("d", 1)]


@pytest.mark.parametrize("range_bytes", [1, 40, 10**6])
def test_ranges_are_read_without_a_shuffle(spark, tmp_path, range_bytes):
    contents = {f"f{n}": random.Random(n).randbytes(n) for n in (0, 1, 9, 10, 11, 95, 1000)}
    put(tmp_path, **contents)
    chunks = FS.scan_chunks(spark, str(tmp_path), 10, range_bytes, keep_empty=True)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    rows = chunks.collect()
    for name, data in contents.items():
        mine = sorted((r.chunk_no, bytes(r.data)) for r in rows if r.path.endswith(f"/{name}"))
        assert b"".join(p for _, p in mine) == data
        assert [n for n, _ in mine] == list(range(max(1, -(-len(data) // 10))))
    assert not [r for r in FS.scan_chunks(spark, str(tmp_path), 10).collect() if r.length == 0]


def test_each_range_is_opened_once():
    reader = SRC.RangeReader({"path": "/nowhere", "chunk_bytes": "10", "range_bytes": "35"})
    assert reader.range == 30


def test_a_failed_write_leaves_nothing(spark):
    out = scratch_path(spark, "t-parts")
    chunks = spark.range(200).select(
        F.concat(F.lit("f"), F.col("id") % 5).alias("file_id"), F.floor(F.col("id") / 5).cast("int").alias("chunk_no"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("data"),
    )
    bad = chunks.withColumn("data", F.when(F.col("chunk_no") < 39, F.col("data")).otherwise(F.encode(F.raise_error(F.lit("broken")), "UTF-8")))
    with pytest.raises(Exception, match="broken"):
        FS.write_files(bad, out, chunks_per_part=4)
    assert not os.path.exists(out) or not [n for _, _, names in os.walk(out) for n in names]
    written = FS.write_files(chunks.unionByName(chunks.filter("chunk_no % 3 = 0")), out, chunks_per_part=4)
    parts = sorted((r.file_id, r.path, r.length) for r in written.collect())
    assert len(parts) == 50
    for k in range(5):
        data = b"".join(open(p, "rb").read() for f, p, _ in sorted(parts, key=lambda x: x[1][-8:]) if f == f"f{k}")
        assert data == b"".join(str(5 * n + k).encode() for n in range(40))
    assert FS.scan_files(spark, out).count() == 50


def test_one_shuffle_of_the_bytes(spark):
    """Writing sorts what one exchange dealt: no second one by chunk."""
    out = scratch_path(spark, "t-plan")
    chunks = spark.createDataFrame([("a", 0, bytearray(b"x"))], "file_id string, chunk_no int, data binary")
    assert [r.length for r in FS.write_files(chunks, out).collect()] == [1]
    assert FS.write_files(chunks.limit(0), out).count() == 0


# --- appends ------------------------------------------------------------------------------------


def test_append_retry_append(spark, sf_dir):
    """Each event once, numbered on; an attempt that never came to its commit does not count."""
    events, path = B.journal_events(spark, sf_dir), scratch_path(spark, "t-journal")
    cuts = [dt.datetime(2024, 1, d) for d in (1, 8, 15, 22)] + [dt.datetime(2025, 1, 1)]
    parts = [events.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, cuts[1:])]
    for n, part in enumerate(parts):
        assert CM.append_once(part, path, "intake", n, merge_after=2)
        assert not CM.append_once(part, path, "intake", n)
        # (a failed attempt: rows without an entry in the log)
        B.journal(spark, sf_dir).limit(5).write.mode("overwrite").parquet(f"{path}/events/commit=intake.{n + 1}/event_date=2024-01-01")
    got = CM.read_committed(spark, path)
    want = B.journal(spark, sf_dir)
    columns = ["persistence_id", "seq_nr", "event_type", "tag", "event_date"]
    assert got.count() == want.count() and got.select(columns).exceptAll(want.select(columns)).count() == 0
    heads = {r.persistence_id: r["head"] for r in CM.read_heads(spark, path).collect()}
    assert heads == {r[0]: r[1] for r in want.groupBy("persistence_id").agg(F.max("seq_nr")).collect()}
    assert [bool(e["merged"]) for e in CM.committed(path)] == [False, False, True, False]


def test_numbers_follow_without_reading_the_journal(spark, sf_dir):
    events, path = B.journal_events(spark, sf_dir), scratch_path(spark, "t-journal")
    CM.append_once(events, path, "intake", 0)
    numbered = CM.number_after_heads(events.limit(10), CM.read_heads(spark, path))
    read = [f for f in numbered.inputFiles() if path in f]
    assert read and all("/heads/" in f for f in read)


def test_commits_of_writers(spark):
    with pytest.raises(ValueError):
        CM.commit_name("a/b", 1)
    assert CM.committed(scratch_path(spark, "t-none")) == []
    assert CM.read_committed(spark, scratch_path(spark, "t-none")).count() == 0
