"""Streams equal their batch form, replays included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reelfold import schemas as S
from reelfold.operators import journal as J, routing as R
from reelfold.plans import bindings as B
from reelfold.plans.registry import collect_stream, python_fold, stream_journal
from reelfold.session import scratch_path
from reelfold.sources import events as E
from reelfold.streaming import progress as SP, projection as PR, routing as SR, state as SS


@pytest.fixture(scope="module")
def path(spark, sf_dir):
    return stream_journal(spark, sf_dir, replay=True)


@pytest.fixture(scope="module")
def want(spark, sf_dir):
    return sorted(map(str, J.current_state(B.journal(spark, sf_dir)).collect()))


def test_state_stream_update_mode(spark, path, want):
    """The last update of every entity is its batch state, whatever the batch borders."""
    out = collect_stream(SS.state_stream(PR.journal_stream(spark, path, 7)), "update")
    updates = spark.read.parquet(out)
    last = updates.groupBy("persistence_id").agg(
        F.max_by("file", "batch_id").alias("file"), F.max_by("status", "batch_id").alias("status")
    )
    assert updates.select("batch_id").distinct().count() > 1
    assert sorted(map(str, last.collect())) == want


def test_maintained_state_and_compaction(spark, path, want):
    out, checkpoint = scratch_path(spark, "t-state"), scratch_path(spark, "t-offsets")
    for _ in range(2):  # the second run starts from the stored offset and finds nothing new
        SS.maintain_state(
            PR.journal_stream(spark, path, 10), out, checkpoint, compact_every=2
        ).awaitTermination()
    assert spark.read.parquet(out).filter("kind = 'merged'").select("batch_id").distinct().count() >= 1
    assert sorted(map(str, SS.read_state(spark, out).collect())) == want
    merged = scratch_path(spark, "t-merged")
    SS.compact_state(spark, out, merged)
    assert sorted(map(str, SS.read_state(spark, merged).collect())) == want


def test_published_once(spark, path, sf_dir):
    out, checkpoint = scratch_path(spark, "t-pub"), scratch_path(spark, "t-offsets")
    once = PR.project_by_tag(PR.dedupe_replays(PR.journal_stream(spark, path, 10), "60 days"))
    PR.publish_events(once, out, checkpoint).awaitTermination()
    published = PR.read_published(spark, out)
    assert published.count() == B.table(spark, sf_dir, "events").count()
    assert published.select("tag").distinct().count() <= S.TAG_COUNT


def test_callers_fold_on_a_stream(spark, sf_dir):
    """Two appends in order, then the first one replayed; replays are skipped."""
    init, step, merge, schema = python_fold()
    events = B.journal(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    where, out, checkpoint = (scratch_path(spark, f"t-fold-{x}") for x in ("in", "out", "offsets"))
    cut = dt.date(2024, 1, 15)
    for part in (F.col("event_date") >= cut, F.col("event_date") < cut, F.col("event_date") >= cut):
        E.append_events(events.filter(part), where)  # late days first
        SS.fold_stream(
            PR.journal_stream(spark, where), init, step, schema, out, checkpoint
        ).awaitTermination()
    got = SS.read_fold(spark, out, schema)
    want = J.fold_events(B.journal(spark, sf_dir), init, step, schema)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_early_events_wait(spark):
    """1, 3 and then 2, 4 of one entity: nothing is lost."""
    where, out, checkpoint = (scratch_path(spark, f"t-gap-{x}") for x in ("in", "out", "offsets"))
    step = lambda state, event: {"seen": state["seen"] + str(event["seq_nr"])}
    for batch in ([1, 3], [3, 5], [2, 4, 1]):
        rows = [("a", n) for n in batch]
        df = spark.createDataFrame(rows, "persistence_id string, seq_nr bigint")
        df.coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(df.schema).parquet(where)
        SS.fold_stream(stream, {"seen": ""}, step, "seen string", out, checkpoint).awaitTermination()
    assert [r["seen"] for r in SS.read_fold(spark, out, "seen string").collect()] == ["12345"]


def test_progress_over_batches(spark):
    where, out, checkpoint = (scratch_path(spark, f"t-prog-{x}") for x in ("in", "out", "offsets"))
    schema = "progress_id string, event_seq bigint, permil int"
    for rows in ([("a", 1, 100), ("b", 1, 1000)], [("a", 2, 200), ("b", 2, 990)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(schema).parquet(where)
        SP.maintain_progress(stream, out, checkpoint).awaitTermination()
    got = sorted(tuple(r) for r in SP.read_progress(spark, out).collect())
    assert got == [("a", 20.0, False), ("b", 99.0, True)]


def test_commit_delay_holds_new_events(spark):
    where, out, checkpoint = (scratch_path(spark, f"t-delay-{x}") for x in ("in", "out", "offsets"))
    schema = "persistence_id string, seq_nr bigint, ts timestamp"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    seen = []
    for rows in ([("a", 1, at(1)), ("a", 2, at(5))], [("b", 1, at(6)), ("a", 2, at(5))], [("b", 2, at(30))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        stream = PR.commit_delay(spark.readStream.schema(schema).parquet(where))
        write = lambda df, n: df.write.mode("append").parquet(out)
        stream.writeStream.outputMode("append").foreachBatch(write).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((r[0], r[1]) for r in spark.read.parquet(out).select("persistence_id", "seq_nr").collect()))
    assert seen == [[("a", 1)], [("a", 1)], [("a", 1), ("a", 2), ("b", 1)]]


def test_distinct_late_events_are_kept_without_a_delay(spark):
    where = scratch_path(spark, "t-late")
    schema = "persistence_id string, seq_nr bigint, ts timestamp"
    for n, s in enumerate((40, 3, 50, 3)):
        rows = [("a", s, dt.datetime(2024, 1, 1, 0, 0, s)), ("b", n, dt.datetime(2024, 1, 1, 0, 0, s))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(where)
    out = collect_stream(PR.dedupe_replays(stream, None), "append")
    assert spark.read.parquet(out).count() == 7


def test_scan_resumes_by_entity(spark):
    journal = spark.createDataFrame(
        [("old", 1), ("old", 2), ("old", 3), ("young", 1)], "persistence_id string, seq_nr bigint"
    )
    offsets = spark.createDataFrame([("old", 2)], "persistence_id string, offset bigint")
    got = E.scan_events(journal, offsets=offsets).collect()
    assert sorted((r[0], r[1]) for r in got) == [("old", 3), ("young", 1)]


def test_number_after_continues(spark, sf_dir):
    events = B.journal_events(spark, sf_dir)
    cut = dt.datetime(2024, 1, 15)
    first = E.number_after(events.filter(F.col("ts") < cut))
    second = E.number_after(events.filter(F.col("ts") >= cut), first)
    both = first.unionByName(second).select("persistence_id", "seq_nr", "ts")
    whole = B.journal(spark, sf_dir).select("persistence_id", "seq_nr", "ts")
    assert both.exceptAll(whole).count() == 0 and both.count() == whole.count()


MESSAGES = "id string, msg string, ts timestamp"
AT = dt.datetime(2024, 1, 1)


def test_inboxes_equal_one_by_one_delivery(spark):
    rng = random.Random(2)
    regs = [(f"i{rng.randint(0, 5)}", f"c{n % 12}") for n in range(30)]
    gone = [("c3",), ("c7",), ("nobody",)]
    sent = [(f"i{rng.randint(0, 7)}", f"m{n}", AT) for n in range(50)]
    notices = [(None, f"n{n}", AT) for n in range(4)]
    active = R.active_registrations(
        spark.createDataFrame(regs, "id string, ref string"), spark.createDataFrame(gone, "ref string")
    )
    routed = R.route_to(spark.createDataFrame(sent, MESSAGES), active).select("ref", "msg")
    everyone = R.broadcast_messages(spark.createDataFrame(notices, MESSAGES), active)
    live = {r for r in regs if (r[1],) not in gone}
    assert {r.recipients for r in everyone.collect()} == {len(live)}
    deliveries = routed.unionByName(everyone.select("ref", "msg"))
    for ref in sorted({r for _, r in live}):
        want = sorted([m for i, m, _ in sent if (i, ref) in live] + [m for _, m, _ in notices])
        assert sorted(r.msg for r in R.inbox(deliveries, ref).collect()) == want


def test_route_stream_reads_registrations_afresh(spark):
    src, out = scratch_path(spark, "t-msg"), scratch_path(spark, "t-del")
    checkpoint = scratch_path(spark, "t-offsets")
    regs = [[("a", "c1")], [("a", "c2"), ("b", "c2")]]
    for round_no, known in enumerate(regs):
        rows = [("a", f"m{round_no}", AT), ("b", f"k{round_no}", AT), (None, f"n{round_no}", AT)]
        spark.createDataFrame(rows, MESSAGES).write.mode("append").parquet(src)
        stream = spark.readStream.schema(MESSAGES).parquet(src)
        SR.route_stream(
            stream, lambda: spark.createDataFrame(known, "id string, ref string"), out, checkpoint
        ).awaitTermination()
    got = sorted((r.ref, r.msg) for r in spark.read.parquet(out).collect())
    assert got == [("*", "n0"), ("*", "n1"), ("c1", "m0"), ("c2", "k1"), ("c2", "m1")]


def test_stream_stream_routing(spark):
    msgs, regs = scratch_path(spark, "t-m"), scratch_path(spark, "t-r")
    later = AT + dt.timedelta(hours=3)
    spark.createDataFrame([("a", "in time", AT), ("a", "too late", later), ("b", "no one", AT)], MESSAGES).write.parquet(msgs)
    spark.createDataFrame([("a", "c1", AT)], "id string, ref string, registered_at timestamp").write.parquet(regs)
    joined = SR.route_streams(
        spark.readStream.schema(MESSAGES).parquet(msgs),
        spark.readStream.schema("id string, ref string, registered_at timestamp").parquet(regs),
        "1 hour", "2 hours",
    )
    got = spark.read.parquet(collect_stream(joined, "append")).collect()
    assert [(r.ref, r.msg) for r in got] == [("c1", "in time")]


def test_active_at(spark):
    rows = [(AT, None, AT, True), (AT, AT, AT, False), (AT + dt.timedelta(1), None, AT, False),
            (AT, AT + dt.timedelta(1), AT, True)]
    df = spark.createDataFrame(rows, "registered_at timestamp, terminated_at timestamp, ts timestamp, want boolean")
    assert df.filter(R.active_at("ts") != F.col("want")).count() == 0
