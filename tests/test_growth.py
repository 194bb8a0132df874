"""Work that must not meet in the driver, in one task or in a call for each key."""

import datetime as dt
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from reelfold import schemas as S
from reelfold.session import scratch_path
from reelfold.sources import files as FS
from reelfold.streaming import buffer as SB, intake, state as SS

AT = dt.datetime(2024, 1, 1)


def put(folder, contents):
    for name, data in contents.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    contents = {f"d{n % 40}/e{n % 3}/f{n}": b"x" * (n % 7) for n in range(300)}
    put(tmp_path, contents)
    found = FS.scan_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 1  # Spark's own source opens a task for each few files
    rows = {os.path.relpath(r.path[5:], tmp_path): (r.length, bytes(r.content)) for r in found.collect()}
    assert rows == {name: (len(data), data) for name, data in contents.items()}


def test_many_small_uploads_are_few_tasks_of_a_stream(spark, tmp_path):
    contents = {f"d{n % 3}/f{n}": b"x" * (n % 7) for n in range(800)}
    put(tmp_path / "in", contents)
    tasks, found = [], []

    def take(df, _):
        tasks.append(df.rdd.getNumPartitions())
        found.extend((r.path, r.length, bytes(r.content)) for r in df.collect())

    stream = intake.intake_stream(spark, str(tmp_path / "in"))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", scratch_path(spark, "t-few")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert sorted((os.path.relpath(p[5:], tmp_path / "in"), n, data) for p, n, data in found) == sorted(
        (name, len(data), data) for name, data in contents.items()
    )
    assert sum(tasks) < 20  # Spark's packing alone makes 22 of the filled ones and 4 of the empty ones


def test_contents_come_in_bounded_pieces(spark, tmp_path):
    """Files larger and smaller than what is held at once, in the order of their rows."""
    contents = {f"f{n}": bytes([n]) * (3_000_000 if n % 3 else n) for n in range(12)}
    put(tmp_path, contents)
    rows = FS.scan_files(spark, f"file://{tmp_path}", "f*").filter("length > 5").collect()
    assert {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in rows} == {
        name: data for name, data in contents.items() if len(data) > 5
    }


@pytest.mark.parametrize("glob,names", [
    ("*.{mp4,mp3}", "a.mp4 b.mp3"), ("[^ab]*", "c.txt"), ("?.txt", "c.txt"), ("[a-b].mp?", "a.mp4 b.mp3"), ("a", ""),
])
def test_name_patterns_are_those_of_spark(spark, tmp_path, glob, names):
    put(tmp_path, {name: b"1" for name in ("a.mp4", "s/b.mp3", "c.txt", "_d.mp4")})
    ours = sorted(os.path.basename(r.path) for r in FS.scan_files(spark, str(tmp_path), glob).collect())
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    assert ours == names.split() == sorted(os.path.basename(r.path) for r in reader.load(str(tmp_path)).collect())


def test_a_path_that_is_not_there_and_one_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        FS.scan_files(spark, str(tmp_path / "none"))
    put(tmp_path, {"one": b"abc"})
    assert [bytes(r.content) for r in FS.scan_files(spark, str(tmp_path / "one")).collect()] == [b"abc"]


# --- buffers and folds, by runs of sorted rows --------------------------------------------------


def test_a_consumer_with_many_events_is_not_held_in_memory(spark):
    """Deliveries leave before the rest of the consumer's events are read."""
    fields = to_arrow_schema(S.struct_type(SB.STEPS))
    taken = []

    def batches():
        for n in range(200):
            taken.append(n)
            rows = [("a", 1000 * n + k, SB.READ if k % 10 == 9 else SB.MESSAGE, "i", "m", AT, None) for k in range(1000)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32()])],
                names=["ref", "seq", "kind", "id", "msg", "ts", "take"],
            )

    first = next(SB._steps(batches(), 10, fields))
    assert first.num_rows >= 10_000 and len(taken) < 15
    assert set(first.column("row").to_pylist()) == {SB.DELIVERY}


def test_random_events_leave_buffers_as_a_plain_queue_does(spark):
    rng = random.Random(3)
    kinds = [SB.MESSAGE] * 6 + [SB.READ] * 2 + [SB.LEAVE]
    events = [
        (None if rng.random() < 0.02 else f"c{rng.randrange(9)}", None if rng.random() < 0.02 else n, rng.choice(kinds), "i", None if n % 5 == 0 else f"m{n}", AT + dt.timedelta(seconds=n) if n % 4 else None, rng.choice([None, 1, 2]))
        for n in range(900)
    ]
    rounds = [events[:300], events[300:600], events[100:300], events[600:]]
    where, out, checkpoint = (scratch_path(spark, f"t-queue-{x}") for x in ("in", "out", "offsets"))
    for rows in rounds:
        spark.createDataFrame(rows, SB.EVENTS).write.mode("append").parquet(where)
        SB.buffer_stream(spark.readStream.schema(SB.EVENTS).parquet(where), out, checkpoint, 4).awaitTermination()
    want, queues = [], {}
    for ref, n, kind, i, msg, ts, take in events:
        if ref is None or n is None:
            continue
        queue = queues.setdefault(ref, [])
        if kind == SB.LEAVE:
            queues[ref] = []
        elif queue is not SB.FAILED and kind == SB.READ:
            count = len(queue) if take is None else take
            want += [(ref, m[0], SB.DELIVERED, *m[1:]) for m in queue[:count]]
            queues[ref] = queue[count:]
        elif queue is not SB.FAILED and len(queue) == 4:
            want.append((ref, n, SB.OVERFLOW, i, msg, ts))
            queues[ref] = SB.FAILED
        elif queue is not SB.FAILED:
            queue.append((n, i, msg, ts))
    got = [(r.ref, r.seq, r.outcome, r.id, r.msg, r.ts) for r in SB.read_deliveries(spark, out).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 100


def test_folded_states_of_two_batches_are_kept(spark):
    """States are a table that each micro-batch writes anew; a gap may close after several of them."""
    where, out, checkpoint = (scratch_path(spark, f"t-table-{x}") for x in ("in", "out", "offsets"))
    step = lambda state, event: {"seen": state["seen"] + str(event["seq_nr"])}
    for rows in ([("a", 1), ("b", 2)], [("c", 1), ("a", 3), (None, 1)], [("c", 2), ("c", None)], [("a", 2), ("a", 1)]):
        df = spark.createDataFrame(rows, "persistence_id string, seq_nr bigint")
        df.coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(df.schema).parquet(where)
        SS.fold_stream(stream, {"seen": ""}, step, "seen string", out, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in SS.read_fold(spark, out, "seen string").collect()) == [("a", "123"), ("c", "12")]
    assert sorted(n for n in os.listdir(out) if n.startswith("batch_id")) == ["batch_id=2", "batch_id=3"]
