"""Uploads on a stream: the inventory of their folder."""

import json
import os
import random
import shutil
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException

from reelfold.session import scratch_path
from reelfold.sources import inventory as INV
from reelfold.streaming import intake


def put(folder, contents, at=None):
    for name, data in contents.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        if at is not None:
            os.utime(path, (at, at))


def run(stream, checkpoint, **trigger):
    """Rows of each micro-batch."""
    batches = []
    query = stream.writeStream.foreachBatch(
        lambda df, _: batches.append([(os.path.basename(r.path), r.length, bytes(r.content)) for r in df.collect()])
    ).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
    try:
        if trigger:
            query.processAllAvailable()
        else:
            query.awaitTermination()
    finally:
        query.stop()
    return batches


def test_a_checkpoint_holds_portions_and_no_file(spark, tmp_path):
    """Entries and statuses of all files filled the driver's memory at 512,820 files."""
    put(tmp_path / "in", {f"d{n % 3}/f{n}": b"x" * (n % 7) for n in range(900)})
    checkpoint = str(tmp_path / "offsets")
    (batch,) = run(intake.intake_stream(spark, str(tmp_path / "in"), 300), checkpoint)
    assert sorted(batch) == sorted((f"f{n}", n % 7, b"x" * (n % 7)) for n in range(900))
    logs = [os.path.join(d, n) for d, _, names in os.walk(f"{checkpoint}/sources") for n in names if n.isdigit()]
    entries = [line for log in logs for line in open(log) if line.startswith("{")]
    assert len(entries) == 3 and not any("/f1" in e for e in entries)


def test_each_trigger_takes_a_portion_and_a_restart_goes_on(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "offsets")
    put(source, {f"d{n % 2}/f{n}": b"x" * (n % 3) for n in range(7)})
    batches = run(intake.intake_stream(spark, source, 2), checkpoint, processingTime="0 seconds")
    assert sorted(len(b) for b in batches if b) == [1, 2, 2, 2]
    put(source, {"late": b"y", "d0/none": b""}, at=1)  # older than all that were taken
    batches += run(intake.intake_stream(spark, source, 3), checkpoint)
    put(source, {"_hidden": b"z"})
    batches += run(intake.intake_stream(spark, source, 3), checkpoint)
    assert sorted(r for b in batches for r in b) == sorted(
        [(f"f{n}", n % 3, b"x" * (n % 3)) for n in range(7)] + [("late", 1, b"y"), ("none", 0, b"")]
    )
    again = run(intake.intake_stream(spark, source, 3), str(tmp_path / "other"))  # another query takes all files
    assert sorted(r for b in again for r in b) == sorted(r for b in batches for r in b)


def test_a_path_is_taken_once_and_an_empty_one_with_each_time(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "offsets")
    found = []
    for contents, at in (
        ({"a": b"", "b": b"1"}, 10), ({"a": b"xy", "b": b"12"}, 20), ({"a": b""}, 30), ({"a": b"", "b": b""}, 30),
        ({"a": b"z", "b": b"z"}, 40),
    ):
        put(source, contents, at)
        found.append(sorted(r for b in run(intake.intake_stream(spark, source), checkpoint) for r in b))
    assert found == [[("a", 0, b""), ("b", 1, b"1")], [], [("a", 0, b"")], [("b", 0, b"")], []]


def test_names_that_match_and_a_log_of_its_own(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    put(source, {"a.mp4": b"1", "s t/b%20.mp3": b"", "c.txt": b"2", "s t/é.mp4": b"3"})
    stream = intake.intake_stream(spark, f"file://{source}", glob="*.{mp4,mp3}", log=log)
    found = run(stream, scratch_path(spark, "t-named"))
    assert sorted(r for b in found for r in b) == [("a.mp4", 1, b"1"), ("b%20.mp3", 0, b""), ("é.mp4", 1, b"3")]
    assert sorted(os.listdir(source)) == ["a.mp4", "c.txt", "s t"]
    with pytest.raises(FileNotFoundError):
        intake.intake_stream(spark, str(tmp_path / "none"))


def test_a_stream_stops_when_its_inventory_is_another(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "offsets")
    put(source, {"a": b"1", "b": b"2"})
    assert len(run(intake.intake_stream(spark, source), checkpoint)) == 1
    with pytest.raises(StreamingQueryException, match="Wrong basePath"):  # an inventory for each pattern
        run(intake.intake_stream(spark, source, glob="a"), checkpoint)
    (kept,) = [n for n in os.listdir(source) if n.startswith("_intake") and os.listdir(f"{source}/{n}/versions")]
    shutil.rmtree(f"{source}/{kept}")
    with pytest.raises(StreamingQueryException, match="is not the one that the stream has read"):
        run(intake.intake_stream(spark, source), checkpoint)


# --- without Spark ------------------------------------------------------------------------------


def portions(log):
    return [
        [(r["path"], r["length"]) for r in pq.read_table(os.path.join(log, "files", n)).to_pylist()]
        for n in sorted(os.listdir(os.path.join(log, "files")))
    ]


def opened(folder, portion=10, glob=None):
    log, _ = INV.open_inventory(str(folder), glob)
    return INV.Inventory(str(folder), log, glob, portion), log.removeprefix("file:")


@pytest.mark.parametrize("names", [3, 10_000])
def test_random_uploads_are_found_once(tmp_path, monkeypatch, names):
    monkeypatch.setattr(INV, "RUNS", 3)
    monkeypatch.setattr(INV, "KEPT", 6)
    monkeypatch.setattr(INV, "_NAMES", names)
    rng, want = random.Random(names), set()
    inventory, log = opened(tmp_path)
    for n in range(14):
        for k in range(rng.randrange(30)):
            folder = "/".join(rng.choice(["a", "a!", "b", "a b"]) for _ in range(rng.randrange(4)))
            size = rng.randrange(3)
            put(tmp_path, {os.path.join(folder, f"f{n}-{k}"): b"x" * size})
            want.add((f"file:{os.path.join(tmp_path, folder, f'f{n}-{k}')}", size))
        inventory.update()
        for path, size in rng.sample(sorted(want), min(3, len(want))):  # names of files that are gone are kept
            if size:
                os.remove(path[5:])
                inventory.update()
                put("/", {path[5:]: b"y"})
        inventory.update()
        found = [r for p in portions(log) for r in p]
        assert len(found) == len(want) and set(found) == want
    about = inventory.newest()
    assert len(about["runs"]) <= 3 and about["portions"] == len(portions(log)) > 14
    assert max(map(len, portions(log))) == 10
    kept = [n for n in os.listdir(f"{log}/versions") if os.path.exists(f"{log}/versions/{n}/known.arrow")]
    assert sorted(map(int, kept)) == about["runs"] and len(os.listdir(f"{log}/versions")) <= 7
    assert inventory.update() == about and not [n for n in os.listdir(log) if n.startswith(".")]


@pytest.mark.parametrize("held", [7, 10_000])
def test_the_oldest_files_come_first(tmp_path, monkeypatch, held):
    monkeypatch.setattr(INV, "SORTED", held)
    inventory, log = opened(tmp_path, 4)
    times = random.Random(held).sample(range(1000), 50)
    for k, at in enumerate(times):
        put(tmp_path, {f"d{k % 5}/f{k}": b"x" * (k % 2)}, at=at)
    inventory.update()
    assert [len(p) for p in portions(log)] == [4] * 12 + [2]
    found = [r for p in portions(log) for r in p]
    assert found == [(f"file:{tmp_path}/d{k % 5}/f{k}", k % 2) for k in sorted(range(50), key=times.__getitem__)]
    assert not [n for n in os.listdir(f"{log}/versions/0000000000") if n.startswith("sorted")]


def test_two_drivers_put_a_file_into_one_portion(tmp_path):
    want = set()
    for n in range(5):
        put(tmp_path, {f"d{n}-{k % 7}/f{k}": b"x" for k in range(60)})
        want |= {f"file:{tmp_path}/d{n}-{k % 7}/f{k}" for k in range(60)}
        with ThreadPoolExecutor(6) as pool:
            for done in [pool.submit(opened(tmp_path)[0].update) for _ in range(6)]:
                done.result()
    found = [path for p in portions(opened(tmp_path)[1]) for path, _ in p]
    assert len(found) == len(want) and set(found) == want


def test_a_version_whose_driver_was_lost_is_shown(tmp_path, monkeypatch):
    inventory, log = opened(tmp_path)
    put(tmp_path, {f"f{k}": b"x" for k in range(25)})
    with monkeypatch.context() as lost:
        lost.setattr(INV.Inventory, "show", lambda *_: None)
        inventory.update()
    assert portions(log) == []
    about = inventory.update()
    assert [len(p) for p in portions(log)] == [10, 10, 5]
    assert json.load(open(f"{log}/versions/0000000000/about.json")) == about
