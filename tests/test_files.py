"""Chunks, files and per-file jobs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reelfold import schemas as S
from reelfold.operators import jobs
from reelfold.session import scratch_path
from reelfold.sources import files as FS


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(5)
    sizes = [0, 1, 9, 10, 11, 1000, 2345]
    return {f"f{n}": rng.randbytes(n) for n in sizes}


@pytest.fixture(scope="module")
def files(spark, contents):
    return spark.createDataFrame(
        [(k, bytearray(v)) for k, v in contents.items()], "file_id string, content binary"
    )


def test_reassembled_chunks_are_the_files(spark, files, contents):
    chunks = FS.chunk_files(files, 10, keep_empty=True).orderBy(F.rand(1))
    whole, large = FS.reassemble_chunks(chunks)
    assert {r.file_id: bytes(r.data) for r in whole.collect()} == contents
    assert all(r.complete for r in whole.collect()) and large.count() == 0
    assert "f0" not in {r.file_id for r in FS.chunk_files(files, 10).collect()}


def test_repeated_and_missing_chunks(spark, files, contents):
    chunks = FS.chunk_files(files, 10)
    again = chunks.unionByName(chunks.filter("chunk_no < 2"))
    whole, _ = FS.reassemble_chunks(again)
    assert {r.file_id: bytes(r.data) for r in whole.collect()} == {
        k: v for k, v in contents.items() if v
    }
    gap, _ = FS.reassemble_chunks(chunks.filter("not (file_id = 'f1000' and chunk_no = 3)"))
    assert {r.file_id for r in gap.collect() if not r.complete} == {"f1000"}


@pytest.mark.parametrize("chunk_bytes", [None, 10])
def test_large_files_stay_chunks(spark, files, contents, chunk_bytes):
    chunks = FS.chunk_files(files, 10)
    whole, large = FS.reassemble_chunks(chunks, max_bytes=500, chunk_bytes=chunk_bytes)
    assert {r.file_id for r in whole.collect()} == {"f1", "f9", "f10", "f11"}
    pieces = sorted((r.file_id, r.chunk_no, bytes(r.data)) for r in large.collect())
    for name in ("f1000", "f2345"):
        assert b"".join(p for f, _, p in pieces if f == name) == contents[name]


@pytest.mark.parametrize("parts", [None, 30])
def test_written_files_are_read_back(spark, files, contents, parts):
    out = scratch_path(spark, "test-files")
    chunks = FS.chunk_files(files, 10, keep_empty=True).repartition(4)
    written = FS.write_files(chunks, out, chunks_per_part=parts).collect()
    by_name = {}
    for row in sorted(written, key=lambda r: r.path):
        with open(row.path, "rb") as f:
            data = f.read()
        assert len(data) == row.length
        by_name[row.file_id] = by_name.get(row.file_id, b"") + data
    assert by_name == contents
    found = FS.scan_files(spark, out)
    assert sorted(r.length for r in found.collect()) == sorted(r.length for r in written)
    assert not [n for _, _, names in os.walk(out) for n in names if n.startswith(".") and not n.endswith(".crc")]


def test_byte_ranges(spark, files, contents):
    out = scratch_path(spark, "test-ranges")
    listing = spark.createDataFrame(FS.write_files(FS.chunk_files(files, 10), out).collect())
    pieces = FS.read_chunks(listing, 7).collect()
    for name, data in contents.items():
        mine = sorted((r.chunk_no, bytes(r.data)) for r in pieces if r.file_id == name)
        assert b"".join(p for _, p in mine) == data


def test_size_limit_keeps_every_row(spark):
    df = spark.createDataFrame([("a", 5, b"x"), ("b", 50, b"y")], "file_id string, length bigint, content binary")
    accepted, rejected = FS.limit_size(df, 10)
    assert [r.file_id for r in accepted.collect()] == ["a"]
    assert [r.file_id for r in rejected.collect()] == ["b"] and "content" not in rejected.columns


def test_listing_does_not_open_files(spark, files):
    out = scratch_path(spark, "test-listing")
    FS.write_files(FS.chunk_files(files, 10), out).collect()
    listing = FS.scan_files(spark, out).select("path", "length").filter("length > 10")
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
    assert "GreaterThan(length,10)" in plan


PLAN = (
    "file_id string, new_name string, progress string, source_name string, format string, "
    "plan_error string"
)


def test_conversions(spark):
    def encode(row, output, on_permil):
        on_permil(500)
        output.write(row["source_name"].encode())
        if row["format"] == "bad":
            raise RuntimeError("no such format")
        on_permil(1000)

    out = scratch_path(spark, "test-convert")
    rows = [
        ("1", "1.mp4", "p1", "a", "mp4", None), ("2", "2.mp4", "p2", "b", "bad", None),
        ("3", "3.mp4", "p3", "c", "mp4", "unknown profile: x"),
    ]
    results = jobs.run_conversions(spark.createDataFrame(rows, PLAN), encode, out)
    for _ in range(2):  # running again replaces files and leaves nothing else
        got = {r.file_id: r for r in results.collect()}
        assert [n for n in sorted(os.listdir(out)) if not n.endswith(".crc")] == ["1.mp4"]
    assert got["1"].status == S.STATUS_COMPLETE and got["1"].error is None
    assert (got["2"].status, got["2"].error) == (S.STATUS_FAILED, "RuntimeError: no such format")
    assert (got["3"].status, got["3"].permils) == (S.STATUS_FAILED, [])
    progress = {(r.progress_id, r.event_seq): r.permil for r in jobs.progress_rows(results).collect()}
    assert progress == {("p1", 0): 500, ("p1", 1): 1000, ("p2", 0): 500}


def test_probe_errors_are_rows(spark):
    def probe(row):
        if not row["content"]:
            raise ValueError("empty")
        return {"duration": 7, "format": "raw", "audio_track": {"bit_rate": 1, "channels": 2, "decoder": "x", "sampling_rate": 3}}

    df = spark.createDataFrame(
        [(("a", "d", "t", 0, "1"), b"x"), (("b", "d", "t", 0, "2"), b"")],
        f"file {S.FILE_JOURNAL}, content binary",
    )
    got = {r.file.file_name: r for r in jobs.probe_files(df, probe).collect()}
    assert got["a"].audio_track.channels == 2 and got["a"].video_track is None
    assert (got["b"].error, got["b"].duration) == ("ValueError: empty", None)
