"""Registrations in time and indexed search, against one-by-one versions."""

import datetime as dt
import random

import pytest

from reelfold.operators import catalog as C, intervals as IV, substring_index as SI
from reelfold.session import scratch_path

AT = dt.datetime(2024, 1, 1)
REGISTRATIONS = "id string, ref string, registered_at timestamp, terminated_at timestamp"
FILE = "struct<file_id: string, file_name: string, content_type: string, full_path: string>"


def hours(n):
    return None if n is None else AT + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def registrations():
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        start = rng.choice([rng.randint(0, 40), rng.uniform(0, 3000), rng.uniform(-9000, 9000)])
        length = rng.choice([None, 0, -3, 1, 5, rng.uniform(0, 40), rng.uniform(0, 9000)])
        end = None if length is None else start + length
        rows.append((f"i{rng.randint(0, 5)}", f"c{rng.randint(0, 9)}", hours(start), hours(end)))
    return rows + rows[:30] + [("i0", "c0", None, AT), (None, "c1", AT, None), ("i1", None, AT, None)]


def active(rows, ts):
    return {(i, r) for i, r, a, b in rows if a is not None and a <= ts and (b is None or ts < b)}


def test_messages_reach_who_is_registered_then(spark, registrations):
    rng = random.Random(8)
    edges = [t for _, _, a, b in registrations for t in (a, b) if t is not None]
    sent = [(f"i{rng.randint(0, 6)}", f"m{n}", rng.choice([hours(rng.uniform(-9500, 9500)), rng.choice(edges)])) for n in range(400)]
    sent += [("i1", "no time", None), (None, "no id", AT)]
    routed = IV.route_at(
        spark.createDataFrame(sent, "id string, msg string, ts timestamp"), spark.createDataFrame(registrations, REGISTRATIONS)
    )
    got = sorted((r.msg, str(r.ref)) for r in routed.collect())
    want = sorted((m, str(ref)) for i, m, ts in sent if ts and i for known, ref in active(registrations, ts) if known == i)
    assert got == want and len(want) > 400
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_recipients_of_notices(spark, registrations):
    times = [hours(n) for n in range(-9500, 9500, 97)] + [t for _, _, a, b in registrations[:60] for t in (a, b) if t]
    notices = [(n, ts) for n, ts in enumerate(times)] + [(99_999, None)]
    counted = IV.recipients_at(
        spark.createDataFrame(notices, "n int, ts timestamp"), spark.createDataFrame(registrations, REGISTRATIONS)
    )
    got = {r.n: r.recipients for r in counted.collect()}
    assert got == {n: None if ts is None else len(active(registrations, ts)) for n, ts in notices}


def test_periods_are_merged(spark):
    rows = [("i", "c", hours(a), hours(b)) for a, b in ((0, 4), (2, 3), (4, 6), (8, 9), (20, None), (21, 22), (1, 1))]
    got = IV.active_periods(spark.createDataFrame(rows, REGISTRATIONS)).collect()
    assert sorted((r.registered_at, r.terminated_at) for r in got if r.terminated_at) == [(hours(0), hours(6)), (hours(8), hours(9))]
    assert [r.registered_at for r in got if r.terminated_at is None] == [hours(20)]
    assert IV.active_periods(spark.createDataFrame([], REGISTRATIONS)).count() == 0


# --- indexed search -----------------------------------------------------------------------------


def entries(names):
    return [((f"id-{n}", name, "video/mp4", f"/up/{n % 3}"), None if n % 5 == 0 else "none") for n, name in enumerate(names)]


def test_indexed_search_is_the_scan(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcxyz%_é漢") for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", "%", "été.mp4"]
    catalog = spark.createDataFrame(entries(names), f"file {FILE}, status string")
    path = scratch_path(spark, "t-index")
    SI.append_catalog(catalog.filter("file.file_id < 'id-2'"), path, 12)
    SI.append_catalog(catalog.filter("not file.file_id < 'id-2'"), path, 12)
    for key in ("", "a", "é", "%", "_", "ab", "漢x", "été", "abc", "xyz%", "mp4", "video/", "no such", "\x02", "ne"):
        got = sorted(map(str, SI.search_indexed(spark, path, key).collect()))
        assert got == sorted(map(str, C.search(catalog, key).collect())), key


def test_few_files_are_read(spark):
    catalog = spark.createDataFrame(entries([f"clip-{n:05d}.mp4" for n in range(2000)]), f"file {FILE}, status string")
    path = scratch_path(spark, "t-index")
    SI.append_catalog(catalog, path, 20)
    found = SI.search_indexed(spark, path, "clip-00777")
    assert found.count() == 1 and len(found.inputFiles()) == 1
    assert SI.search_indexed(spark, path, "nowhere").count() == 0
    # rows whose index is not written yet are found as well, and indexed later
    catalog.limit(3).write.parquet(f"{path}/rows/append=later")
    assert SI.search_indexed(spark, path, "clip-00000").count() == 2
    assert (SI.index_appends(spark, path), SI.index_appends(spark, path)) == (1, 0)
    assert SI.search_indexed(spark, path, "clip-00000").count() == 2
