"""Folds, snapshots and numbering against step-by-step Python, on skewed and small inputs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reelfold import schemas as S
from reelfold.operators import journal as J, skew
from reelfold.plans.registry import python_fold

SCHEMA = f"persistence_id string, seq_nr bigint, event_type string, file {S.FILE_JOURNAL}, status string"


def file(name, entity="e"):
    return (name, "dir", "video/mp4", 0, entity) if name else None


def frame(spark, events):
    return spark.createDataFrame(events, SCHEMA)


def ev(seq, kind, name=None, status=None, entity="e"):
    return (entity, seq, kind, file(name, entity), status)


A, C, U = S.FILE_ADDED, S.CONVERTED_FILE, S.UPDATED_STATUS

GOLDEN = [
    ([ev(1, "FileRemoved", "f0")], None, "none"),
    ([ev(1, A, "f1")], "f1", "none"),
    ([ev(1, A, "f1"), ev(2, C, "f2")], "f2", "inprogress"),
    ([ev(1, C, "f2"), ev(2, U, "f3", "complete")], "f2", "complete"),
    ([ev(1, U, "f3", "failed")], None, "failed"),
    ([ev(1, C, "f2"), ev(2, U, "f2", "failed"), ev(3, A, "f4")], "f4", "failed"),
    ([ev(1, U, "f1", "complete"), ev(2, C, "f2")], "f2", "inprogress"),
]


@pytest.mark.parametrize("events,name,status", GOLDEN)
def test_golden_folds(spark, events, name, status):
    row = J.current_state(frame(spark, events)).first()
    assert (row.file and row.file.file_name, row.status) == (name, status)


def step_fold(events):
    """State after every event, by the rules one at a time."""
    states, out = {}, {}
    for e, seq, kind, f, status in sorted(events, key=lambda x: (x[0], x[1])):
        cur = states.get(e, (None, "none"))
        if kind == A:
            cur = (f, cur[1])
        elif kind == C:
            cur = (f, "inprogress")
        elif kind == U:
            cur = (cur[0], status)
        states[e] = cur
        out[(e, seq)] = cur
    return states, out


def random_journal(rng, entities=5, longest=60, hot=400):
    events = []
    for i in range(entities):
        for seq in range(1, (hot if i == 0 else rng.randint(1, longest)) + 1):
            kind = rng.choice([A, C, U, U, "FileRemoved"])
            status = rng.choice(["complete", "failed"]) if kind == U else None
            events.append(ev(seq, kind, f"f{seq}", status, f"e{i}"))
    rng.shuffle(events)
    return events


def as_pair(row):
    return (tuple(row.file) if row.file else None, row.status)


@pytest.fixture(scope="module")
def events():
    return random_journal(random.Random(7))


def test_current_state_ignores_order_and_replays(spark, events):
    want, _ = step_fold(events)
    df = frame(spark, events + events[:100]).repartition(5)
    assert {r.persistence_id: as_pair(r) for r in J.current_state(df).collect()} == want


@pytest.mark.parametrize("slice_events", [1_000_000, 50, 7, 1])
def test_running_state_over_slices(spark, events, slice_events):
    _, want = step_fold(events)
    got = J.running_state(frame(spark, events), slice_events=slice_events).collect()
    handled = {k: v for k, v in want.items()}
    kept = {(e, s) for e, s, kind, *_ in events if kind in S.HANDLED_EVENTS}
    assert {(r.persistence_id, r.seq_nr): as_pair(r) for r in got} == {
        k: v for k, v in handled.items() if k in kept
    }


@pytest.mark.parametrize("slice_blocks", [10_000, 3])
def test_snapshots(spark, events, slice_blocks):
    _, states = step_fold(events)
    got = J.snapshot(frame(spark, events), every=20, keep=3, slice_blocks=slice_blocks).collect()
    want = {}
    for e in {k[0] for k in states}:
        last = max(s for k, s in states if k == e)
        for seq in [s for s in range(last - last % 20, 0, -20)][:3]:
            want[(e, seq)] = states[(e, seq)]
    assert {(r.persistence_id, r.seq_nr): as_pair(r) for r in got} == want


@pytest.mark.parametrize("hot_rows", [2_000_000, 50])
def test_restore_equals_full_fold(spark, events, hot_rows):
    df = frame(spark, events)
    taken = J.snapshot(df, every=20)
    tail = J.tail_events(df, taken, hot_rows=hot_rows)
    assert tail.count() < df.count()
    want, _ = step_fold(events)
    for rest in (tail, df):  # an overlapping tail changes nothing
        got = J.restore(taken, rest).collect()
        assert {r.persistence_id: as_pair(r) for r in got} == want


@pytest.mark.parametrize("slice_events,merging", [(1_000_000, False), (1_000_000, True), (9, True)])
def test_callers_fold(spark, events, slice_events, merging):
    init, step, merge, schema = python_fold()
    got = J.fold_events(
        frame(spark, events), init, step, schema, merge if merging else None,
        slice_events=slice_events,
    ).collect()
    want, _ = step_fold(events)
    counts = {e: sum(x[0] == e for x in events) for e in want}
    assert {r.persistence_id: (r.file_name, r.status or "none", r.n_events) for r in got} == {
        e: (f and f[0], s, counts[e]) for e, (f, s) in want.items()
    }


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_fold_property(spark, seed):
    events = random_journal(random.Random(seed), entities=3, longest=12, hot=15)
    want, _ = step_fold(events)
    got = J.current_state(frame(spark, events)).collect()
    assert {r.persistence_id: as_pair(r) for r in got} == want


@pytest.mark.parametrize("hot_rows", [2_000_000, 100])
def test_numbering_with_a_hot_key(spark, hot_rows):
    """One entity holds most rows, with ties in time; numbers stay gap-free and in order."""
    rng = random.Random(3)
    rows = [("hot", rng.randint(0, 50), i) for i in range(3000)]
    rows += [(f"k{i % 40}", rng.randint(0, 5), 10_000 + i) for i in range(800)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "persistence_id string, ts int, event_id bigint").repartition(6)
    got = J.assign_seq(df, hot_rows=hot_rows).collect()
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted(x for x in rows if x[0] == key), start=1):
            want[r[2]] = n
    assert {r.event_id: r.seq_nr for r in got} == want


@pytest.mark.parametrize("hot_rows", [2_000_000, 100])
def test_numbering_with_a_hot_null_key(spark, hot_rows):
    rows = [(None if i % 3 else f"k{i % 7}", i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "persistence_id string, ts int, event_id bigint").repartition(6)
    got = J.assign_seq(df, hot_rows=hot_rows).collect()
    want, seen = {}, {}
    for key, _, event in rows:
        seen[key] = want[event] = seen.get(key, 0) + 1
    assert {r.event_id: r.seq_nr for r in got} == want


def test_codec_document_is_bounded(spark, monkeypatch):
    from reelfold.operators import media

    codecs = spark.createDataFrame([("video", "encoder", f"c{i}") for i in range(5)], "kind string, direction string, name string")
    assert media.codec_json(codecs).count() == 1
    monkeypatch.setattr(media, "MAX_CODECS", 4)
    with pytest.raises(ValueError):
        media.codec_json(codecs)


def test_hot_keys_are_found(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    hot, total = skew.hot_keys(df, "k", 100)
    assert [r.k for r in hot.collect()] == [0] and total == 900
    assert skew.hot_keys(df, "k", 900) is None


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
@pytest.mark.parametrize("hot_rows", [2_000_000, 50])
def test_join_unique(spark, how, hot_rows):
    rows = [(i, "a" if i % 3 else (None if i % 2 else f"k{i % 7}")) for i in range(300)]
    left = spark.createDataFrame(rows, "i int, k string")
    right = spark.createDataFrame([("a", 1), ("k2", 2), ("z", 3)], "k string, v int")
    cols = ["i", "k"] if how in ("left_semi", "left_anti") else ["i", "k", "v"]
    want = sorted(map(str, left.join(right, "k", how).select(*cols).collect()))
    got = skew.join_unique(left, right, "k", how, hot_rows=hot_rows).select(*cols).collect()
    assert sorted(map(str, got)) == want
    if how == "left":
        spread = skew.join_unique(left, right, "k", how, ["i"], hot_rows=hot_rows)
        assert sorted(map(str, spread.select(*cols).collect())) == want


def test_bounded_side(spark):
    df = spark.range(10)
    _, rows = skew.bounded_side(df, 5)
    assert rows == 10
    plan = df.join(skew.bounded_side(df, 10)[0], "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan


def test_one_row_per_attempt_whatever_the_outcomes(spark):
    from reelfold.operators.convert import attempts_with_outcome

    attempts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4), (None, 5)], "file_id string, n int")
    outcomes = spark.createDataFrame(
        [("a", False, 1), ("a", True, 2), ("b", True, 1), ("b", False, 2), ("b", None, 3), (None, True, 1)],
        "file_id string, ok boolean, at int",
    )
    def status(order):
        rows = attempts_with_outcome(attempts, outcomes, order).collect()
        return [r["status"] for r in sorted(rows, key=lambda r: r["n"])]

    assert status(None) == ["complete", "complete", "inprogress", "inprogress", "inprogress"]
    assert status("at") == ["complete", "failed", "inprogress", "inprogress", "inprogress"]


def test_playback_and_source_paths(spark):
    from reelfold.plans.flows import play

    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("9",), (None,)], "id string")
    state = spark.createDataFrame(
        [("1", ("a.mp4", "d", "video/mp4", 0, "1"), "none"), ("2", ("b.mp4", "d", "", 0, "2"), "none"),
         ("3", ("gone.mp4", "d", "video/mp4", 0, "3"), "none")],
        "persistence_id string, file struct<file_name:string,full_path:string,content_type:string,"
        "status:int,file_id:string>, status string",
    )
    listing = "file_name string, path string"
    converted = spark.createDataFrame([("a.mp4", "/c/a.mp4")], listing)
    uploaded = spark.createDataFrame([("a.mp4", "/u/a.mp4"), ("b.mp4", "/u/b.mp4")], listing)
    playable, refused = play(ids, state, converted, uploaded)
    assert [(r["id"], r["path"]) for r in playable.collect()] == [("1", "/c/a.mp4")]
    got = {r["id"]: r["reason"] for r in refused.collect()}
    assert set(got) == {"2", "3", "9", None} and got["9"] == got["3"] == got[None] and all(got.values())


def test_unknown_length_is_rejected(spark):
    from reelfold.sources.files import limit_size

    files = spark.createDataFrame([("a", 5), ("b", None), ("c", 50)], "file_id string, length bigint")
    accepted, rejected = limit_size(files, 10)
    assert [r[0] for r in accepted.collect()] == ["a"]
    assert sorted(r[0] for r in rejected.collect()) == ["b", "c"]
