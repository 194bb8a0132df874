"""The physical plans the engine is designed for, and the whole flows."""

import json

from pyspark.sql import functions as F

from reelfold import schemas as S
from reelfold.operators import catalog as C, journal as J
from reelfold.plans import bindings as B, flows
from reelfold.plans.registry import stub_encoder
from reelfold.session import scratch_path
from reelfold.sources import events as E
from reelfold.sources.json_lines import write_json_lines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_journal(spark, sf_dir):
    path = scratch_path(spark, "p-journal")
    E.append_events(B.journal(spark, sf_dir), path)
    return E.read_journal(spark, path)


def test_search_reaches_the_scan(spark, sf_dir):
    path = scratch_path(spark, "p-catalog")
    C.build_catalog(stored_journal(spark, sf_dir)).write.parquet(path)
    found = C.search(spark.read.parquet(path), "mp").select("file.file_id", "status")
    text = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "StringContains(file.file_name,mp)" in text
    assert found.count() > 0


def test_scan_prunes_days_and_columns(spark, sf_dir):
    journal = stored_journal(spark, sf_dir)
    plan = plan_of(E.scan_events(journal, "file-1", 5, __import__("datetime").date(2024, 1, 20)).select("seq_nr"))
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThan(seq_nr,5)" in plan and "file_name" not in plan.split("ReadSchema")[1]


def test_fold_aggregates_before_its_only_shuffle(spark, sf_dir):
    plan = plan_of(J.current_state(stored_journal(spark, sf_dir)))
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan


def test_latest_snapshots_are_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(J.keep_latest(stored_journal(spark, sf_dir), 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan and plan.count("Exchange") == 1


def test_catalogue_is_one_scan(spark, sf_dir):
    plan = plan_of(C.build_catalog(stored_journal(spark, sf_dir)))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert "In(event_type, [FileAdded,UpdatedStatus])" in plan


def test_running_state_shuffles_rows_once(spark, sf_dir):
    journal = stored_journal(spark, sf_dir)
    assert plan_of(J.running_state(journal, longest=100)).count("Exchange") == 1


def test_upload_convert_search(spark, sf_dir):
    """Files in, events, request plans, conversion outcomes, catalogue out."""
    files = B.files(spark, sf_dir).withColumns(
        {"ts": F.timestamp_seconds(F.lit(B.REQUEST_EPOCH)), "event_id": F.col("doc_id")}
    )
    up = flows.upload(files, 3_000)
    n_files = files.count()
    assert up.events.count() + up.rejected.count() == n_files and 0 < up.rejected.count() < n_files

    def probe(row):
        track = {"bit_rate": 1000, "channels": 2, "decoder": "pcm", "sampling_rate": 8000}
        return {"duration": len(row["content"]), "format": "raw", "audio_track": track}

    answers = up.answers(probe).collect()
    assert len(answers) == up.accepted.count()
    assert json.loads(answers[0].body)["audio"]["channels"] == 2

    journal = E.number_after(up.events)
    state = J.current_state(journal)
    # the requests name files by the same ids the documents have
    conv = flows.convert(B.requests(spark, sf_dir), state)
    planned, refused, rejected = conv.planned.count(), conv.refused.count(), conv.rejected.count()
    assert planned and refused and rejected
    assert planned + refused + rejected == B.table(spark, sf_dir, "part").count()
    assert conv.replies.filter("status = 'inprogress'").count() == planned

    started = E.number_after(conv.events, journal)
    results = conv.run(stub_encoder(), scratch_path(spark, "p-out"))
    ended = E.number_after(conv.outcome_events(results), journal.unionByName(started))
    whole = journal.unionByName(started).unionByName(ended)
    final = J.current_state(whole).filter(F.col("file.status") == S.FILE_STATUS_CONVERTED)
    counts = {r.status: r["count"] for r in final.groupBy("status").count().collect()}
    assert sum(counts.values()) == planned and set(counts) == {"complete", "failed"}
    found = flows.search_catalog(whole, "converted")
    assert found.count() == planned
    assert flows.search_catalog(whole).count() == journal.count() + planned

    lines = scratch_path(spark, "p-lines")
    write_json_lines(found, lines)
    assert json.loads(spark.read.text(lines).first().value)["file_type"] == "converted"
