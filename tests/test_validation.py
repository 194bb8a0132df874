"""Validation rules and published documents, by hand from the rules."""

import json

import pytest
from pyspark.sql import functions as F

from reelfold.operators import catalog as C, media, validate as W

FILE_ID = "de1b1f2c-dae5-4426-9f35-f1accf07d9bf"
AUDIO = {
    "bit_rate": 128000, "channels": 2, "decoder": "mp3", "quality": 0, "sampling_rate": 44100,
    "volume": 0,
}
VIDEO = {
    "bit_rate": 1000000, "decoder": "h264", "frame_rate": 25.0, "profile": "HIGH",
    "size": {"height": 360, "width": 636}, "tag": "",
}
BODY = {"extension": "mp4", "format": "matrosaka", "id": FILE_ID}
INVALID, MALFORMED = "Invalid fields.", "Malformed request content"


def judge(spark, *bodies, read=W.read_preferences):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return read(W.parse_body(df)).orderBy("i").collect()


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


def test_readme_request(spark):
    row = judge(spark, {**BODY, "audio": AUDIO, "video": VIDEO})[0]
    assert row.reason is None and row.fields == []
    assert row.audio.asDict() == AUDIO
    assert row.video.asDict(True) == VIDEO
    assert (row.id, row.extension, row.format, row.file_name) == (FILE_ID, "mp4", "matrosaka", "")


CASES = [
    ({**BODY, "audio": AUDIO}, None, []),
    ({**BODY, "video": VIDEO}, None, []),
    (BODY, MALFORMED, []),
    ({**BODY, "audio": AUDIO, "video": ""}, MALFORMED, []),
    ({**BODY, "audio": AUDIO, "video": None}, MALFORMED, []),
    ({**BODY, "id": 5, "audio": AUDIO}, MALFORMED, []),
    ({**BODY, "id": "nope", "audio": AUDIO}, MALFORMED, []),
    ({**without(BODY, "format"), "audio": AUDIO}, MALFORMED, []),
    ("not json", MALFORMED, []),
    ("[1]", MALFORMED, []),
    ({**BODY, "audio": {}}, INVALID, ["channels", "sampling_rate", "bit_rate", "decoder"]),
    ({**BODY, "audio": {**AUDIO, "channels": "2"}}, INVALID, ["channels"]),
    ({**BODY, "audio": without(AUDIO, "quality", "volume")}, None, []),
    ({**BODY, "audio": {**AUDIO, "quality": None}}, INVALID, ["quality"]),
    ({**BODY, "audio": {**AUDIO, "volume": "x"}}, INVALID, ["volume"]),
    ({**BODY, "audio": {**AUDIO, "bit_rate": 2**33}}, INVALID, ["bit_rate"]),
    ({**BODY, "video": {**VIDEO, "tag": 5, "profile": 5}}, None, []),
    ({**BODY, "video": {**VIDEO, "size": {"height": "3"}}}, INVALID, ["size.height", "width"]),
    ({**BODY, "video": {**VIDEO, "size": {"width": True}}}, INVALID, ["height", "size.width"]),
    ({**BODY, "video": without(VIDEO, "size", "decoder")}, INVALID, ["size", "decoder"]),
    ({**BODY, "video": {**VIDEO, "size": 5}}, INVALID, ["size"]),
    ({**BODY, "audio": {}, "video": {**VIDEO, "frame_rate": "x"}}, INVALID,
     ["channels", "sampling_rate", "bit_rate", "decoder", "frame_rate"]),
]


def test_preference_rules(spark):
    rows = judge(spark, *[c[0] for c in CASES])
    assert [(r.reason, r.fields) for r in rows] == [(reason, f) for _, reason, f in CASES]
    for row in rows:
        assert (row.id is None) == (row.reason is not None)
    defaults = rows[16].video
    assert (defaults.tag, defaults.profile) == ("", None)


def test_wrap_mode(spark):
    read = lambda df: W.read_preferences(df, wrap=True)
    row = judge(spark, {**BODY, "audio": {**AUDIO, "bit_rate": 2**32 + 1}}, read=read)[0]
    assert row.reason is None and row.audio.bit_rate == 1


def test_progress_id(spark):
    sent = "7a61cc25-050c-4a37-b4bd-ab6162dcd26b"
    rows = judge(
        spark, {**BODY, "audio": AUDIO, "progress_id": sent},
        {**BODY, "audio": AUDIO, "progress_id": "bad"}, {**BODY, "audio": AUDIO},
    )
    assert rows[0].progress == sent
    assert all(len(r.progress) == 36 for r in rows) and rows[1].progress != rows[2].progress


INFO = {"file_name": "a.mp4", "content_type": "video/mp4", "status": 0, "id": FILE_ID}
MEDIA = {"info": INFO, "duration": 5000000000, "format": "flv", "audio": AUDIO}


def test_media_rules(spark):
    cases = [
        (MEDIA, None, []),
        ({**MEDIA, "video": VIDEO}, None, []),
        (without({**MEDIA, "video": VIDEO}, "audio"), MALFORMED, []),
        ({**MEDIA, "video": ""}, MALFORMED, []),
        ({**MEDIA, "duration": "1"}, MALFORMED, []),
        ({**MEDIA, "info": without(INFO, "id")}, None, []),
        ({**MEDIA, "info": {**INFO, "id": "x"}}, INVALID, ["id"]),
        ({**MEDIA, "info": {**INFO, "id": 5}}, INVALID, ["id"]),
        ({**MEDIA, "info": {**INFO, "content_type": "video"}}, INVALID, ["content_type"]),
        ({**MEDIA, "info": {}}, INVALID, ["file_name", "content_type"]),
    ]
    rows = judge(spark, *[c[0] for c in cases], read=W.read_media)
    assert [(r.reason, r.fields) for r in rows] == [(reason, f) for _, reason, f in cases]
    assert rows[0].duration == 5000000000 and rows[0].info.id == FILE_ID


def test_media_document_round_trips(spark):
    """A description written and read again is the same, absent video left out."""
    row = judge(spark, {**MEDIA, "video": VIDEO}, read=W.read_media)
    df = spark.createDataFrame(
        [(row[0].info, row[0].duration, row[0].format, row[0].audio, row[0].video)],
        "info struct<file_name:string,content_type:string,status:int,id:string>, duration bigint, "
        "format string, audio struct<bit_rate:int,channels:int,decoder:string,sampling_rate:int,"
        "quality:int,volume:int>, video struct<bit_rate:int,frame_rate:double,decoder:string,"
        "size:struct<width:int,height:int>,tag:string,profile:string>",
    )
    body = media.media_json(df).first().body
    again = judge(spark, body, read=W.read_media)[0]
    assert again.info == row[0].info and again.video.size == row[0].video.size
    assert json.loads(media.media_json(df.withColumn("video", F.when(F.lit(False), F.col("video")))).first().body)["video"] is None


def test_quarantine_loses_nothing(spark):
    texts = [c[0] if isinstance(c[0], str) else json.dumps(c[0]) for c in CASES]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    valid, rejected = W.quarantine(W.read_preferences(W.parse_body(df)))
    assert sorted([r.raw for r in valid.collect()] + [r.raw for r in rejected.collect()]) == sorted(texts)


def test_filters_stay_above_the_parsing(spark, sf_dir):
    """A filter on the verdict must not repeat the JSON lookups below the validation."""
    df = spark.createDataFrame([("{}",)], "raw string")
    _, rejected = W.quarantine(W.read_preferences(W.parse_body(df)))
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line.split("(")[0]]
    assert filters and all("variant_get" not in f for f in filters)


def test_form(spark):
    spec = {"a": W.FormField("d"), "b": W.FormField("d", False), "c": W.FormField("d")}
    texts = ['{"a":"x","b":null}', '{"a":1.9,"c":[1,2]}', '{"a":{"k":1},"c":true}']
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    form = W.validate_form(F.try_parse_json("raw"), spec)
    rows = [r.f for r in df.select(form.alias("f"), F.lit(1)).collect()]
    assert rows[0].values == {"a": "x", "b": "d", "c": "d"}
    assert rows[0].errors == {
        "b": "Invalid type found in this field.", "c": "This field is required.",
    }
    assert [r.has_errors for r in rows] == [True, False, False]
    assert rows[1]["values"] == {"a": "1", "b": "d", "c": "[1,2]"}
    assert rows[2]["values"] == {"a": '{"k":1}', "b": "d", "c": "true"}


def test_readme_answers(spark):
    """The published documents, field for field."""
    prefs = judge(spark, {**BODY, "audio": AUDIO, "video": VIDEO})[0]
    df = W.read_preferences(
        W.parse_body(spark.createDataFrame([(json.dumps({**BODY, "audio": AUDIO, "video": VIDEO}),)], "raw string"))
    )
    assert json.loads(media.preferences_json(df).first().body) == {
        **BODY, "audio": AUDIO, "video": VIDEO,
    }
    assert prefs.video.size.width == 636
    neither = df.withColumns({"audio": F.when(F.lit(False), F.col("audio")), "video": F.when(F.lit(False), F.col("video"))})
    assert json.loads(media.preferences_json(neither).first().body) == {
        "id": FILE_ID, "reason": "Non-media file.",
    }
    name, found_id = "0cf9068e-mp4.mp4", "d3bf102f-4480-441b-9b90-54511e607c09"
    state = spark.createDataFrame(
        [(found_id, (name, "Desktop/file/converted", "", 4, found_id), "complete")],
        "persistence_id string, file struct<file_name:string,full_path:string,content_type:string,"
        "status:int,file_id:string>, status string",
    )
    ids = spark.createDataFrame([(found_id,), (FILE_ID,), ("bad",)], "id string")
    bodies = {r.id: json.loads(r.body) for r in C.lookup_result(ids, state).collect()}
    assert bodies[found_id] == {
        "journal": {
            "contentType": "", "file_id": found_id, "file_name": name,
            "file_path": "Desktop/file/converted", "file_status": 4,
        },
        "status": "complete",
    }
    assert bodies[FILE_ID] == {"id": FILE_ID, "reason": "file not found."}
    assert bodies["bad"] == {"id": "bad", "reason": "file not found."}


@pytest.mark.parametrize("text,ok", [
    ('{"encoders":["a"],"decoders":["b","c"]}', True), ('{"encoders":["a"]}', False),
    ('{"encoders":"a","decoders":[]}', False), ("x", False),
])
def test_codec_lists(spark, text, ok):
    df = spark.createDataFrame([(text,)], "raw string")
    row = df.select(W.read_codec_lists(F.try_parse_json("raw")).alias("c")).first().c
    assert (row.error is None) == ok
    if ok:
        assert (row.encoders, row.decoders) == (["a"], ["b", "c"])
