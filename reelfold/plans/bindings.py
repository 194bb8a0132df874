"""The engine's input tables derived from the star-schema test tables.

Every binding covers all rows of its table. Broken or missing values come from key remainders that
choose a *shape* for a row, never from dropping rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelfold import schemas as S
from reelfold.functions.ids import uuid_shaped
from reelfold.operators.validate import parse_body
from reelfold.sources.events import number_after

EXTENSIONS = ("mp4", "mp3", "flv", "avi", "webm")
CONTENT_TYPES = ("video/mp4", "audio/mpeg", "video/x-flv", "video/x-msvideo", "video/webm")
NAME_ENDINGS = (".mp4", ".tar.gz", "", ".", "..", ".b.", ".MP3")
REQUEST_EPOCH = 1_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    """The value at a zero-based remainder."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unnumbered events: sign-ups add files, clicks convert, purchases and errors end a run.

    Views become a declared event type that no fold handles.
    """
    kind = F.col("event_type")
    added = kind == "signup"
    entity = uuid_shaped("user_id")
    which = F.col("event_id") % 5
    file = F.struct(
        F.concat(F.lit("clip-"), "event_id", F.lit("."), pick(EXTENSIONS, which)).alias("file_name"),
        F.when(added, F.lit(S.UPLOAD_DIR)).otherwise(F.lit(S.CONVERT_DIR)).alias("full_path"),
        F.when(added, pick(CONTENT_TYPES, which)).otherwise(F.lit("")).alias("content_type"),
        F.when(added, F.lit(S.FILE_STATUS_UPLOADED)).otherwise(F.lit(S.FILE_STATUS_CONVERTED))
        .alias("status"),
        entity.alias("file_id"),
    )
    event_type = (
        F.when(added, F.lit(S.FILE_ADDED))
        .when(kind == "click", F.lit(S.CONVERTED_FILE))
        .when(kind.isin("purchase", "error"), F.lit(S.UPDATED_STATUS))
        .otherwise(F.lit("FileRemoved"))
    )
    status = F.when(kind == "purchase", F.lit(S.STATUS_COMPLETE)).when(
        kind == "error", F.lit(S.STATUS_FAILED)
    )
    source = F.when(kind == "click", uuid_shaped(F.concat(F.lit("src"), "user_id")))
    return table(spark, sf_dir, "events").select(
        entity.alias("persistence_id"), "ts", "event_id", event_type.alias("event_type"),
        file.alias("file"), status.alias("status"), source.alias("source_file_id"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_after(journal_events(spark, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files: name endings of every kind, text as bytes."""
    name = F.when(F.col("doc_id") % 11 == 0, F.lit(".")).otherwise(
        F.concat("source", F.lit("-"), "doc_id", pick(NAME_ENDINGS, F.col("doc_id") % 7))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", uuid_shaped("doc_id").alias("file_id"), name.alias("file_name"),
        pick(CONTENT_TYPES, F.col("doc_id") % 5).alias("content_type"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks; in every seventh conversation numbering starts at 1."""
    late = F.when(F.col("conv_id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    return table(spark, sf_dir, "conversations").select(
        uuid_shaped("conv_id").alias("file_id"),
        (F.col("turn") + late).cast("int").alias("chunk_no"),
        F.encode("text", "UTF-8").alias("data"),
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion requests as raw JSON, sixteen shapes from right to not JSON at all."""
    shape = F.col("p_partkey") % 16
    rate = (F.col("p_size") * 1000).cast("string")
    file_id = uuid_shaped(F.col("p_partkey") % 300)
    fmt = F.when(F.col("p_partkey") % 3 == 0, F.lit("ogg")).otherwise(F.lit("mp4"))
    volume = (F.col("p_partkey") % 3).cast("string")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    head = text('{"id":"', file_id, '","extension":"mp4","format":"', fmt, '"')
    audio = text(
        '"audio":{"bit_rate":', rate, ',"channels":2,"decoder":" aac ","sampling_rate":44100,'
        '"quality":0,"volume":', volume, "}",
    )
    video = text(
        '"video":{"bit_rate":', rate, ',"frame_rate":25.5,"decoder":"h264","tag":"",'
        '"profile":"HIGH","size":{"height":360,"width":636}}'
    )
    bodies = [
        text(head, ",", audio, ",", video, "}"),
        text(head, ",", audio, "}"),
        text(head, ",", video, "}"),
        text(head, "}"),
        text(head, ',"audio":{}}'),
        text(head, ',"audio":{"bit_rate":', rate,
             ',"channels":"2","decoder":"aac","sampling_rate":44100}}'),
        text(head, ',"audio":{"bit_rate":', rate,
             ',"channels":2,"decoder":"aac","sampling_rate":44100,"quality":null}}'),
        text(head, ',"video":{"bit_rate":', rate,
             ',"frame_rate":0.5,"decoder":"h264","tag":5,"profile":5,'
             '"size":{"height":360,"width":636}}}'),
        text(head, ',"video":{"bit_rate":', rate,
             ',"frame_rate":25,"decoder":"h264","size":{"height":"3"}}}'),
        text("convert ", file_id, " please"),
        text('{"id":"part-', F.col("p_partkey").cast("string"),
             '","extension":"mp4","format":"mp4",', audio, "}"),
        text('{"id":"', file_id, '","format":"mp4",', audio, "}"),
        text(head, ",", audio, ',"video":""}'),
        text(head, ',"audio":{"bit_rate":4294967297,"channels":2,"decoder":"aac",'
             '"sampling_rate":44100}}'),
        text(head, ',"audio":{"bit_rate":', rate,
             ',"channels":true,"decoder":"aac","sampling_rate":44100},'
             '"video":{"bit_rate":', rate, ',"decoder":"h264","size":[]}}'),
        text('{"id":"1-1-1-1-', F.col("p_partkey").cast("string"),
             '","extension":"flv","format":"', fmt, '","progress_id":"', file_id, '",',
             '"audio":{"bit_rate":', rate,
             ',"channels":0,"decoder":"mp3","sampling_rate":44100.9},'
             '"video":{"bit_rate":-1,"frame_rate":30,"decoder":"","tag":"x",'
             '"profile":"Some(HIGH)","size":{"height":1,"width":2}}}'),
    ]
    raw = bodies[-1]
    choice = F.when(shape == 0, bodies[0])
    for i, body in enumerate(bodies[1:-1], start=1):
        choice = choice.when(shape == i, body)
    # a request is small to store and long to check: the few splits of the file are dealt to more tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey").select(
        F.col("p_partkey").alias("request_key"),
        F.timestamp_seconds(F.col("p_partkey") + REQUEST_EPOCH).alias("ts"),
        choice.otherwise(raw).alias("raw"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_body(request_bodies(spark, sf_dir))


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as probe results; some lack the audio, the video or both tracks."""
    key = F.col("o_orderkey")
    audio = F.struct(
        (F.col("o_custkey") * 100).cast("int").alias("bit_rate"),
        (key % 2 + 1).cast("int").alias("channels"),
        F.lit("aac (LC)").alias("decoder"), F.lit(44100).alias("sampling_rate"),
    )
    video = F.struct(
        (key * 10).cast("int").alias("bit_rate"),
        (key % 60 + 0.5).cast("double").alias("frame_rate"), F.lit("h264 (High)").alias("decoder"),
        (key % 7 + 640).cast("int").alias("width"), F.lit(360).alias("height"),
    )
    ending = F.when(key % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), pick(EXTENSIONS, key % 5))
    )
    file = F.struct(
        F.concat(F.lit("order-"), key, ending).alias("file_name"),
        F.lit(S.UPLOAD_DIR).alias("full_path"),
        pick(CONTENT_TYPES, key % 5).alias("content_type"),
        F.lit(S.FILE_STATUS_UPLOADED).alias("status"), uuid_shaped(key).alias("file_id"),
    )
    return table(spark, sf_dir, "orders").select(
        file.alias("file"), (key * 1000).alias("duration"), F.lit("flv").alias("format"),
        F.when(key % 3 != 0, audio).alias("audio_track"),
        F.when(key % 5 != 0, video).alias("video_track"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", uuid_shaped("user_id").alias("id"), F.col("props").alias("msg"), "ts"
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as consumers: three per id at the small scale, ids without messages included."""
    return table(spark, sf_dir, "customer").select(
        uuid_shaped(F.col("c_custkey") % 500).alias("id"),
        F.concat(F.lit("consumer-"), "c_custkey").alias("ref"),
    )


def timed_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as consumers that come and go: minutes to weeks, some for good, some for no time."""
    start = F.col("c_custkey") * 7919 % 43_200
    minutes = F.col("c_custkey") * 104_729 % 20_160 - 60
    at = lambda m: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))
    return table(spark, sf_dir, "customer").select(
        uuid_shaped(F.col("c_custkey") % 20).alias("id"),
        F.concat(F.lit("consumer-"), F.col("c_custkey") % 90).alias("ref"),
        at(start).alias("registered_at"),
        F.when(F.col("c_custkey") % 7 > 0, at(start + minutes)).alias("terminated_at"),
    )


def terminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("consumer-"), F.col("s_suppkey") * 3).alias("ref")
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        uuid_shaped("user_id").alias("progress_id"), F.col("event_id").alias("event_seq"),
        (F.col("event_id") % 1001).cast("int").alias("permil"),
    )


def codec_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as codecs of three kinds; half of them decode only."""
    key = F.col("n_nationkey")
    kind = pick(("video", "audio", "format"), key % 3)
    name = F.lower("n_name")
    return table(spark, sf_dir, "nation").groupBy(kind.alias("kind")).agg(
        F.collect_list(F.when(key % 2 == 0, name)).alias("encoders"),
        F.collect_list(name).alias("decoders"),
    )
