"""Conversion planning: lookups, new journal rows and encoder settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelfold import schemas as S
from reelfold.functions.guards import (
    content_type_error, non_empty_string, non_zero, profile_error, valid_content_type,
)
from reelfold.functions.ids import uuid_shaped
from reelfold.functions.names import generate_name
from reelfold.operators.media import with_file_name
from reelfold.operators.skew import join_unique


def requests_with_state(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Each request with its source file: ``outcome`` found, not_found or unknown.

    ``reply`` is the JSON answer where no conversion can start. The requests are counted by id
    before they are joined, so hand in a stored frame rather than one that parses on each pass.
    """
    sources = state.filter(F.col("file.file_id").isNotNull()).select(
        F.col("persistence_id").alias("_source_id"),
        F.col("file").alias("source"), F.col("status").alias("source_status"),
    )
    joined = join_unique(
        requests.withColumn("_source_id", F.col("id")), sources, "_source_id",
        spread_by=["request_key"],
    )
    outcome = (
        F.when(F.col("id").isNull(), F.lit("unknown"))
        .when(F.col("source").isNull(), F.lit("not_found"))
        .otherwise(F.lit("found"))
    )
    not_found = F.to_json(F.struct(F.col("id"), F.lit(S.FILE_NOT_FOUND).alias("reason")))
    reply = F.when(F.col("outcome") == "unknown", F.lit(S.UNKNOWN_REPLY)).when(
        F.col("outcome") == "not_found", not_found
    )
    return joined.withColumn("outcome", outcome).withColumn("reply", reply)


def resolve_path(files: DataFrame, converted: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Add ``path`` and ``origin``: the converted file if it exists, else the uploaded one.

    The listings hold ``file_name, path``. They are folded to one row per name first, so the files
    shuffle once.
    """
    absent = F.lit(None).cast("string")
    listed = converted.select(
        "file_name", F.col("path").alias("_converted"), absent.alias("_uploaded")
    ).unionByName(
        uploaded.select("file_name", absent.alias("_converted"), F.col("path").alias("_uploaded"))
    )
    by_name = listed.groupBy("file_name").agg(
        F.min("_converted").alias("_converted"), F.min("_uploaded").alias("_uploaded")
    )
    origin = F.when(F.col("_converted").isNotNull(), F.lit("converted")).when(
        F.col("_uploaded").isNotNull(), F.lit("uploaded")
    )
    return (
        join_unique(
            files, by_name, "file_name",
            # files without a name match nothing and must not meet in one partition
            spread_by=["file_id"] if "file_id" in files.columns else None,
        )
        .withColumn("path", F.coalesce("_converted", "_uploaded"))
        .withColumn("origin", origin)
        .drop("_converted", "_uploaded")
    )


def playable(resolved: DataFrame) -> DataFrame:
    """Add ``playable`` and ``reason`` to files with ``file_id, content_type, path``."""
    reason = (
        F.when(F.col("file_id").isNull() | F.col("path").isNull(), F.lit(S.FILE_NOT_FOUND))
        .otherwise(content_type_error("content_type"))
    )
    ok = (
        F.col("file_id").isNotNull() & F.col("path").isNotNull()
        & valid_content_type("content_type")
    )
    return resolved.withColumn("playable", ok).withColumn("reason", reason)


def attempts_with_outcome(
    attempts: DataFrame, outcomes: DataFrame, order: str | None = None
) -> DataFrame:
    """Status of each conversion attempt; without an outcome (``file_id, ok``) it still runs.

    A file that was tried again has several outcomes: the newest by the column ``order`` holds, or
    without one any that succeeded. Each attempt stays one row.
    """
    newest = F.max_by("ok", order) if order else F.bool_or("ok")
    outcomes = (
        outcomes.filter(F.col("file_id").isNotNull() & F.col("ok").isNotNull())
        .groupBy("file_id").agg(newest.alias("ok"))
    )
    spread = [c for c in attempts.columns if c != "file_id"]
    status = (
        F.when(F.col("ok").isNull(), F.lit(S.STATUS_INPROGRESS))
        .when(F.col("ok"), F.lit(S.STATUS_COMPLETE))
        .otherwise(F.lit(S.STATUS_FAILED))
    )
    joined = join_unique(attempts, outcomes, "file_id", spread_by=spread or None)
    return joined.withColumn("status", status).drop("ok")


def file_record(
    name: Column, folder: Column | str, content_type: Column, status: int, file_id: Column
) -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.struct(
        name.alias("file_name"), folder.alias("full_path"), content_type.alias("content_type"),
        F.lit(status).alias("status"), file_id.alias("file_id"),
    )


def added_journal(uploads: DataFrame, folder: str = S.UPLOAD_DIR) -> DataFrame:
    """``FileAdded`` events from uploads ``(file_id, file_name, content_type, ts, event_id)``."""
    file = file_record(
        F.col("file_name"), folder, F.col("content_type"), S.FILE_STATUS_UPLOADED, F.col("file_id")
    )
    return uploads.select(
        F.col("file_id").alias("persistence_id"), "ts", "event_id",
        F.lit(S.FILE_ADDED).alias("event_type"), file.alias("file"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("source_file_id"),
    )


def converted_journal(plan: DataFrame, folder: str = S.CONVERT_DIR) -> DataFrame:
    """``ConvertedFile`` events of planned conversions, on the new entity, source id kept."""
    file = file_record(
        F.col("new_name"), folder, F.lit(""), S.FILE_STATUS_CONVERTED, F.col("file_id")
    )
    return plan.select(
        F.col("file_id").alias("persistence_id"), "ts",
        F.col("request_key").alias("event_id"),
        F.lit(S.CONVERTED_FILE).alias("event_type"), file.alias("file"),
        F.lit(None).cast("string").alias("status"), "source_file_id",
    )


def status_journal(results: DataFrame, folder: str = S.CONVERT_DIR) -> DataFrame:
    """``UpdatedStatus`` events from conversion results ``(file_id, new_name, status, ts)``."""
    file = file_record(
        F.col("new_name"), folder, F.lit(""), S.FILE_STATUS_CONVERTED, F.col("file_id")
    )
    return results.select(
        F.col("file_id").alias("persistence_id"), "ts", "event_id",
        F.lit(S.UPDATED_STATUS).alias("event_type"), file.alias("file"), "status",
        F.lit(None).cast("string").alias("source_file_id"),
    )


def progress_reply(plan: DataFrame) -> DataFrame:
    """Answer to a started conversion."""
    return plan.select(
        F.col("new_name").alias("file_name"), F.col("file_id").alias("id"),
        F.lit(S.STATUS_INPROGRESS).alias("status"),
    )


def plan_audio(audio: Column | str) -> Column:
    """Encoder settings of the audio track; zero and blank values are left to the encoder.

    ``quality`` is not a setting.
    """
    a = F.col(audio) if isinstance(audio, str) else audio
    settings = F.struct(
        non_empty_string(a["decoder"]).alias("codec"),
        non_zero(a["bit_rate"]).alias("bit_rate"),
        non_zero(a["sampling_rate"]).alias("sampling_rate"),
        non_zero(a["channels"]).alias("channels"),
        non_zero(a["volume"]).alias("volume"),
    )
    return F.when(a.isNotNull(), settings)


def plan_video(video: Column | str) -> Column:
    """Encoder settings of the video track.

    The frame rate is tested before it is cut to a whole number, so 0.5 becomes 0. An unknown
    profile is carried as it is; see ``profile_error``.
    """
    v = F.col(video) if isinstance(video, str) else video
    whole_rate = F.least(F.floor(v["frame_rate"]), F.lit(2147483647).cast("bigint")).cast("int")
    settings = F.struct(
        non_zero(v["bit_rate"]).alias("bit_rate"),
        F.when(v["frame_rate"] > 0, whole_rate).alias("frame_rate"),
        non_empty_string(v["decoder"]).alias("codec"),
        non_empty_string(v["tag"]).alias("tag"),
        v["size"].alias("size"),
        v["profile"].alias("profile"),
    )
    return F.when(v.isNotNull(), settings)


def plan_conversion(
    requests: DataFrame, state: DataFrame, converted: DataFrame | None = None,
    uploaded: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Plans for requests whose source exists, and replies for the others.

    ``requests`` are validated preferences with ``request_key`` and ``ts``. The new entity's id
    and the new name come from the request key: planning again makes no second entity. With the
    listings of converted and uploaded files (``file_name, path``) a plan names the ``source_path``
    to open, the converted file before the uploaded one; a source that is in neither is a
    ``plan_error``.
    """
    matched = requests_with_state(requests, state)
    found = with_file_name(matched.filter(F.col("outcome") == "found"), "source.file_name")
    planned = (
        found.withColumn("source_file_id", F.col("id"))
        .withColumn("file_id", uuid_shaped(F.concat(F.lit("convert:"), F.col("request_key"))))
        .withColumn("new_name", generate_name("file_id", "ts", "extension"))
        .select(
            "request_key", "ts", "source_file_id", "file_id",
            F.col("file_name").alias("source_name"), F.col("source.status").alias("source_kind"),
            "new_name", "format", "progress",
            plan_audio("audio").alias("audio"), plan_video("video").alias("video"),
            F.when(
                profile_error(F.col("video.profile")),
                F.concat(F.lit("unknown profile: "), F.col("video.profile")),
            ).alias("plan_error"),
        )
    )
    if converted is not None and uploaded is not None:
        named = planned.withColumnRenamed("source_name", "file_name")
        located = resolve_path(named, converted, uploaded)
        missing = F.when(F.col("path").isNull(), F.lit(S.FILE_NOT_FOUND))
        planned = (
            located.withColumn("plan_error", F.coalesce("plan_error", missing)).drop("origin")
            .withColumnsRenamed({"file_name": "source_name", "path": "source_path"})
        )
    refused = matched.filter(F.col("outcome") != "found").select(
        "request_key", "id", "outcome", "reply"
    )
    return planned, refused
