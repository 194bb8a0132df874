"""Media descriptions, preferences and codec lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelfold import schemas as S
from reelfold.functions.names import get_extension

MAX_CODECS = 100_000  # rows that may meet in one document


def describe(probed: DataFrame) -> DataFrame:
    """Probe result to a media description.

    Expects ``file`` (a file record), ``duration``, ``format`` and the nullable structs
    ``audio_track(bit_rate, channels, decoder, sampling_rate)`` and
    ``video_track(bit_rate, frame_rate, decoder, width, height)``.
    """
    a, v = F.col("audio_track"), F.col("video_track")
    audio = F.struct(
        a["bit_rate"].cast("int").alias("bit_rate"),
        a["channels"].cast("int").alias("channels"),
        a["decoder"].alias("decoder"),
        a["sampling_rate"].cast("int").alias("sampling_rate"),
        F.lit(0).alias("quality"),
        F.lit(0).alias("volume"),
    )
    video = F.struct(
        v["bit_rate"].cast("int").alias("bit_rate"),
        v["frame_rate"].cast("double").alias("frame_rate"),
        v["decoder"].alias("decoder"),
        F.struct(
            v["width"].cast("int").alias("width"), v["height"].cast("int").alias("height")
        ).alias("size"),
        F.lit("").alias("tag"),
        F.lit(None).cast("string").alias("profile"),
    )
    return probed.select(
        F.struct(
            F.col("file.file_name").alias("file_name"),
            F.col("file.content_type").alias("content_type"),
            F.col("file.status").alias("status"),
            F.col("file.file_id").alias("id"),
        ).alias("info"),
        F.col("duration").cast("bigint").alias("duration"),
        "format",
        F.when(a.isNotNull(), audio).alias("audio"),
        F.when(v.isNotNull(), video).alias("video"),
    )


def is_media() -> Column:
    """At least one track is present."""
    return F.col("audio").isNotNull() | F.col("video").isNotNull()


def to_preferences(described: DataFrame) -> DataFrame:
    """Description to conversion preferences; the extension comes from the name."""
    return described.select(
        F.col("info.id").alias("id"),
        "audio", "video",
        get_extension("info.file_name").alias("extension"),
        "format",
        F.col("info.file_name").alias("file_name"),
    )


def with_file_name(df: DataFrame, name: Column | str) -> DataFrame:
    return df.withColumn("file_name", F.col(name) if isinstance(name, str) else name)


def preferences_json(preferences: DataFrame) -> DataFrame:
    """``id`` and JSON ``body``: the tracks that exist, or the non-media answer.

    ``to_json`` leaves null fields out, which gives the three track shapes from one struct.
    """
    audio, video = F.col("audio"), F.col("video")
    video_json = F.struct(
        video["bit_rate"].alias("bit_rate"), video["frame_rate"].alias("frame_rate"),
        video["decoder"].alias("decoder"), video["tag"].alias("tag"),
        video["profile"].alias("profile"), video["size"].alias("size"),
    )
    audio_json = F.struct(
        audio["bit_rate"].alias("bit_rate"), audio["channels"].alias("channels"),
        audio["decoder"].alias("decoder"), audio["volume"].alias("volume"),
        audio["quality"].alias("quality"), audio["sampling_rate"].alias("sampling_rate"),
    )
    media = F.to_json(
        F.struct(
            F.col("id").alias("id"),
            F.when(video.isNotNull(), video_json).alias("video"),
            F.when(audio.isNotNull(), audio_json).alias("audio"),
            "format", "extension",
        )
    )
    non_media = F.to_json(F.struct(F.col("id"), F.lit(S.NON_MEDIA_FILE).alias("reason")))
    return preferences.select("id", F.when(is_media(), media).otherwise(non_media).alias("body"))


def media_json(described: DataFrame) -> DataFrame:
    """``id`` and JSON ``body`` of a description; absent tracks are JSON null.

    Narrower than :func:`preferences_json`: no tag, profile, quality or volume.
    """
    audio, video = F.col("audio"), F.col("video")
    video_json = F.struct(
        video["bit_rate"].alias("bit_rate"), video["frame_rate"].alias("frame_rate"),
        video["decoder"].alias("decoder"), video["size"].alias("size"),
    )
    audio_json = F.struct(
        audio["bit_rate"].alias("bit_rate"), audio["channels"].alias("channels"),
        audio["decoder"].alias("decoder"), audio["sampling_rate"].alias("sampling_rate"),
    )
    body = F.struct(
        media_info_struct().alias("info"), "duration",
        F.when(video.isNotNull(), video_json).alias("video"),
        F.when(audio.isNotNull(), audio_json).alias("audio"),
        "format",
    )
    return described.select(
        F.col("info.id").alias("id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body")
    )


def media_info_struct() -> Column:
    info = F.col("info")
    return F.struct(
        info["file_name"].alias("file_name"), info["content_type"].alias("content_type"),
        info["status"].alias("status"), info["id"].alias("id"),
    )


def media_info_json(described: DataFrame) -> DataFrame:
    return described.select("info.file_name", "info.content_type", "info.status", "info.id")


def codec_catalog(lists: DataFrame) -> DataFrame:
    """``(kind, direction, name)`` rows from ``kind`` with arrays ``encoders`` and ``decoders``."""
    sides = F.array(
        F.struct(F.lit("encoder").alias("direction"), F.col("encoders").alias("names")),
        F.struct(F.lit("decoder").alias("direction"), F.col("decoders").alias("names")),
    )
    return (
        lists.select("kind", F.explode(sides).alias("side"))
        .select("kind", "side.direction", F.explode("side.names").alias("name"))
    )


def codec_json(catalog: DataFrame, is_video: bool = True, is_audio: bool = True) -> DataFrame:
    """One JSON document of the codec lists; a switched-off kind is ``""``.

    Codec names are an encoder's fixed vocabulary (some hundreds), not data: a table of more than
    ``MAX_CODECS`` different rows is refused before anything is gathered.
    """
    catalog = catalog.select("kind", "direction", "name").distinct()
    if catalog.limit(MAX_CODECS + 1).count() > MAX_CODECS:
        raise ValueError(f"more than {MAX_CODECS} codecs")

    def names(kind: str, direction: str) -> Column:
        mine = (F.col("kind") == kind) & (F.col("direction") == direction)
        return F.array_sort(F.collect_set(F.when(mine, F.col("name"))))

    def side(kind: str) -> Column:
        return F.to_json(
            F.struct(
                names(kind, "encoder").alias("encoders"), names(kind, "decoder").alias("decoders")
            )
        )

    off = F.lit('""')
    profiles = F.lit("[" + ",".join(f'"{p.lower()}"' for p in S.H264_PROFILES) + "]")
    return catalog.agg(
        F.concat(
            F.lit('{"video":'), side("video") if is_video else off,
            F.lit(',"audio":'), side("audio") if is_audio else off,
            F.lit(',"format":'), side("format"),
            F.lit(',"profile":'), profiles, F.lit("}"),
        ).alias("body")
    )
