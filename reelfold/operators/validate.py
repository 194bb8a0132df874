"""Validation of JSON bodies held as VARIANT: typed structs, error lists and quarantine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reelfold import schemas as S
from reelfold.functions import variants as V
from reelfold.functions.guards import content_type_default, valid_content_type
from reelfold.functions.ids import parse_uuid, uuid_shaped


def parse_body(df: DataFrame, raw: str = "raw", out: str = "body") -> DataFrame:
    """Add the body as VARIANT; text that is not JSON gives null."""
    return df.withColumn(out, F.try_parse_json(raw))


def evaluate_once(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer moves a filter on computed columns below them and repeats their whole
    expressions in the filter, here every JSON lookup. It does not move one below a generator, so
    the finished columns pass through one that yields a single row.
    """
    done = df.select(*keep, *[value.alias(f"_once_{name}") for name, value in columns.items()])
    row = F.struct(*[F.col(f"_once_{name}").alias(name) for name in columns])
    return done.select(*keep, F.inline(F.array(row)))


# --- tracks -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Track:
    """Struct of one track, and the names of its wrong fields in report order."""

    value: Column
    errors: Column


def _audio_fields(path: str) -> dict[str, V.Field]:
    return {
        "audio": V.Field(path, V.OBJECT),
        "audio_channels": V.Field(f"{path}.channels", V.INT, 0),
        "audio_sampling_rate": V.Field(f"{path}.sampling_rate", V.INT, 0),
        "audio_quality": V.Field(f"{path}.quality", V.INT, 0, required=False),
        "audio_volume": V.Field(f"{path}.volume", V.INT, 0, required=False),
        "audio_bit_rate": V.Field(f"{path}.bit_rate", V.INT, 0),
        "audio_decoder": V.Field(f"{path}.decoder", V.STRING, ""),
    }


def _audio_track(f: Mapping[str, V.Extracted]) -> Track:
    order = ("channels", "sampling_rate", "quality", "volume", "bit_rate", "decoder")
    shape = ("bit_rate", "channels", "decoder", "sampling_rate", "quality", "volume")
    return Track(
        F.struct(*[f[f"audio_{n}"].value.alias(n) for n in shape]),
        V.collect_errors(*[f[f"audio_{n}"].error for n in order]),
    )


def _video_fields(path: str) -> dict[str, V.Field]:
    return {
        "video": V.Field(path, V.OBJECT),
        "video_frame_rate": V.Field(f"{path}.frame_rate", V.DOUBLE, 0.0),
        "video_size": V.Field(f"{path}.size", V.OBJECT),
        "video_height": V.Field(f"{path}.size.height", V.INT, 0, report="size.height"),
        "video_width": V.Field(f"{path}.size.width", V.INT, 0, report="size.width"),
        "video_tag": V.Field(f"{path}.tag", V.STRING, "", required=False, strict=False),
        "video_profile": V.Field(f"{path}.profile", V.STRING, required=False, strict=False),
        "video_bit_rate": V.Field(f"{path}.bit_rate", V.INT, 0),
        "video_decoder": V.Field(f"{path}.decoder", V.STRING, ""),
    }


def _video_track(f: Mapping[str, V.Extracted]) -> Track:
    has_size = f["video_size"].value.isNotNull()
    value = F.struct(
        *[f[f"video_{n}"].value.alias(n) for n in ("bit_rate", "frame_rate", "decoder")],
        F.struct(*[f[f"video_{n}"].value.alias(n) for n in ("width", "height")]).alias("size"),
        *[f[f"video_{n}"].value.alias(n) for n in ("tag", "profile")],
    )
    errors = V.collect_errors(
        f["video_frame_rate"].error, f["video_size"].error,
        F.when(has_size, f["video_height"].error), F.when(has_size, f["video_width"].error),
        f["video_bit_rate"].error, f["video_decoder"].error,
    )
    return Track(value, errors)


def read_audio(
    df: DataFrame, body: str = "body", path: str = "$.audio", wrap: bool = False
) -> DataFrame:
    """Add ``audio`` and ``audio_errors``, both null where there is no object at ``path``.

    ``quality`` and ``volume`` may be missing but not mistyped.
    """
    read, f = V.read_fields(df, body, _audio_fields(path), wrap)
    return _add_track(df, read, "audio", f["audio"].value, _audio_track(f))


def read_video(
    df: DataFrame, body: str = "body", path: str = "$.video", wrap: bool = False
) -> DataFrame:
    """Add ``video`` and ``video_errors``, both null where there is no object at ``path``.

    A mistyped ``tag`` or ``profile`` counts as absent. A missing side of ``size`` is reported by
    its own name and a mistyped one with the ``size.`` prefix; a ``size`` that is missing or not
    an object is reported as ``size``.
    """
    read, f = V.read_fields(df, body, _video_fields(path), wrap)
    return _add_track(df, read, "video", f["video"].value, _video_track(f))


def _add_track(df: DataFrame, read: DataFrame, name: str, found: Column, track: Track) -> DataFrame:
    return evaluate_once(
        read,
        {name: F.when(found, track.value), f"{name}_errors": F.when(found, track.errors)},
        df.columns,
    )


# --- whole bodies -------------------------------------------------------------------------------


def _distinct_id(prefix: str, df: DataFrame, key: str, raw: str) -> Column:
    """An id of the row: of its key where there is one, so that equal bodies get ids of their own."""
    return uuid_shaped(F.concat(F.lit(prefix), F.coalesce(F.col(key).cast("string"), F.col(raw))
                                if key in df.columns else F.col(raw)))


def read_preferences(
    df: DataFrame, body: str = "body", raw: str = "raw", wrap: bool = False,
    key: str = "request_key",
) -> DataFrame:
    """Add ``id, extension, format, file_name, progress, audio, video, reason, fields``.

    Accepted rows have a null ``reason``. The body needs a UUID ``id``, strings ``extension`` and
    ``format``, and an object ``audio``, ``video`` or both; anything else is malformed. Field
    errors of both tracks are reported together, audio's first. A missing or bad ``progress_id``
    is replaced by one derived from the column ``key``, or from the raw text where there is none.
    """
    fields = {
        "id": V.Field("$.id", V.STRING),
        "extension": V.Field("$.extension", V.STRING),
        "format": V.Field("$.format", V.STRING),
        "progress_id": V.Field("$.progress_id", V.STRING, required=False, strict=False),
        **_audio_fields("$.audio"), **_video_fields("$.video"),
    }
    read, f = V.read_fields(df, body, fields, wrap)
    audio, video = _audio_track(f), _video_track(f)
    has_audio, has_video = f["audio"].value.isNotNull(), f["video"].value.isNotNull()
    file_id = parse_uuid(f["id"].value)
    shaped = (
        file_id.isNotNull() & f["extension"].error.isNull() & f["format"].error.isNull()
        & (has_audio | F.col("_m_audio")) & (has_video | F.col("_m_video"))
        & (has_audio | has_video)
    )
    derived = _distinct_id("progress:", df, key, raw)
    judged = evaluate_once(
        read,
        {
            "_shaped": shaped,
            "id": file_id, "extension": f["extension"].value, "format": f["format"].value,
            "file_name": F.lit(""),
            "progress": F.coalesce(parse_uuid(f["progress_id"].value), derived),
            "audio": F.when(has_audio, audio.value),
            "video": F.when(has_video, video.value),
            "_errors": _both(has_audio, audio, has_video, video),
        },
        df.columns,
    )
    return _with_verdict(
        judged, df.columns,
        ["id", "extension", "format", "file_name", "progress", "audio", "video"],
    )


def _both(has_audio: Column, audio: Track, has_video: Column, video: Track) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(has_audio, audio.errors).otherwise(none),
        F.when(has_video, video.errors).otherwise(none),
    )


def read_media(
    df: DataFrame, body: str = "body", raw: str = "raw", wrap: bool = False,
    key: str = "request_key",
) -> DataFrame:
    """Add ``info, duration, format, audio, video, reason, fields``.

    Needs objects ``info`` and ``audio``, a number ``duration`` and a string ``format``; ``video``
    may be missing. A body with video alone is malformed. A missing ``info.id`` is derived from
    the column ``key``, or from the raw text where there is none.
    """
    fields = {
        "info": V.Field("$.info", V.OBJECT),
        "name": V.Field("$.info.file_name", V.STRING, ""),
        "content_type": V.Field("$.info.content_type", V.STRING),
        "id": V.Field("$.info.id", V.STRING, required=False),
        "duration": V.Field("$.duration", V.INT if wrap else V.LONG, 0),
        "duration_number": V.Field("$.duration", V.DOUBLE),
        "format": V.Field("$.format", V.STRING),
        **_audio_fields("$.audio"), **_video_fields("$.video"),
    }
    read, f = V.read_fields(df, body, fields, wrap)
    audio, video = _audio_track(f), _video_track(f)
    has_audio, has_video = f["audio"].value.isNotNull(), f["video"].value.isNotNull()
    content_type, media_id = f["content_type"].value, parse_uuid(f["id"].value)
    content_error = F.when(~valid_content_type(content_type), F.lit("content_type"))
    id_error = F.coalesce(
        f["id"].error, F.when(f["id"].value.isNotNull() & media_id.isNull(), F.lit("id"))
    )
    shaped = (
        f["info"].value.isNotNull() & f["duration_number"].value.isNotNull()
        & f["format"].error.isNull() & has_audio & (has_video | F.col("_m_video"))
    )
    derived = _distinct_id("media:", df, key, raw)
    info = F.struct(
        f["name"].value.alias("file_name"),
        content_type_default(content_type).alias("content_type"),
        F.lit(0).alias("status"),
        F.coalesce(media_id, derived).alias("id"),
    )
    judged = evaluate_once(
        read,
        {
            "_shaped": shaped,
            "info": info,
            "duration": f["duration"].value.cast("bigint"),
            "format": f["format"].value,
            "audio": F.when(has_audio, audio.value),
            "video": F.when(has_video, video.value),
            "_errors": F.concat(
                V.collect_errors(f["name"].error, id_error, content_error, f["duration"].error),
                _both(has_audio, audio, has_video, video),
            ),
        },
        df.columns,
    )
    return _with_verdict(judged, df.columns, ["info", "duration", "format", "audio", "video"])


def _with_verdict(read: DataFrame, kept: list[str], values: list[str]) -> DataFrame:
    """Turn shape and field errors into ``reason`` and ``fields``; rejected rows keep no values."""
    reason = F.when(~F.col("_shaped"), F.lit(S.MALFORMED_REQUEST)).when(
        F.size("_errors") > 0, F.lit(S.INVALID_FIELDS)
    )
    judged = read.withColumn("reason", reason)
    return judged.select(
        *kept,
        *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in values],
        "reason",
        F.when(F.col("_shaped"), F.col("_errors"))
        .otherwise(F.array().cast("array<string>"))
        .alias("fields"),
    )


def quarantine(judged: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with the raw body, the reason and the wrong fields."""
    valid = judged.filter(F.col("reason").isNull()).drop("reason", "fields")
    rejected = judged.filter(F.col("reason").isNotNull()).select(raw, "reason", "fields")
    return valid, rejected


# --- forms and codec lists ----------------------------------------------------------------------


@dataclass(frozen=True)
class FormField:
    """One expected form field."""

    default: str | None
    required: bool = True


def validate_form(v: Column, spec: Mapping[str, FormField]) -> Column:
    """Struct ``(values map, errors map, has_errors)``; any type but JSON null is accepted.

    Values are text: strings as they are, other types as JSON (numbers cut to whole ones).
    """
    values, errors = [], []
    for name, field in spec.items():
        path = f"$.{name}"
        found = V.kind(v, path)
        text = (
            F.when(found.isin(V.MISSING, V.NULL), F.lit(field.default).cast("string"))
            .when(found == V.NUMBER, V.json_int(v, path, wrap=True).cast("string"))
            .when(found == V.STRING, F.try_variant_get(v, path, "string"))
            .otherwise(F.to_json(F.try_variant_get(v, path, "variant")))
        )
        error = F.when(found == V.NULL, F.lit(S.FIELD_INVALID_TYPE))
        if field.required:
            error = error.when(found == V.MISSING, F.lit(S.FIELD_REQUIRED))
        values += [F.lit(name), text]
        errors += [F.lit(name), error]
    wrong = F.map_filter(F.create_map(*errors), lambda _, e: e.isNotNull())
    return F.struct(
        F.create_map(*values).alias("values"),
        wrong.alias("errors"),
        (F.size(wrong) > 0).alias("has_errors"),
    )


def form_get(form: Column, key: str, default: str) -> Column:
    """One value of a validated form."""
    return F.coalesce(F.try_element_at(form["values"], F.lit(key)), F.lit(default))


def read_codec_lists(v: Column) -> Column:
    """Struct ``(encoders, decoders, error)`` from arrays of the same names."""
    both = V.has_kind(v, "$.encoders", V.ARRAY) & V.has_kind(v, "$.decoders", V.ARRAY)
    return F.struct(
        F.when(both, F.try_variant_get(v, "$.encoders", "array<string>")).alias("encoders"),
        F.when(both, F.try_variant_get(v, "$.decoders", "array<string>")).alias("decoders"),
        F.when(~both, F.lit(S.INVALID_CODEC_LISTS)).alias("error"),
    )
