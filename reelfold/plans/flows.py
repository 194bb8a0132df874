"""The three flows a user runs: upload, convert, search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from reelfold import schemas as S
from reelfold.operators.catalog import build_catalog, catalog_json, search
from reelfold.operators.convert import (
    added_journal, converted_journal, plan_conversion, playable, progress_reply, resolve_path,
    status_journal,
)
from reelfold.operators.jobs import probe_files, run_conversions
from reelfold.operators.skew import join_unique
from reelfold.operators.media import describe, preferences_json, to_preferences
from reelfold.operators.validate import quarantine, read_preferences
from reelfold.session import materialize
from reelfold.sources.files import limit_size


@dataclass(frozen=True)
class Upload:
    accepted: DataFrame
    rejected: DataFrame
    events: DataFrame

    def answers(self, probe_fn: Callable[[dict], dict]) -> DataFrame:
        """Preferences document of every accepted file, from the caller's probe."""
        probed = probe_files(self.accepted, probe_fn)
        return preferences_json(to_preferences(describe(probed.filter(F.col("error").isNull()))))


def upload(files: DataFrame, max_bytes: int = S.MAX_UPLOAD_BYTES) -> Upload:
    """Files ``(file_id, file_name, content_type, length, ts, event_id, …)`` to events."""
    accepted, rejected = limit_size(files, max_bytes)
    events = added_journal(accepted)
    record = F.struct(
        F.col("file_name"), F.lit(S.UPLOAD_DIR).alias("full_path"), F.col("content_type"),
        F.lit(S.FILE_STATUS_UPLOADED).alias("status"), F.col("file_id"),
    )
    return Upload(accepted.withColumn("file", record), rejected, events)


@dataclass(frozen=True)
class Conversion:
    planned: DataFrame
    refused: DataFrame
    rejected: DataFrame

    @property
    def events(self) -> DataFrame:
        return converted_journal(self.planned)

    @property
    def replies(self) -> DataFrame:
        return progress_reply(self.planned)

    def run(self, convert_fn, out_dir: str) -> DataFrame:
        """Results of every planned conversion, stored: reading them again converts nothing again."""
        results = materialize(run_conversions(self.planned, convert_fn, out_dir), "converted")
        asked = self.planned.select("file_id", "ts", F.col("request_key").alias("event_id"))
        return results.join(asked, "file_id")

    @staticmethod
    def outcome_events(results: DataFrame) -> DataFrame:
        """``UpdatedStatus`` events of what :meth:`run` returns."""
        return status_journal(results)


def convert(
    requests: DataFrame, state: DataFrame, converted: DataFrame | None = None,
    uploaded: DataFrame | None = None,
) -> Conversion:
    """Parsed requests ``(request_key, ts, raw, body)`` and current state to plans.

    Bodies are parsed once; plans, refusals and rejections read the stored verdicts. The listings
    (``file_name, path``) give the plans their source paths.
    """
    judged = materialize(read_preferences(requests).drop("body"), "judged")
    valid, rejected = quarantine(judged)
    planned, refused = plan_conversion(valid.drop("raw"), state, converted, uploaded)
    return Conversion(planned, refused, rejected)


def play(
    ids: DataFrame, state: DataFrame, converted: DataFrame, uploaded: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Files to play back and refusals, of asked ids (``id``).

    The first frame is ``(file_id, path, …)`` of playable files, ready for ``read_chunks`` once it
    has their lengths; the second has the ``reason`` of every other id.
    """
    sources = state.select(
        F.col("persistence_id").alias("id"), F.col("file.file_name").alias("file_name"),
        F.col("file.content_type").alias("content_type"), F.col("file.file_id").alias("file_id"),
    )
    found = join_unique(ids.withColumn("_asked", F.col("id")), sources, "id")
    judged = playable(resolve_path(found, converted, uploaded)).drop("_asked")
    return judged.filter("playable"), judged.filter("NOT playable").select("id", "reason")


def search_catalog(journal: DataFrame, key: str | None = None) -> DataFrame:
    """Published catalogue rows, all or those that contain ``key``."""
    catalog = build_catalog(journal)
    return catalog_json(catalog if key is None else search(catalog, key))
