"""One registered query per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelfold import schemas as S
from reelfold.functions import guards as G, ids as I, messages as M, names as N, variants as V
from reelfold.operators import (
    catalog as C, convert as P, intervals as IV, jobs, journal as J, media, routing as R,
    substring_index as SI, validate as W,
)
from reelfold.plans import bindings as B
from reelfold.session import materialize, scratch_path
from reelfold.sources import commits as CM, events as E, files as FS, json_lines as JL
from reelfold.sources.requests import scan_requests
from reelfold.streaming import (
    buffer as SB, intake, progress as SP, projection as PR, routing as SR, state as SS, visibility as SV,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- flat outputs -------------------------------------------------------------------------------


def flat_file(prefix: str = "file") -> list[Column]:
    return [
        F.col(f"{prefix}.file_name").alias("file_name"),
        F.col(f"{prefix}.full_path").alias("full_path"),
        F.col(f"{prefix}.content_type").alias("content_type"),
        F.col(f"{prefix}.status").alias("file_status"),
        F.col(f"{prefix}.file_id").alias("file_id"),
    ]


def flat_audio() -> list[Column]:
    return [
        F.col(f"audio.{f}").alias(f"a_{f}")
        for f in ("bit_rate", "channels", "decoder", "sampling_rate", "quality", "volume")
    ]


def flat_video() -> list[Column]:
    return [
        F.col(f"video.{f}").alias(f"v_{f}")
        for f in ("bit_rate", "frame_rate", "decoder", "tag", "profile")
    ] + [
        F.col("video.size.width").alias("v_width"), F.col("video.size.height").alias("v_height")
    ]


def joined(column: str) -> Column:
    return F.array_join(F.col(column), ",").alias(column)


# --- sources and sinks --------------------------------------------------------------------------


def _written_files(spark, d) -> str:
    """The documents as files below a fresh folder; every tenth is an upload of no bytes."""
    out = scratch_path(spark, "files")
    empty = F.encode(F.lit(""), "UTF-8")
    uploads = B.files(spark, d).withColumn("content", F.when(F.col("doc_id") % 10 == 3, empty).otherwise(F.col("content")))
    FS.write_files(FS.chunk_files(uploads, 10_000, keep_empty=True), out, chunks_per_part=None)
    return out


def _listed(found: DataFrame) -> DataFrame:
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_id"), "length")


@query
def s1_scan_files(spark, d):
    return _listed(FS.scan_files(spark, _written_files(spark, d)))


@query
def s2_limit_size(spark, d):
    accepted, rejected = FS.limit_size(B.files(spark, d), 10_000)
    verdict = lambda df, v: df.select("file_id", "length", F.lit(v).alias("verdict"))
    return verdict(accepted, "accepted").unionByName(verdict(rejected, "rejected"))


@query
def s3_reassemble_chunks(spark, d):
    whole, oversize = FS.reassemble_chunks(B.chunks(spark, d))
    return whole.select(
        "file_id", F.md5("data").alias("digest"), F.length("data").cast("bigint").alias("length"),
        "n_chunks", "complete",
    ).unionByName(FS.chunk_digests(oversize))


@query
def s3_oversize_chunks(spark, d):
    _, oversize = FS.reassemble_chunks(B.chunks(spark, d), max_bytes=2_000)
    return oversize.select("file_id", "chunk_no", F.md5("data").alias("digest"))


@query
def s4_chunk_files(spark, d):
    pieces = FS.chunk_files(B.files(spark, d), 10_000)
    return pieces.select("file_id", "chunk_no", F.md5(F.hex("data")).alias("digest"))


@query
def s4_read_chunks(spark, d):
    """Planned byte ranges of written files give the same pieces."""
    out = scratch_path(spark, "ranges")
    FS.write_files(FS.chunk_files(B.files(spark, d), 10_000), out, chunks_per_part=None)
    pieces = FS.scan_chunks(spark, out, 4_000, range_bytes=1_000_000)
    return pieces.select(
        F.element_at(F.split("path", "/"), -1).alias("file_id"), "chunk_no",
        F.md5(F.hex("data")).alias("digest"),
    )


@query
def s5_append_events(spark, d):
    """Two batches of one writer, both sent twice: each event once, numbers going on."""
    path, events = scratch_path(spark, "journal"), B.journal_events(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    for batch, part in ((0, F.col("ts") < cut), (0, F.col("ts") < cut), (1, F.col("ts") >= cut), (1, F.col("ts") >= cut)):
        CM.append_once(events.filter(part), path, "intake", batch)
    return CM.read_committed(spark, path).select(
        "persistence_id", "seq_nr", "event_date", "tag", "event_type",
        F.col("file.file_name").alias("file_name"), "status", "source_file_id",
    )


@query
def s6_scan_events(spark, d):
    import datetime as dt

    scanned = E.scan_events(B.journal(spark, d), "file-2", 10, dt.date(2024, 1, 5))
    return scanned.select("persistence_id", "seq_nr", "ts", "event_type", "tag")


@query
def s7_scan_requests(spark, d):
    path = scratch_path(spark, "requests")
    B.request_bodies(spark, d).select("raw").write.text(path)
    scanned = scan_requests(spark, path)
    return scanned.select(
        "raw", F.col("body").isNotNull().alias("is_json"),
        F.try_variant_get("body", "$.id", "string").alias("id"),
    )


@query
def s8_codec_catalog(spark, d):
    return media.codec_catalog(B.codec_lists(spark, d))


@query
def s9_publish_events(spark, d):
    return PR.read_published(spark, _published(spark, d)).select(
        "tag", "persistence_id", "seq_nr",
        F.get_json_object("event", "$.event_type").alias("event_type"),
        F.get_json_object("event", "$.file.file_name").alias("file_name"),
    )


@query
def s10_to_json_lines(spark, d):
    path = scratch_path(spark, "lines")
    JL.write_json_lines(C.catalog_json(C.build_catalog(B.journal(spark, d))), path)
    return spark.read.text(path)


@query
def s11_write_files(spark, d):
    """Written in parts of two chunks, sent twice, read back: the bytes of every file."""
    out = scratch_path(spark, "parts")
    chunks = FS.chunk_files(B.files(spark, d), 1_000, keep_empty=True)
    FS.write_files(chunks.unionByName(chunks), out, chunks_per_part=2)
    place = F.split("path", "/")
    parts = FS.scan_files(spark, out).select(
        F.element_at(place, -2).alias("file_id"),
        F.element_at(F.split(F.element_at(place, -1), "-"), -1).cast("int").alias("chunk_no"),
        F.col("content").alias("data"),
    )
    whole, _ = FS.reassemble_chunks(parts)
    return whole.select(
        "file_id", F.length("data").cast("bigint").alias("length"), F.md5("data").alias("digest")
    )


# --- projections --------------------------------------------------------------------------------


@query
def p1_journal_json(spark, d):
    return C.journal_json(B.journal(spark, d), "persistence_id", "seq_nr")


@query
def p2_catalog_json(spark, d):
    return C.catalog_json(C.build_catalog(B.journal(spark, d)))


@query
def p3_lookup_result(spark, d):
    ids = B.table(spark, d, "customer").select(I.uuid_shaped("c_custkey").alias("id"))
    return C.lookup_result(ids, J.current_state(B.journal(spark, d)))


def _described(spark, d) -> DataFrame:
    return media.describe(B.probed(spark, d))


@query
def p4_describe(spark, d):
    return _described(spark, d).select(
        F.col("info.id").alias("id"), "duration", "format", *flat_audio(), *flat_video()
    )


@query
def p5_to_preferences(spark, d):
    return media.to_preferences(_described(spark, d)).select(
        "id", "extension", "format", "file_name", *flat_audio(), *flat_video()
    )


@query
def p6_preferences_json(spark, d):
    return media.preferences_json(media.to_preferences(_described(spark, d)))


@query
def p7_media_json(spark, d):
    return media.media_json(_described(spark, d))


@query
def p8_media_info_json(spark, d):
    return media.media_info_json(_described(spark, d))


@query
def p9_codec_json(spark, d):
    catalog = media.codec_catalog(B.codec_lists(spark, d))
    return media.codec_json(catalog).unionByName(media.codec_json(catalog, is_video=False))


def _valid_requests(spark, d) -> DataFrame:
    """Accepted requests as a stored table: planning reads them more than once."""
    valid, _ = W.quarantine(W.read_preferences(B.requests(spark, d)))
    return materialize(valid.drop("raw", "body"), "requests")


def _stored_journal(spark, d) -> DataFrame:
    return materialize(B.journal(spark, d), "journal")


def _plan(spark, d) -> tuple[DataFrame, DataFrame]:
    return P.plan_conversion(_valid_requests(spark, d), J.current_state(B.journal(spark, d)))


@query
def p10_with_file_name(spark, d):
    found = P.requests_with_state(_valid_requests(spark, d), J.current_state(B.journal(spark, d)))
    named = media.with_file_name(found.filter(F.col("outcome") == "found"), "source.file_name")
    return named.select("request_key", "id", "file_name")


@query
def p11_converted_journal(spark, d):
    return P.converted_journal(_plan(spark, d)[0]).select(
        "persistence_id", "event_type", *flat_file(), "source_file_id"
    )


@query
def p12_added_journal(spark, d):
    uploads = (
        B.files(spark, d)
        .withColumn("ts", F.timestamp_seconds(F.col("doc_id") + B.REQUEST_EPOCH))
        .withColumnRenamed("doc_id", "event_id")
    )
    return P.added_journal(uploads).select("persistence_id", "event_type", *flat_file())


@query
def p13_progress_reply(spark, d):
    return P.progress_reply(_plan(spark, d)[0])


@query
def p14_event_log_line(spark, d):
    return C.event_log_line(B.journal(spark, d))


# --- filters ------------------------------------------------------------------------------------


def _catalog(spark, d) -> DataFrame:
    return C.build_catalog(B.journal(spark, d))


@query
def f1_search(spark, d):
    return C.search(_catalog(spark, d), "mp").select("seq_nr", *flat_file(), "status")


@query
def f1_search_indexed(spark, d):
    """Keys of one and more characters, by the index of the catalogue's files."""
    path = scratch_path(spark, "catalogue")
    SI.append_catalog(_catalog(spark, d), path, 16)
    found = [
        SI.search_indexed(spark, path, key).select(F.lit(key).alias("key"), "seq_nr", *flat_file(), "status")
        for key in ("4", "mp", "ogg", "clip-12", "%", "nowhere")
    ]
    return reduce(DataFrame.unionByName, found)


@query
def f1_search_literal(spark, d):
    """``%`` is an ordinary character, not a wildcard."""
    catalog = B.table(spark, d, "pages").select(
        F.struct(
            F.col("url").alias("file_name"), F.lit("pages").alias("full_path"),
            F.lit("text/html").alias("content_type"), F.lit(0).alias("status"),
            I.uuid_shaped("page_id").alias("file_id"),
        ).alias("file"),
        F.lit(S.STATUS_NONE).alias("status"),
    )
    plain = C.search(catalog, "page=2").select(F.lit("page=2").alias("key"), *flat_file())
    wild = C.search(catalog, "%").select(F.lit("%").alias("key"), *flat_file())
    return plain.unionByName(wild)


@query
def f2_list_all(spark, d):
    return C.list_all(_catalog(spark, d)).select("seq_nr", *flat_file(), "status", "commit_ts")


@query
def f3_lookup(spark, d):
    state = J.current_state(B.journal(spark, d))
    known = C.lookup(state, "c4ca4238-a0b9-2382-0dcc-509a6f75849b")
    return known.select("persistence_id", *flat_file(), "status")


@query
def f4_is_media(spark, d):
    return _described(spark, d).select(F.col("info.id").alias("id"), media.is_media().alias("media"))


@query
def f5_valid_content_type(spark, d):
    shaped = B.pick(
        ("video/", "/mp4", "", "video/mp4; q=1", 'text/html; charset="utf-8"', "a b/c"),
        F.col("p_partkey") % 6,
    )
    given = F.when(F.col("p_partkey") % 2 == 0, shaped).otherwise(
        F.concat(F.lower("p_type"), F.lit("/"), F.translate("p_name", " ", "-"))
    )
    return B.table(spark, d, "part").select("p_partkey", given.alias("given")).select(
        "p_partkey", G.valid_content_type("given").alias("valid"),
        G.content_type_error("given").alias("error"),
    )


def _resolved(spark, d) -> DataFrame:
    name = lambda c: F.concat(F.lit("doc-"), F.col(c))
    files = B.files(spark, d).select(
        F.when(F.col("doc_id") % 13 != 0, F.col("file_id")).alias("file_id"),
        name("doc_id").alias("file_name"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("content_type"))
        .alias("content_type"),
    )
    converted = B.table(spark, d, "labels").select(
        name("doc_id").alias("file_name"),
        N.file_path(F.lit("home"), F.lit(S.CONVERT_DIR), name("doc_id")).alias("path"),
    )
    uploaded = B.table(spark, d, "conversations").select(
        name("conv_id").alias("file_name"),
        N.file_path(F.lit("home"), F.lit(S.UPLOAD_DIR), name("conv_id")).alias("path"),
    )
    return P.resolve_path(files, converted, uploaded)


@query
def f6_playable(spark, d):
    return P.playable(_resolved(spark, d)).select("file_name", "playable", "reason")


def _id_texts() -> Column:
    """Ids of eight shapes around a digest."""
    md = F.md5(F.col("c_custkey").cast("string"))
    key = F.col("c_custkey").cast("string")
    shape = F.col("c_custkey") % 8
    return (
        F.when(shape == 0, F.upper(I.uuid_shaped("c_custkey")))
        .when(shape == 1, F.concat(F.lit("1-1-1-1-"), key))
        .when(shape == 2, F.concat(F.substring(md, 1, 9), F.lit("-1-2-3-4")))
        .when(shape == 3, md)
        .when(shape == 4, F.concat(F.lit("1-12345-1-1-"), F.substring(md, 1, 6)))
        .when(shape == 5, F.concat(I.uuid_shaped("c_custkey"), F.lit("0")))
        .when(shape == 6, F.concat(F.lit("1-1-1-1-"), key, F.lit(" ")))
        .otherwise(I.uuid_shaped("c_custkey"))
    )


@query
def f7_route_id_valid(spark, d):
    return B.table(spark, d, "customer").select(
        "c_custkey", I.route_id_valid(_id_texts()).alias("valid")
    )


@query
def f8_event_is_handled(spark, d):
    handled, rest = J.split_handled(B.journal(spark, d))
    tell = lambda df, v: df.select(
        "persistence_id", "seq_nr", "event_type", F.lit(v).alias("handled")
    )
    return tell(handled, True).unionByName(tell(rest, False))


# --- joins --------------------------------------------------------------------------------------


@query
def j1_requests_with_state(spark, d):
    matched = P.requests_with_state(
        _valid_requests(spark, d), J.current_state(B.journal(spark, d))
    )
    return matched.select(
        "request_key", "id", "outcome", F.col("source.file_name").alias("source_name"),
        "source_status", "reply",
    )


@query
def j2_resolve_path(spark, d):
    return _resolved(spark, d).select("file_name", "path", "origin")


@query
def j3_route_to(spark, d):
    return R.route_to(B.messages(spark, d), B.registrations(spark, d)).select(
        "event_id", "id", "ref", "msg"
    )


def _notices(spark, d) -> DataFrame:
    return B.table(spark, d, "events").select("event_id", F.col("props").alias("msg"), "ts")


@query
def j4_broadcast_messages(spark, d):
    active = R.active_registrations(B.registrations(spark, d), B.terminated(spark, d))
    return R.broadcast_messages(_notices(spark, d), active).select(
        "event_id", "msg", "ref", "recipients"
    )


@query
def j4_inbox(spark, d):
    active = R.active_registrations(B.registrations(spark, d), B.terminated(spark, d))
    routed = R.route_to(B.messages(spark, d), active).select("event_id", "msg", "ref")
    everyone = R.broadcast_messages(_notices(spark, d), active).select("event_id", "msg", "ref")
    return R.inbox(routed.unionByName(everyone), "consumer-1")


@query
def j5_active_registrations(spark, d):
    return R.active_registrations(B.registrations(spark, d), B.terminated(spark, d)).select(
        "id", "ref"
    )


@query
def j5_active_at(spark, d):
    """Deliveries to who is registered when the message is sent."""
    return IV.route_at(B.messages(spark, d), B.timed_registrations(spark, d)).select("event_id", "ref")


@query
def j4_recipients_at(spark, d):
    notices = _notices(spark, d).select("event_id", "ts")
    return IV.recipients_at(notices, B.timed_registrations(spark, d)).select("event_id", "recipients")


@query
def j6_attempts_with_outcome(spark, d):
    attempts = B.table(spark, d, "orders").select(I.uuid_shaped("o_orderkey").alias("file_id"))
    outcomes = B.table(spark, d, "part").select(
        I.uuid_shaped("p_partkey").alias("file_id"), (F.col("p_size") > 25).alias("ok")
    )
    return P.attempts_with_outcome(attempts, outcomes)


# --- folds and aggregates -----------------------------------------------------------------------


@query
def a1_current_state(spark, d):
    return J.current_state(B.journal(spark, d)).select("persistence_id", *flat_file(), "status")


@query
def a2_build_catalog(spark, d):
    return _catalog(spark, d).select(
        "persistence_id", "seq_nr", "commit_ts", *flat_file(), "status"
    )


def _flat_snapshot(df: DataFrame) -> DataFrame:
    return df.select(
        "persistence_id", "seq_nr", F.col("file.file_name").alias("file_name"), "file_seq",
        "status", "status_seq",
    )


@query
def a3_snapshot(spark, d):
    return _flat_snapshot(J.snapshot(_stored_journal(spark, d), every=20))


@query
def a4_restore(spark, d):
    events = _stored_journal(spark, d)
    taken = J.snapshot(events, every=20)
    return J.restore(taken, J.tail_events(events, taken)).select(
        "persistence_id", *flat_file(), "status"
    )


@query
def a5_progress_latest(spark, d):
    return R.progress_latest(B.progress(spark, d))


@query
def a6_projection_progress(spark, d):
    return R.projection_progress(B.journal(spark, d))


@query
def a6_tag_progress(spark, d):
    return R.tag_progress(B.journal(spark, d))


@query
def a7_consumer_set(spark, d):
    """Every message registers its sender's consumer again; the set keeps one."""
    again = B.messages(spark, d).select("id", F.concat(F.lit("ref-"), "id").alias("ref"))
    return R.consumer_set(again)


# --- windows, order, sets -----------------------------------------------------------------------


@query
def w1_assign_seq(spark, d):
    numbered = J.assign_seq(B.journal_events(spark, d))
    return numbered.select("event_id", "persistence_id", "seq_nr")


@query
def w2_keep_latest(spark, d):
    events = B.journal(spark, d).select("persistence_id", "seq_nr", "event_type")
    return J.keep_latest(events, 3)


@query
def w3_running_state(spark, d):
    return J.running_state(_stored_journal(spark, d)).select(
        "persistence_id", "seq_nr", *flat_file(), "status"
    )


@query
def o1_in_commit_order(spark, d):
    return C.in_commit_order(_catalog(spark, d)).select(
        "commit_ts", "persistence_id", "seq_nr", "status"
    )


@query
def u1_catalog_union(spark, d):
    events = B.journal(spark, d)
    both = C.catalog_union(C.added_entries(events), C.updated_entries(events))
    return both.select("persistence_id", "seq_nr", "status")


@query
def u2_consumer_add(spark, d):
    added = B.table(spark, d, "supplier").select(
        I.uuid_shaped(F.col("s_suppkey") % 500).alias("id"),
        F.concat(F.lit("consumer-"), F.col("s_suppkey") * 50).alias("ref"),
    )
    return R.consumer_add(B.registrations(spark, d), added)


@query
def u2_consumer_remove(spark, d):
    return R.consumer_remove(B.registrations(spark, d), B.terminated(spark, d)).select("id", "ref")


# --- scalar functions ---------------------------------------------------------------------------


@query
def h1_get_ext(spark, d):
    return B.files(spark, d).select("doc_id", N.get_ext("file_name").alias("ext"))


@query
def h2_get_extension(spark, d):
    return B.files(spark, d).select("doc_id", N.get_extension("file_name").alias("ext"))


@query
def h3_generate_name(spark, d):
    named = B.journal_events(spark, d).withColumn("old", F.col("file.file_name"))
    return named.select(
        "event_id", N.generate_name("event_id", "ts", N.get_ext("old")).alias("name")
    )


@query
def h4_parse_uuid(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", I.parse_uuid(_id_texts()).alias("id"))


@query
def h5_non_zero(spark, d):
    return B.table(spark, d, "customer").select(
        "c_custkey", G.non_zero("c_acctbal").alias("balance"),
        G.non_zero(F.col("c_nationkey") - 5).alias("nation"),
    )


@query
def h6_non_empty_string(spark, d):
    padded = F.when(F.col("doc_id") % 9 == 0, F.lit(" \t\n\r ")).otherwise(
        F.concat(F.lit("\t \n"), "text", F.lit(" \r\n"))
    )
    return B.table(spark, d, "documents").select(
        "doc_id", F.md5(G.non_empty_string(padded)).alias("digest")
    )


@query
def h7_event_tag(spark, d):
    ids = B.table(spark, d, "customer").select(I.uuid_shaped("c_custkey").alias("id"))
    return ids.select(
        "id", I.java_hash("id").alias("hash"), I.event_tag("id", 4, "file").alias("tag")
    )


@query
def h8_percent(spark, d):
    return B.progress(spark, d).select("event_seq", G.percent("permil").alias("percent"))


@query
def h9_file_type(spark, d):
    slashes = F.concat("url", B.pick(("", "/", "//"), F.col("page_id") % 3))
    return B.table(spark, d, "pages").select("page_id", N.file_type(slashes).alias("file_type"))


def _numbers(spark, d) -> DataFrame:
    sign = F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.lit("-"))
    text = F.concat(
        sign, (F.col("o_orderkey") * 300007).cast("string"), F.lit("."),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"),
    )
    return B.table(spark, d, "orders").select("o_orderkey", F.try_parse_json(text).alias("v"))


@query
def h10_json_int(spark, d):
    v = F.col("v")
    return _numbers(spark, d).select(
        "o_orderkey", V.json_int(v).alias("in_range"), V.json_int(v, wrap=True).alias("wrapped")
    )


@query
def h11_content_type_default(spark, d):
    return B.journal_events(spark, d).select(
        "event_id",
        G.content_type_default(F.nullif(F.col("file.content_type"), F.lit(""))).alias("content_type"),
    )


@query
def h12_file_path(spark, d):
    return B.files(spark, d).select(
        "doc_id", N.file_path(F.lit("home"), F.lit(S.UPLOAD_DIR), "file_name").alias("path")
    )


@query
def h13_message_json(spark, d):
    return B.messages(spark, d).select("event_id", M.message_json("id", "msg").alias("body"))


@query
def h14_parse_command(spark, d):
    shape = F.col("event_id") % 5
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"id":"'), "id", F.lit('","msg":7}')))
        .when(shape == 1, F.concat(F.lit('{"id":"x'), "id", F.lit('","msg":"m"}')))
        .when(shape == 2, F.concat(F.lit('{ id: "'), "id", F.lit('" }')))
        .otherwise(M.message_json("id", "msg"))
    )
    parsed = B.messages(spark, d).select("event_id", F.try_parse_json(raw).alias("v"))
    return parsed.select("event_id", M.parse_command(F.col("v")).alias("c")).select(
        "event_id", "c.id", "c.msg", "c.error"
    )


@query
def h15_to_bytes(spark, d):
    return B.table(spark, d, "documents").select(
        "doc_id", F.md5(F.hex(G.to_bytes("text"))).alias("digest"),
        F.length(G.to_bytes("text")).cast("bigint").alias("n_bytes"),
    )


@query
def h16_parse_profile(spark, d):
    given = B.pick((*S.H264_PROFILES, "high", "None"), F.col("p_partkey") % 8)
    return B.table(spark, d, "part").select(
        "p_partkey", G.parse_profile(given).alias("profile"), G.profile_error(given).alias("wrong")
    )


# --- validation ---------------------------------------------------------------------------------


@query
def v1_extract(spark, d):
    body = F.col("body")
    got = V.extract(body, "$.audio.channels", V.INT, 0)
    fmt = V.extract(body, "$.format", V.STRING, "")
    return B.requests(spark, d).select(
        "request_key", V.kind(body, "$.audio.channels").alias("kind"),
        got.value.alias("channels"), got.error.alias("channels_error"),
        fmt.value.alias("format"), fmt.error.alias("format_error"),
    )


@query
def v2_extract_optional(spark, d):
    body = F.col("body")
    strict = V.extract_optional(body, "$.audio.quality", V.INT, -1)
    loose = V.extract_optional(body, "$.video.tag", V.STRING, "-", strict=False)
    return B.requests(spark, d).select(
        "request_key", strict.value.alias("quality"), strict.error.alias("quality_error"),
        loose.value.alias("tag"), loose.error.alias("tag_error"),
    )


@query
def v3_collect_errors(spark, d):
    body = F.col("body")
    errors = V.collect_errors(
        V.extract(body, "$.extension", V.STRING, "").error,
        V.extract(body, "$.audio", V.OBJECT, None).error,
        V.extract(body, "$.video", V.OBJECT, None).error,
    )
    return B.requests(spark, d).select("request_key", errors.alias("errors")).select(
        "request_key", joined("errors"), F.size("errors").cast("bigint").alias("n_errors")
    )


@query
def v4_validate_form(spark, d):
    spec = {
        "id": W.FormField("-"), "extension": W.FormField("tmp"), "progress_id": W.FormField("none", False),
        "video": W.FormField("{}", False),
    }
    form = W.validate_form(F.col("body"), spec)
    return B.requests(spark, d).select("request_key", form.alias("form")).select(
        "request_key", "form.has_errors",
        F.array_join(F.map_keys("form.errors"), ",").alias("wrong"),
        F.try_element_at("form.errors", F.lit("extension")).alias("extension_error"),
        W.form_get(F.col("form"), "extension", "").alias("extension"),
        W.form_get(F.col("form"), "progress_id", "").alias("progress_id"),
        W.form_get(F.col("form"), "absent", "fallback").alias("absent"),
    )


@query
def v5_read_audio(spark, d):
    read = W.read_audio(B.requests(spark, d)).filter(F.col("audio").isNotNull())
    return read.select(
        "request_key", *flat_audio(), F.array_join("audio_errors", ",").alias("fields")
    )


@query
def v6_read_video(spark, d):
    read = W.read_video(B.requests(spark, d)).filter(F.col("video").isNotNull())
    return read.select(
        "request_key", *flat_video(), F.array_join("video_errors", ",").alias("fields")
    )


@query
def v7_read_preferences(spark, d):
    judged = W.read_preferences(B.requests(spark, d))
    return judged.select(
        "request_key", "id", "extension", "format",
        (F.col("progress") == F.col("id")).alias("progress_is_id"),
        F.col("progress").isNotNull().alias("has_progress"),
        *flat_audio(), *flat_video(), "reason", joined("fields"),
    )


def _media_bodies(spark, d) -> DataFrame:
    """Media documents written from the probe results, bent into shapes their reader refuses."""
    bodies = media.media_json(_described(spark, d)).select(
        F.col("id").alias("media_id"),
        # the writer gives null for an absent video; its reader wants the field left out
        F.replace("body", F.lit('"video":null,'), F.lit("")).alias("raw"),
        (F.get_json_object("body", "$.duration").cast("bigint") / 1000 % 11).cast("int").alias("shape"),
    )
    swap = lambda a, b: F.replace(F.col("raw"), F.lit(a), F.lit(b))
    shape = F.col("shape")
    raw = (
        F.when(shape == 1, swap('"content_type":"video', '"content_type":"vid eo'))
        .when(shape == 2, swap('"file_name"', '"name"'))
        .when(shape == 3, F.concat(F.lit("<"), "raw"))
        .when(shape == 4, swap('"id":"', '"id":"x'))
        .when(shape == 5, swap('"format":"flv"', '"format":1'))
        .otherwise(F.col("raw"))
    )
    return bodies.select("media_id", raw.alias("raw"))


@query
def v8_read_media(spark, d):
    judged = W.read_media(W.parse_body(_media_bodies(spark, d)))
    return judged.select(
        "media_id", F.col("info.file_name").alias("file_name"),
        F.col("info.content_type").alias("content_type"), F.col("info.id").alias("info_id"),
        "duration", "format", *flat_audio(), *flat_video(), "reason", joined("fields"),
    )


@query
def v9_read_codec_lists(spark, d):
    key = F.col("c_custkey")
    raw = (
        F.when(key % 3 == 0, F.concat(F.lit('{"encoders":["h264"],"decoders":["'), "c_name", F.lit('","vp9"]}')))
        .when(key % 3 == 1, F.concat(F.lit('{"encoders":["'), "c_name", F.lit('"]}')))
        .otherwise(F.lit('{"encoders":[],"decoders":"vp9"}'))
    )
    parsed = B.table(spark, d, "customer").select(
        "c_custkey", W.read_codec_lists(F.try_parse_json(raw)).alias("c")
    )
    return parsed.select(
        "c_custkey", F.array_join("c.encoders", ",").alias("encoders"),
        F.array_join("c.decoders", ",").alias("decoders"), "c.error",
    )


@query
def v10_quarantine(spark, d):
    _, rejected = W.quarantine(W.read_preferences(B.requests(spark, d)))
    return rejected.select("raw", "reason", joined("fields"))


# --- conversion ---------------------------------------------------------------------------------


@query
def c1_plan_audio(spark, d):
    plan = _valid_requests(spark, d).select("request_key", P.plan_audio("audio").alias("p"))
    return plan.select("request_key", "p.*")


@query
def c2_plan_video(spark, d):
    plan = _valid_requests(spark, d).select("request_key", P.plan_video("video").alias("p"))
    return plan.select(
        "request_key", "p.bit_rate", "p.frame_rate", "p.codec", "p.tag",
        F.col("p.size.width").alias("width"), F.col("p.size.height").alias("height"), "p.profile",
    )


@query
def c3_plan_conversion(spark, d):
    return _plan(spark, d)[0].select(
        "request_key", "source_file_id", "file_id", "source_name", "new_name", "format",
        F.col("audio.codec").alias("audio_codec"), F.col("video.codec").alias("video_codec"),
        "plan_error",
    )


def stub_encoder():
    """A stand-in for the caller's codec: writes the settings, refuses one format."""

    def encode(row, output, on_permil):
        import json

        settings = {"source": row["source_name"], "format": row["format"]}
        output.write(json.dumps(settings).encode())
        on_permil(290)
        if row["format"] == "ogg":
            raise ValueError("unsupported format ogg")
        on_permil(1000)

    return encode


def _conversions(spark, d) -> DataFrame:
    out = scratch_path(spark, "converted")
    plan = _plan(spark, d)[0].withColumn("progress", F.col("file_id"))
    return jobs.run_conversions(plan, stub_encoder(), out)


@query
def c4_run_conversions(spark, d):
    return _conversions(spark, d).select("file_id", "new_name", "status", "error")


@query
def c5_probe_files(spark, d):
    def probe(row):
        content = row["content"]
        if len(content) < 200:
            raise ValueError("not a media file")
        track = {"bit_rate": len(content), "channels": 2, "decoder": "pcm", "sampling_rate": 8000}
        return {"duration": len(content) // 100, "format": "raw", "audio_track": track}

    files = B.files(spark, d).select(
        F.struct(
            "file_name", F.lit(S.UPLOAD_DIR).alias("full_path"), "content_type",
            F.lit(0).alias("status"), "file_id",
        ).alias("file"),
        "content",
    )
    found = jobs.probe_files(files, probe)
    return found.select(
        F.col("file.file_id").alias("file_id"), "duration", "format",
        F.col("audio_track.bit_rate").alias("bit_rate"),
        F.col("video_track").isNotNull().alias("has_video"), "error",
    )


@query
def c6_progress_rows(spark, d):
    return jobs.progress_rows(_conversions(spark, d))


# --- streams ------------------------------------------------------------------------------------

FILE_ROWS = 1_000_000  # about so many rows of a stream are in each file that a micro-batch takes


def stream_journal(spark, d, replay: bool = False) -> str:
    """The journal as a table on shared storage, appended twice when ``replay``."""
    path = scratch_path(spark, "stream-journal")
    events = B.journal(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    E.append_events(events, path)
    if replay:
        E.append_events(events, path)
    return path


def _published(spark, d) -> str:
    out = scratch_path(spark, "published")
    stream = PR.journal_stream(spark, stream_journal(spark, d), max_files_per_trigger=20)
    PR.publish_events(
        PR.project_by_tag(stream), out, scratch_path(spark, "offsets")
    ).awaitTermination()
    return out


@query
def t1_project_by_tag(spark, d):
    published = PR.read_published(spark, _published(spark, d))
    return R.projection_progress(published).select(
        "tag", "persistence_id", "offset",
        F.col("last_updated").cast("timestamp_ntz").alias("last_updated"),
    )


@query
def t2_state_stream(spark, d):
    out = scratch_path(spark, "state")
    stream = PR.journal_stream(spark, stream_journal(spark, d, replay=True), 20)
    SS.maintain_state(
        stream, out, scratch_path(spark, "offsets"), compact_every=2
    ).awaitTermination()
    return SS.read_state(spark, out).select("persistence_id", *flat_file(), "status")


def collect_stream(df: DataFrame, mode: str) -> str:
    """Run a stream to its end, one folder per micro-batch."""
    spark = df.sparkSession
    out = scratch_path(spark, "stream-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return out


@query
def t3_dedupe_replays(spark, d):
    stream = PR.journal_stream(spark, stream_journal(spark, d, replay=True), 20)
    once = PR.dedupe_replays(stream, None)
    out = collect_stream(once.select("persistence_id", "seq_nr", "event_type"), "append")
    return spark.read.parquet(out).drop("batch_id")


@query
def t4_progress_stream(spark, d):
    path = scratch_path(spark, "progress")
    rows = B.progress(spark, d)
    rows.repartition(4).write.parquet(path)
    # several files, one a micro-batch: a conversion goes on over many of them
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(path)
    out = scratch_path(spark, "progress-state")
    SP.maintain_progress(stream, out, scratch_path(spark, "offsets")).awaitTermination()
    return SP.read_progress(spark, out)


@query
def t5_route_stream(spark, d):
    path, out = scratch_path(spark, "messages"), scratch_path(spark, "deliveries")
    rows = B.messages(spark, d).select(
        F.when(F.col("event_id") % 10 != 0, F.col("id")).alias("id"), "msg",
        F.col("ts").cast("timestamp").alias("ts"),
    )
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    SR.route_stream(
        stream, lambda: B.registrations(spark, d), out, scratch_path(spark, "offsets")
    ).awaitTermination()
    return spark.read.parquet(out).select(
        "id", "ref", "msg", F.col("ts").cast("timestamp_ntz").alias("ts")
    )


@query
def t6_intake_stream(spark, d):
    found = intake.intake_stream(spark, _written_files(spark, d), 300)
    return spark.read.parquet(collect_stream(_listed(found), "append")).drop("batch_id")


@query
def t6_chunk_stream(spark, d):
    path = scratch_path(spark, "chunks")
    B.chunks(spark, d).write.parquet(path)
    out = collect_stream(intake.chunk_stream(spark, path, 4), "append")
    return FS.file_sizes(spark.read.parquet(out)).select(
        "file_id", "n_chunks", "length", "complete"
    )


@query
def t5_route_buffer(spark, d):
    """Messages wait for their consumers' reads: some read often, some fall behind and are failed. Six
    micro-batches, the fourth of them delivered again at the end."""
    active = R.active_registrations(B.registrations(spark, d), B.terminated(spark, d))
    # a message becomes as many rows as it has consumers: tasks are not merged by the size of messages
    messages = B.messages(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    sent = R.route_to(messages, active).withColumn("ts", F.col("ts").cast("timestamp"))
    every = 3 + F.substring("ref", 10, 10).cast("int") % 9
    message = sent.select(
        "ref", (2 * F.col("event_id")).alias("seq"), F.lit(SB.MESSAGE).alias("kind"), "id", "msg", "ts",
        F.lit(None).cast("int").alias("take"),
    )
    read = sent.filter(F.col("event_id") % every == 0).select(
        "ref", (2 * F.col("event_id") + 1).alias("seq"), F.lit(SB.READ).alias("kind"),
        *[F.lit(None).cast(k).alias(c) for c, k in (("id", "string"), ("msg", "string"), ("ts", "timestamp"), ("take", "int"))],
    )
    events = materialize(message.unionByName(read), "buffer-events")
    path, out = scratch_path(spark, "buffer-in"), scratch_path(spark, "buffer-out")
    last, rows = events.agg(F.max("seq"), F.count(F.lit(1))).first()
    files = max(1, rows // (5 * FILE_ROWS))
    # a file each, or some when they are large: the stream takes them in the order they were written, and the
    # rows of a consumer are in one file of each
    for k in (0, 1, 2, 3, 4, 3):
        part = events.filter(F.floor(F.col("seq") * 5 / F.lit((last or 0) + 1)) == k)
        part.repartition(files, "ref").write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", str(files)).parquet(path)
    SB.buffer_stream(stream, out, scratch_path(spark, "offsets")).awaitTermination()
    return SB.read_deliveries(spark, out).select(
        "ref", F.expr("seq div 2").alias("event_id"), "outcome", "id", "msg",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


@query
def t7_commit_delay(spark, d):
    """Shuffled files, a fifth of the events a micro-batch, some events twice: nothing is lost, by tag and day."""
    path, out = scratch_path(spark, "shuffled-journal"), scratch_path(spark, "delayed")
    events = B.journal(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    events = materialize(events, "journal")
    files = max(1, events.count() // (5 * FILE_ROWS))  # of a micro-batch
    events.repartition(5 * files, F.xxhash64("persistence_id", "seq_nr")).write.parquet(path)
    again = events.filter(F.col("seq_nr") % 7 == 0).repartition(files, F.xxhash64("persistence_id", "seq_nr"))
    again.write.mode("append").parquet(path)
    SV.publish_delayed(PR.journal_stream(spark, path, files), out, scratch_path(spark, "offsets")).awaitTermination()
    out_now = SV.visible_events(spark, out).unionByName(SV.late_events(spark, out))
    seen = out_now.select("tag", "event_date", F.lit(1).alias("released"), F.lit(0).alias("held"))
    held = SV.held_events(spark, out).select("tag", "event_date", F.lit(0).alias("released"), F.lit(1).alias("held"))
    return seen.unionByName(held).groupBy("tag", "event_date").agg(
        F.sum("released").alias("released"), F.sum("held").alias("held")
    )


@query
def x1_fold_stream(spark, d):
    """Every entity's events over several micro-batches in no order, and all of them twice."""
    init, step, _, schema = python_fold()
    path, out = scratch_path(spark, "shuffled-journal"), scratch_path(spark, "fold-state")
    events = B.journal(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    E.append_events(events.unionByName(events).repartition(4, F.xxhash64("seq_nr")), path)
    SS.fold_stream(
        PR.journal_stream(spark, path, 8), init, step, schema, out, scratch_path(spark, "offsets")
    ).awaitTermination()
    return SS.read_fold(spark, out, schema)


# --- caller's fold ------------------------------------------------------------------------------


def python_fold():
    """The current-state rules as the step function and merge a caller would write."""

    def step(state, event):
        kind = event["event_type"]
        nxt = dict(state)
        if kind in ("FileAdded", "ConvertedFile"):
            nxt["file_name"] = event["file"]["file_name"]
        if kind == "ConvertedFile":
            nxt["status"] = "inprogress"
        elif kind == "UpdatedStatus":
            nxt["status"] = event["status"]
        nxt["n_events"] = state["n_events"] + 1
        return nxt

    def merge(earlier, later):
        return {
            "file_name": later["file_name"] or earlier["file_name"],
            "status": later["status"] or earlier["status"],
            "n_events": earlier["n_events"] + later["n_events"],
        }

    init = {"file_name": None, "status": None, "n_events": 0}
    return init, step, merge, "file_name string, status string, n_events bigint"


@query
def x1_fold_events(spark, d):
    init, step, merge, schema = python_fold()
    events = B.journal(spark, d).select(
        "persistence_id", "seq_nr", "event_type", "file", "status"
    )
    return J.fold_events(events, init, step, schema, merge)
