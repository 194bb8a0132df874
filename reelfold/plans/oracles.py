"""SQL for DuckDB that computes each registered query from the same tables, written independently."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

UP, CV = "Desktop/file/uploaded", "Desktop/file/converted"
PROFILES = "'BASELINE', 'MAIN', 'HIGH', 'HIGH10', 'HIGH422', 'HIGH444'"
TOKEN = r"[!#$%&''*+.^_`|~0-9A-Za-z-]+"
CONTENT_TYPE = rf'{TOKEN}/{TOKEN}([ \t]*;[ \t]*{TOKEN}=({TOKEN}|"([^"\\]|\\.)*"))*[ \t]*'


def uid(expr: str) -> str:
    h = f"md5(CAST({expr} AS VARCHAR))"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||"
        f"substr({h},17,4)||'-'||substr({h},21,12))"
    )


def java_hash(expr: str) -> str:
    u = (
        f"list_reduce(list_transform(string_split({expr}, ''), lambda c: CAST(ascii(c) AS BIGINT)),"
        f" lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT))"
    )
    return f"(CASE WHEN {u} >= 2147483648 THEN {u} - 4294967296 ELSE {u} END)"


def ext(name: str) -> str:
    parts = f"string_split(regexp_replace({name}, '\\.+$', ''), '.')"
    return f"(CASE WHEN len({parts}) <= 1 THEN 'tmp' ELSE {parts}[-1] END)"


def extension(name: str) -> str:
    bare = f"regexp_replace({name}, '\\.+$', '')"
    return f"(CASE WHEN {bare} = '' AND {name} <> '' THEN NULL ELSE string_split({bare}, '.')[-1] END)"


def pick(values: list[str], index: str) -> str:
    return "(CASE " + " ".join(
        f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values)
    ) + " END)"


EXTS = ["mp4", "mp3", "flv", "avi", "webm"]
TYPES = ["video/mp4", "audio/mpeg", "video/x-flv", "video/x-msvideo", "video/webm"]
ENDINGS = [".mp4", ".tar.gz", "", ".", "..", ".b.", ".MP3"]

# --- input tables as CTEs -----------------------------------------------------------------------

EVENTS = f"""
je AS (
  SELECT event_id, ts, {uid('user_id')} AS persistence_id,
    CASE event_type WHEN 'signup' THEN 'FileAdded' WHEN 'click' THEN 'ConvertedFile'
      WHEN 'purchase' THEN 'UpdatedStatus' WHEN 'error' THEN 'UpdatedStatus'
      ELSE 'FileRemoved' END AS event_type,
    'clip-' || event_id || '.' || {pick(EXTS, 'event_id % 5')} AS file_name,
    CASE WHEN event_type = 'signup' THEN '{UP}' ELSE '{CV}' END AS full_path,
    CASE WHEN event_type = 'signup' THEN {pick(TYPES, 'event_id % 5')} ELSE '' END AS content_type,
    CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE 4 END AS INTEGER) AS file_status,
    {uid('user_id')} AS file_id,
    CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' END AS status,
    CASE WHEN event_type = 'click' THEN {uid("'src' || user_id")} END AS source_file_id
  FROM events)"""
TAGS = f"""
tags AS (
  SELECT id, 'file-' || abs({java_hash('id')} % 4) AS tag
  FROM (SELECT DISTINCT persistence_id AS id FROM je))"""
JOURNAL = f"""{EVENTS}, {TAGS},
j AS (
  SELECT je.*, CAST(ts AS DATE) AS event_date, tag,
    row_number() OVER (PARTITION BY persistence_id ORDER BY ts, event_id) AS seq_nr
  FROM je JOIN tags ON id = persistence_id)"""
FILE = "file_name, full_path, content_type, file_status, file_id"
STATE = """
fw AS (
  SELECT * FROM j WHERE event_type IN ('FileAdded', 'ConvertedFile')
  QUALIFY row_number() OVER (PARTITION BY persistence_id ORDER BY seq_nr DESC) = 1),
sw AS (
  SELECT persistence_id, CASE event_type WHEN 'ConvertedFile' THEN 'inprogress' ELSE status END AS s
  FROM j WHERE event_type IN ('ConvertedFile', 'UpdatedStatus')
  QUALIFY row_number() OVER (PARTITION BY persistence_id ORDER BY seq_nr DESC) = 1),
st AS (
  SELECT e.persistence_id, fw.file_name, fw.full_path, fw.content_type, fw.file_status, fw.file_id,
    coalesce(s, 'none') AS status
  FROM (SELECT DISTINCT persistence_id FROM j) e
  LEFT JOIN fw USING (persistence_id) LEFT JOIN sw USING (persistence_id))"""
CATALOG = f"""
c AS (
  SELECT persistence_id, seq_nr, ts AS commit_ts, {FILE},
    CASE event_type WHEN 'FileAdded' THEN 'none' ELSE status END AS status
  FROM j WHERE event_type IN ('FileAdded', 'UpdatedStatus'))"""
FILES = f"""
f AS (
  SELECT doc_id, {uid('doc_id')} AS file_id, text,
    CASE WHEN doc_id % 11 = 0 THEN '.'
      ELSE source || '-' || doc_id || {pick(ENDINGS, 'doc_id % 7')} END AS file_name,
    {pick(TYPES, 'doc_id % 5')} AS content_type,
    octet_length(encode(text)) AS length
  FROM documents)"""
CHUNKS = f"""
ch AS (
  SELECT {uid('conv_id')} AS file_id, text, turn,
    CAST(turn + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS chunk_no
  FROM conversations)"""
REG = f"""
reg AS (SELECT {uid('c_custkey % 500')} AS id, 'consumer-' || c_custkey AS ref FROM customer),
gone AS (SELECT 'consumer-' || (s_suppkey * 3) AS ref FROM supplier),
act AS (SELECT DISTINCT id, ref FROM reg WHERE ref NOT IN (SELECT ref FROM gone))"""
MSG = f"msgs AS (SELECT event_id, {uid('user_id')} AS id, props AS msg, ts FROM events)"
PROGRESS = f"""
pr AS (
  SELECT {uid('user_id')} AS progress_id, event_id AS event_seq,
    CAST(event_id % 1001 AS INTEGER) AS permil,
    (CAST(event_id % 1001 AS DOUBLE) / CAST(1000.0 AS DOUBLE)) * CAST(100 AS DOUBLE) AS percent
  FROM events)"""
CODECS = f"""
co AS (
  SELECT {pick(['video', 'audio', 'format'], 'n_nationkey % 3')} AS kind, direction,
    lower(n_name) AS name
  FROM nation, (VALUES ('encoder'), ('decoder')) s(direction)
  WHERE direction = 'decoder' OR n_nationkey % 2 = 0)"""
PROBED = f"""
pb AS (
  SELECT {uid('o_orderkey')} AS id, o_orderkey AS k,
    'order-' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN ''
      ELSE '.' || {pick(EXTS, 'o_orderkey % 5')} END AS file_name,
    {pick(TYPES, 'o_orderkey % 5')} AS content_type,
    o_orderkey * 1000 AS duration, 'flv' AS format,
    o_orderkey % 3 <> 0 AS has_a, o_orderkey % 5 <> 0 AS has_v,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey * 100 AS INTEGER) END AS a_bit_rate,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 + 1 AS INTEGER) END AS a_channels,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'aac (LC)' END AS a_decoder,
    CASE WHEN o_orderkey % 3 <> 0 THEN 44100 END AS a_sampling_rate,
    CASE WHEN o_orderkey % 3 <> 0 THEN 0 END AS a_quality,
    CASE WHEN o_orderkey % 3 <> 0 THEN 0 END AS a_volume,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 10 AS INTEGER) END AS v_bit_rate,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 60 + 0.5 AS DOUBLE) END AS v_frame_rate,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'h264 (High)' END AS v_decoder,
    CASE WHEN o_orderkey % 5 <> 0 THEN '' END AS v_tag,
    CAST(NULL AS VARCHAR) AS v_profile,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 + 640 AS INTEGER) END AS v_width,
    CASE WHEN o_orderkey % 5 <> 0 THEN 360 END AS v_height
  FROM orders)"""
A_COLS = "a_bit_rate, a_channels, a_decoder, a_sampling_rate, a_quality, a_volume"
V_COLS = "v_bit_rate, v_frame_rate, v_decoder, v_tag, v_profile, v_width, v_height"

_HEAD = """'{"id":"' || fid || '","extension":"mp4","format":"' || fmt || '"'"""
_AUDIO = (
    """'"audio":{"bit_rate":' || rate || ',"channels":2,"decoder":" aac ","sampling_rate":44100,'"""
    """ || '"quality":0,"volume":' || k % 3 || '}'"""
)
_VIDEO = (
    """'"video":{"bit_rate":' || rate || ',"frame_rate":25.5,"decoder":"h264","tag":"",'"""
    """ || '"profile":"HIGH","size":{"height":360,"width":636}}'"""
)
_RAWS = [
    f"{_HEAD} || ',' || {_AUDIO} || ',' || {_VIDEO} || '}}'",
    f"{_HEAD} || ',' || {_AUDIO} || '}}'",
    f"{_HEAD} || ',' || {_VIDEO} || '}}'",
    f"{_HEAD} || '}}'",
    f"""{_HEAD} || ',"audio":{{}}}}'""",
    f"""{_HEAD} || ',"audio":{{"bit_rate":' || rate || ',"channels":"2","decoder":"aac","sampling_rate":44100}}}}'""",
    f"""{_HEAD} || ',"audio":{{"bit_rate":' || rate || ',"channels":2,"decoder":"aac","sampling_rate":44100,"quality":null}}}}'""",
    f"""{_HEAD} || ',"video":{{"bit_rate":' || rate || ',"frame_rate":0.5,"decoder":"h264","tag":5,"profile":5,"size":{{"height":360,"width":636}}}}}}'""",
    f"""{_HEAD} || ',"video":{{"bit_rate":' || rate || ',"frame_rate":25,"decoder":"h264","size":{{"height":"3"}}}}}}'""",
    "'convert ' || fid || ' please'",
    f"""'{{"id":"part-' || k || '","extension":"mp4","format":"mp4",' || {_AUDIO} || '}}'""",
    f"""'{{"id":"' || fid || '","format":"mp4",' || {_AUDIO} || '}}'""",
    f"""{_HEAD} || ',' || {_AUDIO} || ',"video":""}}'""",
    f"""{_HEAD} || ',"audio":{{"bit_rate":4294967297,"channels":2,"decoder":"aac","sampling_rate":44100}}}}'""",
    f"""{_HEAD} || ',"audio":{{"bit_rate":' || rate || ',"channels":true,"decoder":"aac","sampling_rate":44100}},"video":{{"bit_rate":' || rate || ',"decoder":"h264","size":[]}}}}'""",
    """'{"id":"1-1-1-1-' || k || '","extension":"flv","format":"' || fmt || '","progress_id":"' || fid || '","audio":{"bit_rate":' || rate || ',"channels":0,"decoder":"mp3","sampling_rate":44100.9},"video":{"bit_rate":-1,"frame_rate":30,"decoder":"","tag":"x","profile":"Some(HIGH)","size":{"height":1,"width":2}}}'""",
]
REQUESTS = (
    f"""
rb AS (
  SELECT p_partkey AS k, CAST(p_size * 1000 AS VARCHAR) AS rate, {uid('p_partkey % 300')} AS fid,
    CASE WHEN p_partkey % 3 = 0 THEN 'ogg' ELSE 'mp4' END AS fmt
  FROM part),
rr AS (SELECT k AS request_key, CASE k % 16 """
    + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(_RAWS))
    + """ END AS raw FROM rb),
rq AS (SELECT request_key, raw, TRY_CAST(raw AS JSON) AS b FROM rr)"""
)


def jt(path: str) -> str:
    return f"json_type(b, '{path}')"


def is_num(path: str) -> str:
    return f"coalesce({jt(path)} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT'), false)"


def is_str(path: str) -> str:
    return f"coalesce({jt(path)} = 'VARCHAR', false)"


def is_obj(path: str) -> str:
    return f"coalesce({jt(path)} = 'OBJECT', false)"


def num(path: str) -> str:
    return f"trunc(CAST(json_extract_string(b, '{path}') AS DECIMAL(38, 6)))"


def int_ok(path: str) -> str:
    return f"({is_num(path)} AND {num(path)} BETWEEN -2147483648 AND 2147483647)"


def int_value(path: str, default: str = "0") -> str:
    # the guards nest, as the two sides of AND may both be evaluated
    return (
        f"(CASE WHEN {is_num(path)} THEN CASE WHEN {num(path)} BETWEEN -2147483648 AND 2147483647 "
        f"THEN CAST({num(path)} AS INTEGER) ELSE {default} END ELSE {default} END)"
    )


def int_bad(path: str) -> str:
    return (
        f"(CASE WHEN {is_num(path)} THEN {num(path)} NOT BETWEEN -2147483648 AND 2147483647 "
        f"ELSE true END)"
    )


def str_value(path: str, default: str) -> str:
    return f"(CASE WHEN {is_str(path)} THEN json_extract_string(b, '{path}') ELSE {default} END)"


def errs(*pairs: tuple[str, str]) -> str:
    """Comma-joined names whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {n} END" for c, n in pairs) + ")"


def audio_errs(p: str = "$.audio") -> str:
    present = lambda f: f"{jt(p + '.' + f)} IS NOT NULL"
    return errs(
        (int_bad(f"{p}.channels"), "'channels'"),
        (int_bad(f"{p}.sampling_rate"), "'sampling_rate'"),
        (f"{present('quality')} AND {int_bad(p + '.quality')}", "'quality'"),
        (f"{present('volume')} AND {int_bad(p + '.volume')}", "'volume'"),
        (int_bad(f"{p}.bit_rate"), "'bit_rate'"),
        (f"NOT {is_str(p + '.decoder')}", "'decoder'"),
    )


def video_errs(p: str = "$.video") -> str:
    size = is_obj(f"{p}.size")

    def side(name: str) -> tuple[str, str]:
        path = f"{p}.size.{name}"
        label = f"CASE WHEN {jt(path)} IS NULL THEN '{name}' ELSE 'size.{name}' END"
        return f"{size} AND {int_bad(path)}", label

    return errs(
        (f"NOT {is_num(p + '.frame_rate')}", "'frame_rate'"),
        (f"NOT {size}", "'size'"),
        side("height"), side("width"),
        (int_bad(f"{p}.bit_rate"), "'bit_rate'"),
        (f"NOT {is_str(p + '.decoder')}", "'decoder'"),
    )


AUDIO_VALUES = f"""{int_value('$.audio.bit_rate')} AS a_bit_rate,
    {int_value('$.audio.channels')} AS a_channels,
    {str_value('$.audio.decoder', "''")} AS a_decoder,
    {int_value('$.audio.sampling_rate')} AS a_sampling_rate,
    {int_value('$.audio.quality')} AS a_quality, {int_value('$.audio.volume')} AS a_volume"""
VIDEO_VALUES = f"""{int_value('$.video.bit_rate')} AS v_bit_rate,
    CASE WHEN {is_num('$.video.frame_rate')}
      THEN CAST(json_extract_string(b, '$.video.frame_rate') AS DOUBLE) ELSE 0.0 END AS v_frame_rate,
    {str_value('$.video.decoder', "''")} AS v_decoder, {str_value('$.video.tag', "''")} AS v_tag,
    {str_value('$.video.profile', 'NULL')} AS v_profile,
    {int_value('$.video.size.width')} AS v_width, {int_value('$.video.size.height')} AS v_height"""


def loose_uuid(text: str) -> str:
    groups = "||'-'||".join(
        f"lower(right(repeat('0', 36) || string_split({text}, '-')[{i + 1}], {n}))"
        for i, n in enumerate((8, 4, 4, 4, 12))
    )
    return (
        f"(CASE WHEN regexp_full_match({text}, '[0-9a-fA-F]+(-[0-9a-fA-F]+){{4}}') "
        f"AND length({text}) <= 36 THEN {groups} END)"
    )


def masked(cols: str, when: str) -> str:
    return ", ".join(f"CASE WHEN {when} THEN {c.strip()} END AS {c.strip()}" for c in cols.split(","))


JUDGED = f"""{REQUESTS},
vals AS (
  SELECT *, json_extract_string(b, '$.id') AS id_text,
    json_extract_string(b, '$.progress_id') AS progress_text,
    {is_obj('$.audio')} AS has_a, {is_obj('$.video')} AS has_v,
    {str_value('$.extension', 'NULL')} AS x_ext, {str_value('$.format', 'NULL')} AS x_fmt,
    {AUDIO_VALUES}, {VIDEO_VALUES}, {audio_errs()} AS a_errs, {video_errs()} AS v_errs
  FROM rq),
shaped AS (
  SELECT *, coalesce({is_str('$.id')} AND {loose_uuid('id_text')} IS NOT NULL
      AND x_ext IS NOT NULL AND x_fmt IS NOT NULL
      AND (has_a OR {jt('$.audio')} IS NULL) AND (has_v OR {jt('$.video')} IS NULL)
      AND (has_a OR has_v), false) AS ok,
    concat_ws(',', CASE WHEN has_a THEN nullif(a_errs, '') END,
      CASE WHEN has_v THEN nullif(v_errs, '') END) AS all_errs
  FROM vals),
jd AS (
  SELECT request_key, raw,
    CASE WHEN NOT ok THEN 'Malformed request content'
      WHEN all_errs <> '' THEN 'Invalid fields.' END AS reason,
    CASE WHEN ok THEN all_errs ELSE '' END AS fields,
    {loose_uuid('id_text')} AS u_id, x_ext, x_fmt, {loose_uuid('progress_text')} AS u_progress,
    has_a, has_v, {A_COLS}, {V_COLS}
  FROM shaped),
ok AS (
  SELECT request_key, u_id AS id, x_ext AS extension, x_fmt AS format,
    {masked(A_COLS, 'has_a')}, {masked(V_COLS, 'has_v')}, has_a, has_v
  FROM jd WHERE reason IS NULL)"""
PLAN = f"""{JUDGED}, {JOURNAL}, {STATE},
pl AS (
  SELECT ok.*, {uid("'convert:' || request_key")} AS new_id, st.file_name AS source_name,
    st.file_id IS NOT NULL AS found, st.status AS source_status
  FROM ok LEFT JOIN (SELECT * FROM st WHERE file_id IS NOT NULL) st ON st.persistence_id = ok.id),
plan AS (
  SELECT *, {uid("'name:' || new_id")} || '-' || (1600000000 + request_key) || '.' || extension
    AS new_name,
    CASE WHEN v_profile NOT IN ({PROFILES}) THEN 'unknown profile: ' || v_profile END AS plan_error
  FROM pl WHERE found)"""
RESOLVED = f"""
names AS (
  SELECT CASE WHEN doc_id % 13 <> 0 THEN {uid('doc_id')} END AS file_id, 'doc-' || doc_id AS file_name,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE {pick(TYPES, 'doc_id % 5')} END AS content_type
  FROM documents),
res AS (
  SELECT n.*, CASE WHEN c.k IS NOT NULL THEN 'home/{CV}/' || n.file_name
      WHEN u.k IS NOT NULL THEN 'home/{UP}/' || n.file_name END AS path,
    CASE WHEN c.k IS NOT NULL THEN 'converted' WHEN u.k IS NOT NULL THEN 'uploaded' END AS origin
  FROM names n
  LEFT JOIN (SELECT DISTINCT 'doc-' || doc_id AS k FROM labels) c ON c.k = n.file_name
  LEFT JOIN (SELECT DISTINCT 'doc-' || conv_id AS k FROM conversations) u ON u.k = n.file_name)"""

# --- sources and sinks --------------------------------------------------------------------------

ORACLES["s1_scan_files"] = f"""WITH {FILES}
SELECT file_id, CASE WHEN doc_id % 10 = 3 THEN 0 ELSE length END AS length FROM f"""
ORACLES["s2_limit_size"] = f"""WITH {FILES}
SELECT file_id, length, CASE WHEN length <= 10000 THEN 'accepted' ELSE 'rejected' END AS verdict FROM f"""
ORACLES["s3_reassemble_chunks"] = f"""WITH {CHUNKS}
SELECT file_id, md5(string_agg(text, '' ORDER BY chunk_no)) AS digest,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS length, count(*) AS n_chunks,
  count(DISTINCT chunk_no) = max(chunk_no) + 1 AS complete
FROM ch GROUP BY file_id"""
ORACLES["s3_oversize_chunks"] = f"""WITH {CHUNKS}
SELECT file_id, chunk_no, md5(text) AS digest FROM ch
QUALIFY sum(octet_length(encode(text))) OVER (PARTITION BY file_id) > 2000"""


def pieces(n: int, source: str = "f") -> str:
    return f"""SELECT file_id, CAST(i AS INTEGER) AS chunk_no,
  md5(substr(hex(encode(text)), i * {2 * n} + 1, {2 * n})) AS digest
FROM {source}, unnest(range(CAST(ceil(length / {n}.0) AS BIGINT))) u(i)"""


ORACLES["s4_chunk_files"] = f"WITH {FILES} {pieces(10000)}"
ORACLES["s4_read_chunks"] = f"WITH {FILES} {pieces(4000)}"
ORACLES["s5_append_events"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, event_date, tag, event_type, file_name, status, source_file_id FROM j"""
ORACLES["s6_scan_events"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, ts, event_type, tag FROM j
WHERE tag = 'file-2' AND seq_nr > 10 AND event_date >= DATE '2024-01-05'"""
ORACLES["s7_scan_requests"] = f"""WITH {REQUESTS}
SELECT raw, b IS NOT NULL AS is_json, json_extract_string(b, '$.id') AS id FROM rq"""
ORACLES["s8_codec_catalog"] = f"WITH {CODECS} SELECT kind, direction, name FROM co"
ORACLES["s9_publish_events"] = f"""WITH {JOURNAL}
SELECT tag, persistence_id, seq_nr, event_type, file_name FROM j"""
ORACLES["s10_to_json_lines"] = f"""WITH {JOURNAL}, {CATALOG}
SELECT '{{"file_id":"' || file_id || '","file_name":"' || file_name || '","file_type":"'
  || string_split(full_path, '/')[-1] || '","contentType":"' || content_type
  || '","file_status":"' || status || '"}}' AS value FROM c"""
ORACLES["s11_write_files"] = f"WITH {FILES} SELECT file_id, length, md5(text) AS digest FROM f"

# --- projections --------------------------------------------------------------------------------

ORACLES["p1_journal_json"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, file_name, full_path AS file_path, content_type AS "contentType",
  file_status, file_id FROM j"""
ORACLES["p2_catalog_json"] = f"""WITH {JOURNAL}, {CATALOG}
SELECT file_id, file_name, string_split(full_path, '/')[-1] AS file_type,
  content_type AS "contentType", status AS file_status FROM c"""
ORACLES["p3_lookup_result"] = f"""WITH {JOURNAL}, {STATE},
ids AS (SELECT {uid('c_custkey')} AS id FROM customer)
SELECT id, file_id IS NOT NULL AS found,
  CASE WHEN file_id IS NULL THEN '{{"id":"' || id || '","reason":"file not found."}}'
  ELSE '{{"journal":{{"file_name":"' || file_name || '","file_path":"' || full_path
    || '","contentType":"' || content_type || '","file_status":' || file_status
    || ',"file_id":"' || file_id || '"}},"status":"' || status || '"}}' END AS body
FROM ids LEFT JOIN st ON persistence_id = id"""
ORACLES["p4_describe"] = f"WITH {PROBED} SELECT id, duration, format, {A_COLS}, {V_COLS} FROM pb"
ORACLES["p5_to_preferences"] = f"""WITH {PROBED}
SELECT id, {extension('file_name')} AS extension, format, file_name, {A_COLS}, {V_COLS} FROM pb"""
_V_JSON = """'"video":{"bit_rate":' || v_bit_rate || ',"frame_rate":' || v_frame_rate
    || ',"decoder":"' || v_decoder || '"'"""
_SIZE_JSON = """',"size":{"width":' || v_width || ',"height":' || v_height || '}}'"""
_A_JSON = """'"audio":{"bit_rate":' || a_bit_rate || ',"channels":' || a_channels
    || ',"decoder":"' || a_decoder || '"'"""
ORACLES["p6_preferences_json"] = f"""WITH {PROBED}
SELECT id, CASE WHEN NOT has_a AND NOT has_v THEN '{{"id":"' || id || '","reason":"Non-media file."}}'
  ELSE '{{"id":"' || id || '",'
  || CASE WHEN has_v THEN {_V_JSON} || ',"tag":"' || v_tag || '"' || {_SIZE_JSON} || ',' ELSE '' END
  || CASE WHEN has_a THEN {_A_JSON} || ',"volume":' || a_volume || ',"quality":' || a_quality
    || ',"sampling_rate":' || a_sampling_rate || '}},' ELSE '' END
  || '"format":"' || format || '","extension":"' || {extension('file_name')} || '"}}' END AS body
FROM pb"""
_MEDIA_BODY = f"""'{{"info":{{"file_name":"' || file_name || '","content_type":"' || content_type
  || '","status":0,"id":"' || id || '"}},"duration":' || duration || ','
  || CASE WHEN has_v THEN {_V_JSON} || {_SIZE_JSON} ELSE '"video":null' END || ','
  || CASE WHEN has_a THEN {_A_JSON} || ',"sampling_rate":' || a_sampling_rate || '}}'
    ELSE '"audio":null' END || ',"format":"' || format || '"}}'"""
ORACLES["p7_media_json"] = f"WITH {PROBED} SELECT id, {_MEDIA_BODY} AS body FROM pb"
ORACLES["p8_media_info_json"] = f"""WITH {PROBED}
SELECT file_name, content_type, CAST(0 AS INTEGER) AS status, id FROM pb"""
ORACLES["p9_codec_json"] = f"""WITH {CODECS},
names AS (
  SELECT kind, direction, '["' || string_agg(DISTINCT name, '","' ORDER BY name) || '"]' AS l
  FROM co GROUP BY kind, direction),
sides AS (
  SELECT e.kind, '{{"encoders":' || e.l || ',"decoders":' || d.l || '}}' AS s
  FROM names e JOIN names d ON d.kind = e.kind AND d.direction = 'decoder'
  WHERE e.direction = 'encoder')
SELECT '{{"video":' || CASE WHEN v THEN (SELECT s FROM sides WHERE kind = 'video') ELSE '""' END
  || ',"audio":' || (SELECT s FROM sides WHERE kind = 'audio')
  || ',"format":' || (SELECT s FROM sides WHERE kind = 'format')
  || ',"profile":["baseline","main","high","high10","high422","high444"]}}' AS body
FROM (VALUES (true), (false)) t(v)"""
ORACLES["p10_with_file_name"] = f"""WITH {PLAN}
SELECT request_key, id, source_name AS file_name FROM plan"""
ORACLES["p11_converted_journal"] = f"""WITH {PLAN}
SELECT new_id AS persistence_id, 'ConvertedFile' AS event_type, new_name AS file_name,
  '{CV}' AS full_path, '' AS content_type, CAST(4 AS INTEGER) AS file_status, new_id AS file_id,
  id AS source_file_id FROM plan"""
ORACLES["p12_added_journal"] = f"""WITH {FILES}
SELECT file_id AS persistence_id, 'FileAdded' AS event_type, file_name, '{UP}' AS full_path,
  content_type, CAST(0 AS INTEGER) AS file_status, file_id FROM f"""
ORACLES["p13_progress_reply"] = f"""WITH {PLAN}
SELECT new_name AS file_name, new_id AS id, 'inprogress' AS status FROM plan"""
ORACLES["p14_event_log_line"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, 'EventProcessor(' || tag || ') consumed ' || event_type || ' from '
  || persistence_id || ' with seqNr ' || seq_nr AS line FROM j"""

# --- filters ------------------------------------------------------------------------------------

ORACLES["f1_search"] = f"""WITH {JOURNAL}, {CATALOG}
SELECT seq_nr, {FILE}, status FROM c
WHERE contains(file_id, 'mp') OR contains(file_name, 'mp') OR contains(content_type, 'mp')
  OR contains(full_path, 'mp') OR contains(status, 'mp')"""
ORACLES["f1_search_indexed"] = f"""WITH {JOURNAL}, {CATALOG}
SELECT key, seq_nr, {FILE}, status FROM c, (VALUES ('4'), ('mp'), ('ogg'), ('clip-12'), ('%'), ('nowhere')) k(key)
WHERE contains(file_id, key) OR contains(file_name, key) OR contains(content_type, key)
  OR contains(full_path, key) OR contains(status, key)"""
ORACLES["f1_search_literal"] = f"""
SELECT key, url AS file_name, 'pages' AS full_path, 'text/html' AS content_type,
  CAST(0 AS INTEGER) AS file_status, {uid('page_id')} AS file_id
FROM pages, (VALUES ('page=2'), ('%')) k(key) WHERE strpos(url, key) > 0"""
ORACLES["f2_list_all"] = f"""WITH {JOURNAL}, {CATALOG}
SELECT seq_nr, {FILE}, status, commit_ts FROM c"""
ORACLES["f3_lookup"] = f"""WITH {JOURNAL}, {STATE}
SELECT persistence_id, {FILE}, status FROM st
WHERE persistence_id = {uid('1')} AND file_id IS NOT NULL"""
ORACLES["f4_is_media"] = f"WITH {PROBED} SELECT id, has_a OR has_v AS media FROM pb"
_GIVEN = f"""
g AS (
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {pick(
      ['video/', '/mp4', '', 'video/mp4; q=1', 'text/html; charset="utf-8"', 'a b/c'],
      'p_partkey % 6')}
    ELSE lower(p_type) || '/' || replace(p_name, ' ', '-') END AS given
  FROM part)"""
ORACLES["f5_valid_content_type"] = f"""WITH {_GIVEN}
SELECT p_partkey, regexp_full_match(given, '{CONTENT_TYPE}') AS valid,
  CASE WHEN NOT regexp_full_match(given, '{CONTENT_TYPE}')
    THEN 'Content-Type: ' || given || ' is invalid' END AS error FROM g"""
ORACLES["f6_playable"] = f"""WITH {RESOLVED}
SELECT file_name, file_id IS NOT NULL AND path IS NOT NULL AND content_type <> '' AS playable,
  CASE WHEN file_id IS NULL OR path IS NULL THEN 'file not found.'
    WHEN content_type = '' THEN 'Content-Type:  is invalid' END AS reason FROM res"""
_MD = "md5(CAST(c_custkey AS VARCHAR))"
ID_TEXTS = f"""
ids AS (
  SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN upper({uid('c_custkey')})
    WHEN 1 THEN '1-1-1-1-' || c_custkey WHEN 2 THEN substr({_MD}, 1, 9) || '-1-2-3-4'
    WHEN 3 THEN {_MD} WHEN 4 THEN '1-12345-1-1-' || substr({_MD}, 1, 6)
    WHEN 5 THEN {uid('c_custkey')} || '0' WHEN 6 THEN '1-1-1-1-' || c_custkey || ' '
    ELSE {uid('c_custkey')} END AS t
  FROM customer)"""
ORACLES["f7_route_id_valid"] = f"""WITH {ID_TEXTS}
SELECT c_custkey, regexp_full_match(t, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')
  AS valid FROM ids"""
ORACLES["f8_event_is_handled"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, event_type, event_type <> 'FileRemoved' AS handled FROM j"""

# --- joins --------------------------------------------------------------------------------------

ORACLES["j1_requests_with_state"] = f"""WITH {PLAN}
SELECT request_key, id, CASE WHEN found THEN 'found' ELSE 'not_found' END AS outcome, source_name,
  source_status, CASE WHEN NOT found THEN '{{"id":"' || id || '","reason":"file not found."}}' END
  AS reply FROM pl"""
ORACLES["j2_resolve_path"] = f"WITH {RESOLVED} SELECT file_name, path, origin FROM res"
ORACLES["j3_route_to"] = f"""WITH {REG}, {MSG}
SELECT event_id, id, ref, msg FROM msgs JOIN (SELECT DISTINCT id, ref FROM reg) USING (id)"""
ORACLES["j4_broadcast_messages"] = f"""WITH {REG}
SELECT event_id, props AS msg, '*' AS ref, (SELECT count(*) FROM act) AS recipients FROM events"""
ORACLES["j4_inbox"] = f"""WITH {REG}, {MSG}
SELECT event_id, msg, ref FROM msgs JOIN act USING (id) WHERE ref = 'consumer-1'
UNION ALL SELECT event_id, msg, ref FROM msgs CROSS JOIN act WHERE ref = 'consumer-1'"""
ORACLES["j5_active_registrations"] = f"WITH {REG} SELECT id, ref FROM act"
TIMED = f"""
timed AS (
  SELECT {uid('c_custkey % 20')} AS id, 'consumer-' || (c_custkey % 90) AS ref,
    TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 7919 % 43200) AS a,
    CASE WHEN c_custkey % 7 > 0 THEN TIMESTAMP '2024-01-01'
      + to_minutes(c_custkey * 7919 % 43200 + c_custkey * 104729 % 20160 - 60) END AS b
  FROM customer)"""
ORACLES["j5_active_at"] = f"""WITH {MSG}, {TIMED}
SELECT DISTINCT event_id, ref FROM msgs JOIN timed ON msgs.id = timed.id AND a <= ts AND (b IS NULL OR ts < b)"""
ORACLES["j4_recipients_at"] = f"""WITH {TIMED}
SELECT event_id, (SELECT count(DISTINCT id || ref) FROM timed
  WHERE a <= events.ts AND (b IS NULL OR events.ts < b)) AS recipients FROM events"""
ORACLES["j6_attempts_with_outcome"] = f"""
SELECT {uid('o_orderkey')} AS file_id, CASE WHEN p_partkey IS NULL THEN 'inprogress'
  WHEN p_size > 25 THEN 'complete' ELSE 'failed' END AS status
FROM orders LEFT JOIN part ON p_partkey = o_orderkey"""

# --- folds and aggregates -----------------------------------------------------------------------

ORACLES["a1_current_state"] = f"""WITH {JOURNAL}, {STATE}
SELECT persistence_id, {FILE}, status FROM st"""
ORACLES["a2_build_catalog"] = f"""WITH {JOURNAL}, {CATALOG}
SELECT persistence_id, seq_nr, commit_ts, {FILE}, status FROM c"""
RUNNING = """
run AS (
  SELECT persistence_id, seq_nr, event_type,
    max(CASE WHEN event_type IN ('FileAdded', 'ConvertedFile') THEN seq_nr END)
      OVER (PARTITION BY persistence_id ORDER BY seq_nr) AS file_seq,
    max(CASE WHEN event_type IN ('ConvertedFile', 'UpdatedStatus') THEN seq_nr END)
      OVER (PARTITION BY persistence_id ORDER BY seq_nr) AS status_seq,
    max(seq_nr) OVER (PARTITION BY persistence_id) AS last_seq
  FROM j),
rs AS (
  SELECT r.persistence_id, r.seq_nr, r.event_type, r.last_seq, f.file_name, f.full_path,
    f.content_type, f.file_status, f.file_id, r.file_seq, r.status_seq,
    CASE WHEN s.event_type = 'ConvertedFile' THEN 'inprogress' ELSE coalesce(s.status, 'none') END
      AS status
  FROM run r
  LEFT JOIN j f ON f.persistence_id = r.persistence_id AND f.seq_nr = r.file_seq
  LEFT JOIN j s ON s.persistence_id = r.persistence_id AND s.seq_nr = r.status_seq)"""
ORACLES["a3_snapshot"] = f"""WITH {JOURNAL}, {RUNNING}
SELECT persistence_id, seq_nr, file_name, file_seq, status, status_seq FROM rs
WHERE seq_nr % 20 = 0 AND seq_nr > (last_seq // 20) * 20 - 60"""
ORACLES["a4_restore"] = ORACLES["a1_current_state"]
ORACLES["a5_progress_latest"] = f"""WITH {PROGRESS}
SELECT progress_id, arg_max(percent, event_seq) AS percent, max(permil) = 1000 AS finished
FROM pr GROUP BY progress_id"""
ORACLES["a6_projection_progress"] = f"""WITH {JOURNAL}
SELECT tag, persistence_id, max(seq_nr) AS "offset", max(ts) AS last_updated
FROM j GROUP BY tag, persistence_id"""
ORACLES["a6_tag_progress"] = f"""WITH {JOURNAL}
SELECT tag, max(ts) AS last_updated, count(*) AS events FROM j GROUP BY tag"""
ORACLES["a7_consumer_set"] = f"""WITH {MSG}
SELECT DISTINCT id, 'ref-' || id AS ref FROM msgs"""

# --- windows, order, sets -----------------------------------------------------------------------

ORACLES["w1_assign_seq"] = f"WITH {JOURNAL} SELECT event_id, persistence_id, seq_nr FROM j"
ORACLES["w2_keep_latest"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, event_type FROM j
QUALIFY seq_nr > max(seq_nr) OVER (PARTITION BY persistence_id) - 3"""
ORACLES["w3_running_state"] = f"""WITH {JOURNAL}, {RUNNING}
SELECT persistence_id, seq_nr, {FILE}, status FROM rs WHERE event_type <> 'FileRemoved'"""
ORACLES["o1_in_commit_order"] = f"""WITH {JOURNAL}, {CATALOG}
SELECT commit_ts, persistence_id, seq_nr, status FROM c ORDER BY commit_ts, persistence_id, seq_nr"""
ORACLES["u1_catalog_union"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, 'none' AS status FROM j WHERE event_type = 'FileAdded'
UNION ALL SELECT persistence_id, seq_nr, status FROM j WHERE event_type = 'UpdatedStatus'"""
ORACLES["u2_consumer_add"] = f"""WITH {REG}
SELECT id, ref FROM reg
UNION SELECT {uid('s_suppkey % 500')}, 'consumer-' || (s_suppkey * 50) FROM supplier"""
ORACLES["u2_consumer_remove"] = f"""WITH {REG}
SELECT id, ref FROM reg WHERE ref NOT IN (SELECT ref FROM gone)"""

# --- scalar functions ---------------------------------------------------------------------------

ORACLES["h1_get_ext"] = f"WITH {FILES} SELECT doc_id, {ext('file_name')} AS ext FROM f"
ORACLES["h2_get_extension"] = f"WITH {FILES} SELECT doc_id, {extension('file_name')} AS ext FROM f"
ORACLES["h3_generate_name"] = f"""WITH {EVENTS}
SELECT event_id, {uid("'name:' || event_id")} || '-' || CAST(floor(epoch(ts)) AS BIGINT) || '.'
  || {ext('file_name')} AS name FROM je"""
ORACLES["h4_parse_uuid"] = f"WITH {ID_TEXTS} SELECT c_custkey, {loose_uuid('t')} AS id FROM ids"
ORACLES["h5_non_zero"] = """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance,
  CASE WHEN c_nationkey > 5 THEN CAST(c_nationkey - 5 AS INTEGER) END AS nation FROM customer"""
_WS = "chr(9) || chr(10) || chr(13) || chr(32)"
ORACLES["h6_non_empty_string"] = f"""
SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN md5(nullif(trim(text, {' || '.join(
    f'chr({i})' for i in range(1, 33))}), '')) END AS digest FROM documents"""
ORACLES["h7_event_tag"] = f"""WITH ids AS (SELECT {uid('c_custkey')} AS id FROM customer)
SELECT id, {java_hash('id')} AS hash, 'file-' || abs({java_hash('id')} % 4) AS tag FROM ids"""
ORACLES["h8_percent"] = f"WITH {PROGRESS} SELECT event_seq, percent FROM pr"
ORACLES["h9_file_type"] = """
SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS file_type FROM pages"""
_NUM = """(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * CAST(o_orderkey AS HUGEINT) * 300007"""
ORACLES["h10_json_int"] = f"""WITH n AS (SELECT o_orderkey, {_NUM} AS w FROM orders)
SELECT o_orderkey,
  CASE WHEN w BETWEEN -2147483648 AND 2147483647 THEN CAST(w AS INTEGER) END AS in_range,
  CAST(((w + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS wrapped
FROM n"""
ORACLES["h11_content_type_default"] = f"""WITH {EVENTS}
SELECT event_id, CASE WHEN content_type = '' THEN 'audio/mpeg' ELSE content_type END AS content_type
FROM je"""
ORACLES["h12_file_path"] = f"WITH {FILES} SELECT doc_id, 'home/{UP}/' || file_name AS path FROM f"
ORACLES["h13_message_json"] = f"""WITH {MSG}
SELECT event_id, CAST(json_object('id', id, 'msg', msg) AS VARCHAR) AS body FROM msgs"""
ORACLES["h14_parse_command"] = f"""WITH {MSG}
SELECT event_id, CASE WHEN event_id % 5 > 2 THEN id END AS id,
  CASE WHEN event_id % 5 > 2 THEN msg END AS msg,
  CASE WHEN event_id % 5 <= 2 THEN 'invalid command.' END AS error FROM msgs"""
ORACLES["h15_to_bytes"] = """
SELECT doc_id, md5(hex(encode(text))) AS digest, octet_length(encode(text)) AS n_bytes
FROM documents"""
ORACLES["h16_parse_profile"] = f"""WITH g AS (
  SELECT p_partkey, {pick(['BASELINE', 'MAIN', 'HIGH', 'HIGH10', 'HIGH422', 'HIGH444', 'high', 'None'],
  'p_partkey % 8')} AS p FROM part)
SELECT p_partkey, CASE WHEN p IN ({PROFILES}) THEN p END AS profile, p NOT IN ({PROFILES}) AS wrong
FROM g"""

# --- validation ---------------------------------------------------------------------------------

_KIND = """CASE t WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
  WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE
  CASE WHEN t IS NULL THEN 'missing' ELSE 'number' END END"""
ORACLES["v1_extract"] = f"""WITH {REQUESTS}, x AS (SELECT *, {jt('$.audio.channels')} AS t FROM rq)
SELECT request_key, {_KIND} AS kind, {int_value('$.audio.channels')} AS channels,
  CASE WHEN {int_bad('$.audio.channels')} THEN 'channels' END AS channels_error,
  {str_value('$.format', "''")} AS format,
  CASE WHEN NOT {is_str('$.format')} THEN 'format' END AS format_error FROM x"""
ORACLES["v2_extract_optional"] = f"""WITH {REQUESTS}
SELECT request_key, {int_value('$.audio.quality', '-1')} AS quality,
  CASE WHEN {jt('$.audio.quality')} IS NOT NULL AND {int_bad('$.audio.quality')} THEN 'quality' END
    AS quality_error,
  {str_value('$.video.tag', "'-'")} AS tag, CAST(NULL AS VARCHAR) AS tag_error FROM rq"""
_V3 = errs(
    (f"NOT {is_str('$.extension')}", "'extension'"), (f"NOT {is_obj('$.audio')}", "'audio'"),
    (f"NOT {is_obj('$.video')}", "'video'"),
)
ORACLES["v3_collect_errors"] = f"""WITH {REQUESTS}
SELECT request_key, {_V3} AS errors,
  CAST(CASE WHEN {is_str('$.extension')} THEN 0 ELSE 1 END
    + CASE WHEN {is_obj('$.audio')} THEN 0 ELSE 1 END
    + CASE WHEN {is_obj('$.video')} THEN 0 ELSE 1 END AS BIGINT) AS n_errors FROM rq"""
_V4 = errs(
    (f"{jt('$.id')} IS NULL", "'id'"), (f"{jt('$.extension')} IS NULL", "'extension'"),
)
ORACLES["v4_validate_form"] = f"""WITH {REQUESTS}
SELECT request_key, {jt('$.id')} IS NULL OR {jt('$.extension')} IS NULL AS has_errors,
  {_V4} AS wrong,
  CASE WHEN {jt('$.extension')} IS NULL THEN 'This field is required.' END AS extension_error,
  coalesce(json_extract_string(b, '$.extension'), 'tmp') AS extension,
  coalesce(json_extract_string(b, '$.progress_id'), 'none') AS progress_id,
  'fallback' AS absent FROM rq"""
ORACLES["v5_read_audio"] = f"""WITH {REQUESTS}
SELECT request_key, {AUDIO_VALUES}, {audio_errs()} AS fields FROM rq WHERE {is_obj('$.audio')}"""
ORACLES["v6_read_video"] = f"""WITH {REQUESTS}
SELECT request_key, {VIDEO_VALUES}, {video_errs()} AS fields FROM rq WHERE {is_obj('$.video')}"""
ORACLES["v7_read_preferences"] = f"""WITH {JUDGED}
SELECT request_key, CASE WHEN reason IS NULL THEN u_id END AS id,
  CASE WHEN reason IS NULL THEN x_ext END AS extension,
  CASE WHEN reason IS NULL THEN x_fmt END AS format,
  CASE WHEN reason IS NULL THEN coalesce(u_progress = u_id, false) END AS progress_is_id,
  reason IS NULL AS has_progress,
  {masked(A_COLS, 'reason IS NULL AND has_a')}, {masked(V_COLS, 'reason IS NULL AND has_v')},
  reason, fields FROM jd"""
ORACLES["v8_read_media"] = f"""WITH {PROBED},
mv AS (
  SELECT *, CASE WHEN NOT has_a OR k % 11 IN (3, 5) THEN 'Malformed request content'
      WHEN k % 11 IN (2, 4) OR (k % 11 = 1 AND starts_with(content_type, 'video'))
        THEN 'Invalid fields.' END AS reason
  FROM pb)
SELECT id AS media_id, CASE WHEN reason IS NULL THEN file_name END AS file_name,
  CASE WHEN reason IS NULL THEN content_type END AS content_type,
  CASE WHEN reason IS NULL THEN id END AS info_id,
  CASE WHEN reason IS NULL THEN duration END AS duration,
  CASE WHEN reason IS NULL THEN format END AS format,
  {masked(A_COLS, 'reason IS NULL')}, {masked(V_COLS, 'reason IS NULL')}, reason,
  CASE WHEN reason = 'Invalid fields.' THEN CASE k % 11 WHEN 1 THEN 'content_type'
    WHEN 2 THEN 'file_name' WHEN 4 THEN 'id' END ELSE '' END AS fields FROM mv"""
ORACLES["v9_read_codec_lists"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'h264' END AS encoders,
  CASE WHEN c_custkey % 3 = 0 THEN c_name || ',vp9' END AS decoders,
  CASE WHEN c_custkey % 3 <> 0 THEN 'Invalid config' END AS error FROM customer"""
ORACLES["v10_quarantine"] = f"""WITH {JUDGED}
SELECT raw, reason, fields FROM jd WHERE reason IS NOT NULL"""

# --- conversion ---------------------------------------------------------------------------------


def above_zero(column: str) -> str:
    return f"CASE WHEN {column} > 0 THEN {column} END"


ORACLES["c1_plan_audio"] = f"""WITH {JUDGED}
SELECT request_key, nullif(trim(a_decoder), '') AS codec, {above_zero('a_bit_rate')} AS bit_rate,
  {above_zero('a_sampling_rate')} AS sampling_rate, {above_zero('a_channels')} AS channels,
  {above_zero('a_volume')} AS volume FROM ok"""
ORACLES["c2_plan_video"] = f"""WITH {JUDGED}
SELECT request_key, {above_zero('v_bit_rate')} AS bit_rate,
  CASE WHEN v_frame_rate > 0 THEN CAST(floor(v_frame_rate) AS INTEGER) END AS frame_rate,
  nullif(trim(v_decoder), '') AS codec, nullif(trim(v_tag), '') AS tag, v_width AS width,
  v_height AS height, v_profile AS profile FROM ok"""
ORACLES["c3_plan_conversion"] = f"""WITH {PLAN}
SELECT request_key, id AS source_file_id, new_id AS file_id, source_name, new_name, format,
  nullif(trim(a_decoder), '') AS audio_codec, nullif(trim(v_decoder), '') AS video_codec, plan_error
FROM plan"""
ORACLES["c4_run_conversions"] = f"""WITH {PLAN}
SELECT new_id AS file_id, new_name,
  CASE WHEN plan_error IS NOT NULL OR format = 'ogg' THEN 'failed' ELSE 'complete' END AS status,
  coalesce(plan_error, CASE WHEN format = 'ogg' THEN 'ValueError: unsupported format ogg' END)
    AS error FROM plan"""
ORACLES["c5_probe_files"] = f"""WITH {FILES}
SELECT file_id, CASE WHEN length >= 200 THEN length // 100 END AS duration,
  CASE WHEN length >= 200 THEN 'raw' END AS format,
  CASE WHEN length >= 200 THEN CAST(length AS INTEGER) END AS bit_rate, false AS has_video,
  CASE WHEN length < 200 THEN 'ValueError: not a media file' END AS error FROM f"""
ORACLES["c6_progress_rows"] = f"""WITH {PLAN}
SELECT new_id AS progress_id, CAST(0 AS BIGINT) AS event_seq, CAST(290 AS INTEGER) AS permil
FROM plan WHERE plan_error IS NULL
UNION ALL SELECT new_id, CAST(1 AS BIGINT), CAST(1000 AS INTEGER)
FROM plan WHERE plan_error IS NULL AND format <> 'ogg'"""

# --- streams: the batch result they must equal --------------------------------------------------

ORACLES["t1_project_by_tag"] = ORACLES["a6_projection_progress"]
ORACLES["t2_state_stream"] = ORACLES["a1_current_state"]
ORACLES["t3_dedupe_replays"] = f"""WITH {JOURNAL}
SELECT persistence_id, seq_nr, event_type FROM j"""
ORACLES["t4_progress_stream"] = ORACLES["a5_progress_latest"]
ORACLES["t5_route_stream"] = f"""WITH {REG}, {MSG}
SELECT id, ref, msg, ts FROM msgs JOIN (SELECT DISTINCT id, ref FROM reg) USING (id)
WHERE event_id % 10 <> 0
UNION ALL SELECT CAST(NULL AS VARCHAR), '*', msg, ts FROM msgs WHERE event_id % 10 = 0"""
ORACLES["t6_intake_stream"] = ORACLES["s1_scan_files"]
ORACLES["t5_route_buffer"] = f"""WITH {REG}, {MSG},
sent AS (
  SELECT ref, event_id, id, msg, ts, event_id % (3 + CAST(substr(ref, 10) AS INTEGER) % 9) = 0 AS reads
  FROM msgs JOIN act USING (id)),
waits AS (
  SELECT *, coalesce(sum(CASE WHEN reads THEN 1 ELSE 0 END) OVER (
    PARTITION BY ref ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM sent),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY ref, g ORDER BY event_id) AS pos,
    max(CASE WHEN reads THEN event_id END) OVER (PARTITION BY ref, g) AS read_at FROM waits),
failed AS (SELECT ref, min(event_id) AS failed_at FROM placed WHERE pos = 11 GROUP BY ref)
SELECT ref, event_id, 'delivered' AS outcome, id, msg, ts FROM placed LEFT JOIN failed USING (ref)
WHERE read_at IS NOT NULL AND (failed_at IS NULL OR read_at < failed_at)
UNION ALL SELECT ref, event_id, 'overflow', id, msg, ts FROM placed JOIN failed USING (ref)
WHERE event_id = failed_at"""
ORACLES["t6_chunk_stream"] = f"""WITH {CHUNKS}
SELECT file_id, count(*) AS n_chunks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS length,
  count(DISTINCT chunk_no) = max(chunk_no) + 1 AS complete FROM ch GROUP BY file_id"""
ORACLES["t7_commit_delay"] = f"""WITH {JOURNAL}, newest AS (SELECT tag, max(ts) AS last FROM j GROUP BY tag)
SELECT tag, event_date, count(*) FILTER (ts <= last - INTERVAL 2 SECOND) AS released,
  count(*) FILTER (ts > last - INTERVAL 2 SECOND) AS held
FROM j JOIN newest USING (tag) GROUP BY tag, event_date"""
ORACLES["x1_fold_events"] = f"""WITH {JOURNAL}, {STATE}
SELECT persistence_id, file_name, nullif(status, 'none') AS status, n_events
FROM st JOIN (SELECT persistence_id, count(*) AS n_events FROM j GROUP BY 1) USING (persistence_id)"""
ORACLES["x1_fold_stream"] = ORACLES["x1_fold_events"]
