"""Record schemas (Spark DDL) and the fixed vocabulary of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------
FILE_ADDED = "FileAdded"
CONVERTED_FILE = "ConvertedFile"
UPDATED_STATUS = "UpdatedStatus"
HANDLED_EVENTS = (FILE_ADDED, CONVERTED_FILE, UPDATED_STATUS)

STATUS_NONE = "none"
STATUS_INPROGRESS = "inprogress"
STATUS_COMPLETE = "complete"
STATUS_FAILED = "failed"

FILE_STATUS_UPLOADED = 0
FILE_STATUS_CONVERTED = 4

UPLOAD_DIR = "Desktop/file/uploaded"
CONVERT_DIR = "Desktop/file/converted"

MAX_UPLOAD_BYTES = 200_000_000_000
PLAYBACK_CHUNK_BYTES = 100_000
SNAPSHOT_EVERY = 100
SNAPSHOT_KEEP = 3
TAG_COUNT = 4

FILE_NOT_FOUND = "file not found."
NON_MEDIA_FILE = "Non-media file."
INVALID_FIELDS = "Invalid fields."
MALFORMED_REQUEST = "Malformed request content"
INVALID_COMMAND = "invalid command."
FIELD_REQUIRED = "This field is required."
FIELD_INVALID_TYPE = "Invalid type found in this field."
INVALID_CODEC_LISTS = "Invalid config"

UNKNOWN_REPLY = '{"error":"unknown"}'
CONTENT_TYPE_ERROR = "Content-Type: %s is invalid"
DEFAULT_CONTENT_TYPE = "audio/mpeg"
EVENT_LOG_LINE = "EventProcessor(%s) consumed %s from %s with seqNr %d"

H264_PROFILES = ("BASELINE", "MAIN", "HIGH", "HIGH10", "HIGH422", "HIGH444")
# ----------------------------------------------------------------------------------------------

FILE_JOURNAL = (
    "struct<file_name:string,full_path:string,content_type:string,status:int,file_id:string>"
)
AUDIO = (
    "struct<bit_rate:int,channels:int,decoder:string,sampling_rate:int,quality:int,volume:int>"
)
VIDEO = (
    "struct<bit_rate:int,frame_rate:double,decoder:string,size:struct<width:int,height:int>,"
    "tag:string,profile:string>"
)
JOURNAL = (
    "persistence_id string, seq_nr bigint, ts timestamp, event_date date, tag string, "
    f"event_type string, file {FILE_JOURNAL}, status string, source_file_id string"
)
SNAPSHOT = (
    f"persistence_id string, seq_nr bigint, file {FILE_JOURNAL}, file_seq bigint, "
    "status string, status_seq bigint"
)
CATALOG = (
    f"file {FILE_JOURNAL}, status string, commit_ts timestamp, persistence_id string, "
    "seq_nr bigint"
)
CHUNKS = "file_id string, chunk_no int, data binary"


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
