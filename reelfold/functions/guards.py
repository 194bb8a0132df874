"""Value guards and small conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelfold import schemas as S

# RFC 7231: type "/" subtype *( ";" name "=" ( token | quoted-string ) )
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
CONTENT_TYPE = (
    rf'^{_TOKEN}/{_TOKEN}([ \t]*;[ \t]*{_TOKEN}=({_TOKEN}|"([^"\\]|\\.)*"))*[ \t]*$'
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def non_zero(value: Column | str) -> Column:
    """The number when it is above zero, else null (ints and doubles alike)."""
    value = _col(value)
    return F.when(value > 0, value)


def non_empty_string(text: Column | str) -> Column:
    """Text without leading and trailing characters up to U+0020; blank gives null."""
    trimmed = F.regexp_replace(_col(text), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
    return F.nullif(trimmed, F.lit(""))


def percent(permil: Column | str) -> Column:
    """Per mille to per cent, divided before multiplied so the doubles match bit for bit."""
    return (_col(permil) / F.lit(1000.0)) * F.lit(100)


def content_type_default(content_type: Column | str) -> Column:
    return F.coalesce(_col(content_type), F.lit(S.DEFAULT_CONTENT_TYPE))


def valid_content_type(content_type: Column | str) -> Column:
    """Whether the text is ``type/subtype`` with optional parameters; null is not."""
    return F.coalesce(_col(content_type).rlike(CONTENT_TYPE), F.lit(False))


def content_type_error(content_type: Column | str) -> Column:
    """Error text for an invalid content type, null for a valid one."""
    content_type = _col(content_type)
    return F.when(
        ~valid_content_type(content_type),
        F.format_string(S.CONTENT_TYPE_ERROR, F.coalesce(content_type, F.lit(""))),
    )


def to_bytes(text: Column | str) -> Column:
    return F.encode(_col(text), "UTF-8")


def parse_profile(text: Column | str) -> Column:
    """The profile name when it is a known upper-case H.264 profile, else null."""
    text = _col(text)
    return F.when(text.isin(*S.H264_PROFILES), text)


def profile_error(text: Column | str) -> Column:
    """Whether a profile is given but unknown."""
    text = _col(text)
    return text.isNotNull() & ~text.isin(*S.H264_PROFILES)


def wrap_int(whole: Column) -> Column:
    """A whole decimal reduced to its low 32 bits, signed."""
    low = whole % F.lit(4294967296).cast("decimal(38,0)")
    low = F.when(low < 0, low + 4294967296).otherwise(low).cast("bigint")
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low).cast("int")


def truncate(number: Column) -> Column:
    """A decimal without its fraction, towards zero."""
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("decimal(38,0)")
