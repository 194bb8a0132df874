"""Column functions against hand-computed values."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reelfold.functions import guards as G, ids as I, names as N, variants as V

EXT = {
    "a.mp4": "mp4", "a": "tmp", "a.": "tmp", "a..": "tmp", ".mp4": "mp4", "a.tar.gz": "gz",
    ".": "tmp", "": "tmp", "..a": "a", "a.b.": "b",
}


def test_get_ext(value):
    assert value(N.get_ext, list(EXT)) == list(EXT.values())


def test_get_extension(value):
    names = ["a.mp4", "a", "a.", "", ".", "..", ".mp4"]
    assert value(N.get_extension, names) == ["mp4", "a", "a", "", None, None, "mp4"]


def test_file_type(value):
    assert value(N.file_type, ["a/b/c", "a/b//", "c", "/", ""]) == ["c", "b", "c", None, ""]


def test_generate_name_is_repeatable(value):
    name = lambda x: N.generate_name(x, F.lit("2020-09-25 02:30:45"), F.lit("mp4"))
    first, second = value(name, ["k1", "k2"])
    assert [first, second] == value(name, ["k1", "k2"]) and first != second
    assert first.endswith("-1601001045.mp4") and len(first.split("-1601001045")[0]) == 36


TAGS = {
    "de1b1f2c-dae5-4426-9f35-f1accf07d9bf": (-1356655696, 0),
    "7a61cc25-050c-4a37-b4bd-ab6162dcd26b": (403999486, 2),
    "d3bf102f-4480-441b-9b90-54511e607c09": (-1762695427, 3),
    "0b13122d-3882-47b6-a0a1-b562234752c4": (-698696607, 3),
    "8c5aefc7-8921-4cac-b938-6b2149157c0e": (1863041910, 2),
}


def test_event_tag(value):
    assert value(I.java_hash, list(TAGS)) == [h for h, _ in TAGS.values()]
    assert value(I.event_tag, list(TAGS)) == [f"file-{n}" for _, n in TAGS.values()]


def test_parse_uuid(value):
    cases = {
        "1-1-1-1-1": "00000001-0001-0001-0001-000000000001",
        "DE1B1F2C-dae5-4426-9f35-f1accf07d9bf": "de1b1f2c-dae5-4426-9f35-f1accf07d9bf",
        "123456789-1-1-1-1": "23456789-0001-0001-0001-000000000001",
        "1-12345-1-1-1": "00000001-2345-0001-0001-000000000001",
        "x": None, "": None, "1-1-1-1-1 ": None, "1-2-3-4": None, "1-2-3-4-5-6": None,
        "de1b1f2cdae544269f35f1accf07d9bf": None,
        "de1b1f2c-dae5-4426-9f35-f1accf07d9bf0": None,
    }
    assert value(I.parse_uuid, list(cases)) == list(cases.values())


def test_route_id_is_stricter(value):
    texts = ["1-1-1-1-1", "de1b1f2c-dae5-4426-9f35-f1accf07d9bf"]
    assert value(I.route_id_valid, texts) == [False, True]


def test_guards(value):
    assert value(G.non_zero, [-1, 0, 1], "int") == [None, None, 1]
    assert value(G.non_zero, [-0.5, 0.0, 0.5], "double") == [None, None, 0.5]
    texts = ["  ", "\t\x01 a b \n", "", "\x00", "a", " "]
    assert value(G.non_empty_string, texts) == [None, "a b", None, None, "a", " "]
    assert value(G.parse_profile, ["HIGH", "high", "None"]) == ["HIGH", None, None]


def test_percent_is_bit_identical(value):
    got = value(G.percent, list(range(1001)), "int")
    assert got == [(p / 1000.0) * 100 for p in range(1001)]
    assert got[290] == 28.999999999999996
    assert [p for p, x in enumerate(got) if x == 100.0] == [1000]


def test_content_type(value):
    good = ["audio/mpeg", "text/html; charset=utf-8", 'a/b; c="d;e"', "image/svg+xml"]
    bad = ["", "audio", "audio/", "/mpeg", "a b/c", "audio/mpeg;", "a/b; c"]
    assert value(G.valid_content_type, good + bad + [None]) == [True] * 4 + [False] * 8


def test_json_int(value):
    texts = ["44100.9", "-3.7", "4294967297", "2147483648", "-2147483649", "1e3", "2.9999999999"]
    strict = lambda x: V.json_int(F.try_parse_json(x))
    wrap = lambda x: V.json_int(F.try_parse_json(x), wrap=True)
    assert value(strict, texts) == [44100, -3, None, None, None, 1000, 2]
    assert value(wrap, texts) == [44100, -3, 1, -2147483648, 2147483647, 1000, 2]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(2**70), 2**70), min_size=1, max_size=40))
def test_json_int_wraps_like_32_bits(spark, numbers):
    df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(numbers)], "i int, x string")
    got = df.orderBy("i").select(V.json_int(F.try_parse_json("x"), wrap=True)).collect()
    want = [(n + 2**31) % 2**32 - 2**31 for n in numbers]
    # Spark truncates towards zero before it wraps; whole numbers need no truncation
    assert [r[0] for r in got] == want


def test_kinds(value):
    text = '{"s":"x","n":1,"d":1.5,"e":1e3,"z":null,"b":true,"o":{},"a":[]}'
    want = {
        "s": "string", "n": "number", "d": "number", "e": "number", "z": "null", "b": "boolean",
        "o": "object", "a": "array", "q": "missing",
    }
    for field, kind in want.items():
        assert value(lambda x: V.kind(F.try_parse_json(x), f"$.{field}"), [text]) == [kind]


@pytest.mark.parametrize(
    "text,found,error",
    [
        ('{"n":5}', 5, None), ("{}", 0, "n"), ('{"n":null}', 0, "n"), ('{"n":"5"}', 0, "n"),
        ('{"n":true}', 0, "n"), ('{"n":3000000000}', 0, "n"), ("nope", 0, "n"),
    ],
)
def test_extract(value, text, found, error):
    e = lambda x: V.extract(F.try_parse_json(x), "$.n", V.INT, 0)
    assert value(lambda x: e(x).value, [text]) == [found]
    assert value(lambda x: e(x).error, [text]) == [error]


@pytest.mark.parametrize("strict", [True, False])
def test_extract_optional(value, strict):
    texts = ['{"t":"x"}', "{}", '{"t":null}', '{"t":5}']
    e = lambda x: V.extract_optional(F.try_parse_json(x), "$.t", V.STRING, "-", strict=strict)
    assert value(lambda x: e(x).value, texts) == ["x", "-", "-", "-"]
    bad = "t" if strict else None
    assert value(lambda x: e(x).error, texts) == [None, None, bad, bad]


def test_duplicate_keys_are_not_json(value):
    assert value(lambda x: F.try_parse_json(x).isNull(), ['{"a":1,"a":2}']) == [True]


def test_non_finite_is_not_above_zero(value):
    assert value(G.non_zero, [-math.inf], "double") == [None]
