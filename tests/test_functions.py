import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakloom.functions import findings, patterns, plausible

REFERENCES = ["${DB_PASSWORD}", "%{token}", "{{ secret }}", "$(get)", "$[x]", "%API_KEY%", "!API_KEY!", "ENC[abc]", "vault://a/b", "ref+vault://x", "os.getenv('X')", "process.env.TOKEN", "$name", "config.api_key", "_settings.secret", "API_KEY", "my_secret"]
VALUES = ["mySecretValue", "other.api_key", "A1b2C3d4", "x", "", "secret_aaaaaaaaaaaaaaaa", "config." + "k" * 40, "plain_words"]


@pytest.mark.parametrize("value", REFERENCES)
def test_references(value):
    assert plausible.is_reference(value)


@pytest.mark.parametrize("value", VALUES)
def test_values(value):
    assert not plausible.is_reference(value)


@pytest.mark.parametrize("value", ["short", "0" * 20, "xxxxxxxxxxxx", "abc[^def]ghi", r"abcd\sefgh", "(?:abc)defg", "Server=x;Password=${DB};Timeout=3"])
def test_implausible(value):
    assert not plausible.is_plausible(value)


def test_plausible_and_assigned():
    assert plausible.is_plausible("a" * 24) and plausible.is_plausible("Server=x;Password=abcdefgh12")
    assert plausible.is_assigned_reference("password = a.b.C(x);", 11)
    assert not plausible.is_assigned_reference('password = "a.b.c"', 12)
    assert not plausible.is_assigned_reference("token=abcdefghijklmnop", 6)


def test_columns_agree_with_python(spark):
    values = [*REFERENCES, *VALUES, "0" * 9, "xxxxxxxxx", "[^a-z]secret", " 'API_KEY' ", "f33e61083db5dbdf"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", plausible.reference(F.col("v")).alias("r"), plausible.plausible(F.col("v")).alias("p")).collect()
    for r in rows:
        assert r["r"] == plausible.is_reference(r["v"]), r["v"]
        assert r["p"] == plausible.is_plausible(r["v"]), r["v"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n\t \r", max_size=12))
def test_blank_line(text):
    want = any(not line.strip(" \t\r") for line in text.split("\n")[1:-1])
    assert plausible.crosses_blank_line(text) == want


def test_base64():
    assert plausible.decode_base64("aGVsbG8gd29ybGQ") == b"hello world"
    assert plausible.decode_base64("-_-_") is not None
    assert plausible.decode_base64("-_+/") is None
    assert plausible.decode_base64("abcde") is None


def test_location_redaction_fingerprint(spark):
    df = spark.createDataFrame([("a\nbé ", "s" * 16), ("", "12345678")], "before string, secret string")
    got = df.select(findings.line(F.col("before")), findings.column(F.col("before")), findings.redacted(F.col("secret")), findings.fingerprint(F.lit("d"), F.col("secret"), F.lit("f"), F.lit(None).cast("string"))).collect()
    assert tuple(got[0])[:3] == (2, 5, "ssss********ssss") and tuple(got[1])[:3] == (1, 1, "********")
    assert got[0][3] == findings.fingerprint_of("d", "s" * 16, "f", "") == hashlib.sha256(b"d\0" + b"s" * 16 + b"\0f\0").hexdigest()


def test_shapes():
    import re

    shape = lambda s: re.compile(patterns.secret_shape(s))
    assert shape('"gh" 1×pousr "_" 36–255×A-Za-z0-9_').fullmatch("ghp_" + "a" * 36)
    assert shape('one of "sk" or "rk" "_live_" 16–99×A-Za-z0-9').fullmatch("rk_live_" + "a" * 16)
    assert shape('"sk-" 0–1×("proj-") 32–200×A-Za-z0-9_-').fullmatch("sk-proj-" + "a" * 32)
    assert shape("≥2×not \\s@").fullmatch("ab") and not shape("≥2×not \\s@").fullmatch("a@")
