"""All detectors of the registry: what they find, and how long hostile texts take."""

from __future__ import annotations

import re
import time

import pyarrow as pa
import pytest

from leakloom.functions import linear
from leakloom.operators import registry
from leakloom.operators.detect import Plan, example, found_in, scan_text, scan_texts

EVERY = registry.load()
EXAMPLES = {d.id: example(d) for d in EVERY}


def found(text):
    return {(d.id, s) for d, s, _, _ in scan_text(Plan(EVERY), text)}


def test_every_detector_finds_an_example_of_its_own_among_all_others():
    assert len(EXAMPLES) == 1098
    texts = [f"x = 1\n {text}\n" for text, _ in EXAMPLES.values()]
    for (i, (_, secret)), got in zip(EXAMPLES.items(), scan_texts(Plan(EVERY), texts)):
        assert secret in {s for d, s, _, _ in got if d.id == i}, i


def test_time_is_linear_in_hostile_texts():
    """A MB of a detector's own openings, cut off at several places, takes less than a second."""
    for d in EVERY:
        text, hostile = EXAMPLES[d.id][0], ""
        for cut in (len(text) // 4 or 1, len(text) // 2, 3 * len(text) // 4, len(text) - 1):
            hostile += (text[:cut] + " " * (cut % 2)) * ((1 << 18) // cut)
        began = time.process_time()
        found_in(Plan((d,)), [hostile])
        assert time.process_time() - began < 1.0, d.id


@pytest.mark.parametrize("opening", ["postgres://a:", "mysql://a:", "mongodb://a:b", "a://b:", "-----BEGIN PRIVATE KEY-----", "Server=a;", '{"client_id":"', "a-.freshdesk.com", "token = ", '"auths":{'])
def test_whole_registry_on_openings(opening):
    began = time.process_time()
    scan_text(Plan(EVERY), opening * ((1 << 20) // len(opening)))
    assert time.process_time() - began < 30


def test_words_bound_what_follows():
    assert ("postgres-uri", "postgres://u:p4ssw0rdd@h/x") in found("u=postgres://u:p4ssw0rdd@h/x")
    for text in ("xpostgres://u:p4ssw0rdd@h/x", "xmysql://u:p4ssw0rdd@h/x", "xmongodb://u:p4ssw0rdd@h/x", "xredis://u:p4ssw0rdd@h/x", "xftp://user:p4ssw0rdd@h/x", "xtkn.v1_" + "a" * 71 + "=", "xhttps://hooks.zapier.com/hooks/catch/" + "a" * 16):
        assert {i for i, _ in found(text)} <= {"basic-auth-url"}, text
    # A bound that follows a sign needs a word behind it, so the secret ends before the sign.
    assert ("github-token", "ghp_" + "a" * 36) in found("ghp_" + "a" * 36 + "-")


def test_matches_are_python_s_where_bounds_agree():
    """Places and order of all matches, with marks, blanks and several planes of characters between."""
    pattern = r"(?:key|token)[^\n]{0,9}(?<![0-9A-Za-z_])([a-z]{3,5}\d+)(?![0-9A-Za-z_])"
    texts = ["key ab1 key abc1", "", "\x01\x02token é\U0001f600 abcd22\x04 token\x03xyz9 key\nabc1", "tokentoken key abc1abc2 abcde7", "key \udc80\udcff abc3"] * 3
    got = list(linear.spans(pa.array([linear.searchable(t) for t in texts], pa.large_string()), linear.form(pattern)))
    assert got == [(k, *m.span(1), m.start()) for k, t in enumerate(texts) for m in re.compile(pattern, re.ASCII).finditer(t)]


@pytest.mark.parametrize(
    ("pattern", "group", "text", "secrets"),
    [
        (r"(?i)n=(\d)", 1, "N=1 n=2", ["1", "2"]),
        (r"n=(\d)|m=(\w)", 2, "m=x n=1", ["x", "n=1"]),
        (r"(a)(?:b(c))?", 2, "abc a", ["c", "a"]),
        (r"((x)=(\d))", 3, "x=1 x=2", ["1", "2"]),
        (r"(?P<k>k)=(?P<v>[()[\]]+)", 2, "k=([)]", ["([)]"]),
        (r"k=\d+", 5, "k=12", ["k=12"]),
        (r"(?<=k)\d+", 0, "k12", ["12"]),
    ],
)
def test_groups_of_custom_patterns(pattern, group, text, secrets):
    own = registry.Detector("own", "Own", "low", (), pattern, group, custom=True)
    values = pa.array([linear.searchable(text)], pa.large_string())
    assert [text[a:b] for _, a, b, _ in own.spans(values)] == secrets


NOTHING = ["token = ${SECRET_TOKEN_VALUE}", "password: {{ vault.password_value }}", "api_key = $API_KEY_FROM_ENV", "secret=%SECRET_NAME_OF_IT%", "token=ENC[AES256_GCM,data]abcd", "password = os.environ.get_password_of_it", "OTHER=sk_test_" + "a" * 24]


@pytest.mark.parametrize("text", NOTHING)
def test_references_are_no_secrets(text):
    assert not found(text)
