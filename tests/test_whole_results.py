"""Queries hold whole results where a document, or a table, has more than the rows their SQL looks at."""

import base64
import hashlib
import re

import pytest

import __spark_entry__ as entry
from leakloom.functions import findings, plausible
from leakloom.operators import registry
from leakloom.operators.detect import is_binary
from leakloom.plans.queries import ASSIGNED

PATTERN = next(d for d in registry.load() if d.id == ASSIGNED).compiled


@pytest.fixture
def table(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def _run(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).rstrip(b"=").decode()


def test_base64_of_the_corpus(spark, table):
    payloads = [b'password: "' + b"k" * 20 + b'"', b"token=" + b"a" * 16 + b"\nsecret=" + b"b" * 17, b"x\xff\xfe\x80? token: " + b"c" * 18, b"\x00 token: " + b"d" * 18, "größe token=".encode() + b"e" * 19]
    texts = [f"x {_run(p, i % 2 == 1)} y {_run(p)}\n" for i, p in enumerate(payloads)] + ["token=" + "f" * 16, "A" * 21, "", None]
    sf = table("documents", list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, text in enumerate(texts):
        if text is None:
            continue
        for run in re.findall(r"\b[A-Za-z0-9+/_-]{20,}={0,2}\b", text, re.ASCII):
            data = plausible.decode_base64(run)
            if data is not None and len(data) >= 8 and not is_binary(data):
                want += [(i, x) for x in PATTERN.findall(data.decode("latin-1"))]
    want = list(dict.fromkeys(want))
    rows = entry.queries()["base64_decoded_findings"](spark, sf).collect()
    assert all(r["line"] == 1 for r in rows)
    got = [(r["doc_id"], r["secret"]) for r in rows if r["detector_id"] == ASSIGNED]
    planted = [(i, s) for i, s in got if re.fullmatch("[0-9a-f]{32}", s)]
    assert sorted(set(got) - set(planted)) == sorted(set(want)) and len(got) - len(planted) == len(want)
    assert (1, "a" * 16) in got and (1, "b" * 17) in got and len(planted) == sum(t is not None for t in texts)


def test_every_location(spark, table):
    one = "token=" + "a" * 16
    texts = [one, f"é {one}\n\nü PASSWORD:\n '{'b' * 20}' {one},{one}\n", f"{one}\r\n{one}\n", f"no match\nx{one}", "", None, "\n".join(f"{'ß' * i} {one} {one}" for i in range(60))]
    sf = table("documents", list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, text in enumerate(texts):
        for m in PATTERN.finditer(text or ""):
            before = text[: m.start(1)].encode()
            want.append((i, 1 + before.count(b"\n"), len(before) - (before.rfind(b"\n") + 1) + 1))
    queries = entry.queries()
    got = [(r["doc_id"], r["line"], r["column"]) for r in queries["finding_location"](spark, sf).collect()]
    assert sorted(got) == want and len(got) == 127


def test_fanout_of_every_object(spark, table):
    parts = [(k, f"part {k % 7}", k % 50 + 1) for k in range(60)]
    lines = [(k % 70, k % 11, k % 3) for k in range(400)] * 2
    table("part", parts, "p_partkey long, p_name string, p_size int")
    sf = table("lineitem", lines, "l_partkey long, l_orderkey long, l_suppkey long")
    want = []
    for oid, commit, path in set(lines):
        if oid < 60:
            file = f"dir/{path}" + (f"!/in/{oid}.env" if oid % 3 == 0 else "")
            want.append((oid, commit, file, findings.fingerprint_of("d", hashlib.md5(parts[oid][1].encode()).hexdigest(), file, str(commit))))
    got = [tuple(r) for r in entry.queries()["history_fanout"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 300


def test_organisations_with_every_repository(spark, table):
    rows = [(k, "token=" + "a" * (10 + k), ("de", "en", None)[k % 3], f"o{k % 4}") for k in range(12)]
    sf = table("documents", rows, "doc_id long, text string, lang string, source string")
    got = {r["org"]: (r["repositories"], r["findings"]) for r in entry.queries()["org_findings"](spark, sf).collect()}
    assert got == {f"o{i}": (3, 3 + sum(k >= 6 for k in range(i, 12, 4))) for i in range(4)}


def test_binary_at_the_edge(spark, table):
    sizes = [None, 0, 7989, 7990, 7999, 8000, 8001]
    texts = [None if n is None else "ß" * (n // 2) + "a" * (n % 2) for n in sizes]
    sf = table("documents", [(5 * k + d, t) for k, t in enumerate(texts) for d in (0, 1)], "doc_id long, text string")
    got = {tuple(r) for r in entry.queries()["binary_filter"](spark, sf).collect()}
    assert got == {(5 * k + d, d == 0 and (n or 0) < 8000) for k, n in enumerate(sizes) for d in (0, 1)}


def test_redacted_whole(spark, table):
    secrets = ["a1B2" * 4, "c3D4" * 30]
    sf = table("documents", [(k, f"token={x} ") for k, x in enumerate(secrets)], "doc_id long, text string")
    got = sorted(tuple(r) for r in entry.queries()["redacted"](spark, sf).collect())
    tokens = ["ghp_" + hashlib.md5(str(k).encode()).hexdigest() + "abcd" for k in (0, 1)]
    assert got == sorted((k, findings.redacted_of(y)) for own in (secrets, tokens) for k, x in enumerate(own) for y in (x, x[: 4 + k]))


def test_redacted_short(spark):
    df = spark.createDataFrame([("x" * n,) for n in range(4, 24)], "s string")
    got = [r[0] for r in df.select(findings.redacted(df["s"])).collect()]
    assert sorted(got) == sorted(findings.redacted_of("x" * n) for n in range(4, 24))
