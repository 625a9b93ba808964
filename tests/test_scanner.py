import base64
import gzip
import io
import json
import subprocess
import tarfile
import time
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leakloom.operators import registry, state
from leakloom.operators.detect import Plan, detect, is_binary, scan_text, verify
from leakloom.plans import scan
from leakloom.sources import archives, files, git, hosting, sinks

TOKEN = "ghp_" + "a1B2" * 9


def found(text):
    return {(d.id, s) for d, s, _, _ in scan_text(Plan(registry.load()), text)}


def test_registry():
    every = registry.load()
    assert len(every) == 1098 and len({d.id for d in every}) == 1098
    assert all(d.compiled and d.usable_keywords for d in every)
    assert {d.severity for d in every} == {"critical", "high", "medium"}


@pytest.mark.parametrize(
    "detector, text, secret",
    [
        ("aws-access-key", "key AKIA" + "A1" * 8 + " x", "AKIA" + "A1" * 8),
        ("github-token", f"t {TOKEN} x", TOKEN),
        ("stripe-key", "sk_live_" + "a1" * 10, "sk_live_" + "a1" * 10),
        ("postgres-uri", "postgres://u:p4ssw0rd@db.example.com/x", "postgres://u:p4ssw0rd@db.example.com/x"),
        ("slack-webhook", "https://hooks.slack.com/services/T0A/B0A/" + "a1B" * 8, "https://hooks.slack.com/services/T0A/B0A/" + "a1B" * 8),
        ("generic-assigned-secret", 'password = "abcdef0123456789"', "abcdef0123456789"),
        ("datadog-api-key", "DATADOG_KEY=" + "a1" * 16, "a1" * 16),
        ("tallyfy-api-key", "tallyfy api_key: " + "a1B2" * 10, "a1B2" * 10),
        ("bamboohr-api-key", "api.bamboohr.com\napi_key=" + "a1B2" * 10, "a1B2" * 10),
        ("private-key", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"),
    ],
)
def test_detectors(detector, text, secret):
    assert (detector, secret) in found(text)


UUIDS = ["0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9", "9f8e7d6c-5b4a-3928-1706-f5e4d3c2b1a0"]
JWT = ".".join(["eyJ" + "hbGciOi" * 4, "eyJ" + "zdWIiOi" * 4, "c2lnbmF0" * 4])


@pytest.mark.parametrize(
    "detector, text, secret",
    [
        ("mailjet-basic-auth", "mailjet: Basic {}", "a1B" * 29 + "="),
        ("okta-api-token", "https://corp.oktapreview.com SSWS {}", "00" + "-aB3" * 10),
        ("resend-api-key", "api.resend.com\tauthorization: {}", "re_" + "a1B2" * 8),
        ("clerk-secret-key", "clerk_secret_key='{}'", "sk_test_" + "a1B2" * 8),
        ("workos-api-key", "workos prod secret-key = {}", "sk_live_" + "a1B2" * 8),
        ("liveblocks-secret-key", 'liveblocks: secret_key = "{}"', "sk_prod_" + "a1B2" * 8),
        ("azure-batch-key", "https://a.westeurope.batch.azure.com\nkey={}", "a1B2" * 22),
        ("twitter-consumer-secret", "twitter consumer-secret {}", "a1B2c" * 10),
        ("facebook-oauth-secret", "facebook appsecret {}", "a1B2" * 8),
        ("zendesk-api-token", "shop.zendesk.com api_token: {}", "a1B2" * 10),
        ("freshdesk-api-key", "shop.freshdesk.com api_key: {}", "a1B2" * 5),
        ("line-messaging-token", "line_messaging channel: {}", "a1B2" * 43),
        ("hashicorp-vault-approle", f"role_id: {UUIDS[1]}\nsecret_id: {{}}", UUIDS[0]),
        ("mattermost-personal-token", "mattermost {} at hq.cloud.mattermost.com", "a1b2c3d4e5f6g" * 2),
        ("cloudflare-global-api-key", "cloudflare global api key: {}", "a1b2" * 9 + "c"),
        ("azure-search-key", 'shop.search.windows.net\napi-key = "{}"', "a1B2" * 13),
        ("auth0-domain-jwt", "corp.auth0.com Bearer {}", JWT),
        ("scaleway-secret-key", "scaleway token: {}", UUIDS[0]),
        ("github-oauth-client-secret", "github app\nclient_secret: {}", "a1b2" * 10),
        ("gitlab-oauth-client-secret", "gitlab app\nclient-secret = {}", "a1b2" * 16),
        ("datadog-app-key", "datadog application_key: {}", "a1b2" * 10),
        ("auth0-client-secret", "auth0 tenant\nclient_secret = '{}'", "a1B2" * 14),
        ("onelogin-client-secret", "onelogin:\n client_secret: {}", "a1B2" * 9),
        ("wiz-client-secret", "wiz:\n client_secret: {}", "a1B2" * 9),
        ("azure-entra-client-secret", "login.microsoftonline.com client_secret: {}", "~a1B2" * 8),
        ("twitter-bearer-token", "twitter_api bearer-token: {}", "AAAA" + "%a1B" * 25),
        ("twitch-client-secret", "twitch\nclient_secret: {}", "a1B2" * 8),
        ("restpack-htmltopdf-api-key", "restpack html-to-pdf api key: key = {}", "a1B2" * 12),
        ("restpack-screenshot-api-key", "restpack screenshot token: {}", "a1B2" * 12),
        ("atlassian-datacenter-token", "atlassian datacenter access-token = {}", "a1B2" * 10),
        ("checkout-secret-key", "checkout key {}", "sk_" + UUIDS[0]),
        ("aha-api-key", "corp.aha.io {}", "a1b2" * 16),
        ("larksuite-app-secret", "cli_A1b2C3d4E5f6G7h8 {}", "a1B2" * 8),
    ],
)
def test_irregular_contexts(detector, text, secret):
    assert (detector, secret) in found(text.format(secret))
    assert detector not in {d for d, _ in found(f"unrelated = {secret}")}


BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ((BEGIN + "x\n") * 20_000, {}),
        (("github app " + BEGIN) * 20_000, {}),
        ("Server=a;" * 5_000 + "User ID=b;" * 5_000, {}),
        ("a" * 1_000_000 + " x://", {}),
        ("1" * 1_000_000 + "://user:abcdefgh@host", {}),
        ("1.a+" + "1" * 1_000_000 + "://user:abcdefgh@host x://u:ijklmnop@h", {"basic-auth-url": 2}),
        ((BEGIN + "\nabc\n" + END + "\n") * 3 + BEGIN * 20_000, {"private-key": 1, "ssh-private-key": 1}),
        ("Server=a;User ID=b;Password=abcdefgh;Server=" + "c" * 100_000, {"sqlserver-connection-string": 1}),
    ],
    ids=range(8),
)
def test_openings_without_an_end(text, found):
    own = ("private-key", "ssh-private-key", "github-app-private-key", "sqlserver-connection-string", "basic-auth-url", "gcp-service-account-json")
    plan = Plan(tuple(d for d in registry.load() if d.id in own))
    start = time.process_time()
    got = Counter(d.id for d, *_ in scan_text(plan, text))
    assert time.process_time() - start < 10
    assert got == found


def test_context_and_prefilter():
    assert ("bamboohr-api-key", "a1B2" * 10) not in found("bamboohr.com\n\napi_key=" + "a1B2" * 10)
    assert not found("nothing to see here, 1234567890abcdef")
    assert not found("token = ${SECRET_TOKEN_VALUE}") and not found("password = config.get(a).b.c()")


def test_decoded_payloads():
    inner = 'token = "0123456789abcdef0123"'
    for code in (base64.b64encode, base64.urlsafe_b64encode):
        assert ("generic-assigned-secret", "0123456789abcdef0123") in found("blob=" + code(inner.encode()).decode().rstrip("="))


def test_detect_stage(spark):
    rows = [("a.txt", None, b"x\n\xc3\xa9 " + TOKEN.encode()), ("b.bin", None, b"\0" + TOKEN.encode()), ("c", "c1", None), ("d", "", b""), ("a.txt", None, f"{TOKEN} {TOKEN}".encode())]
    got = detect(spark.createDataFrame(rows, "file string, commit string, content binary")).collect()
    assert sorted((r["file"], r["line"], r["column"]) for r in got if r["detector_id"] == "github-token") == [("a.txt", 1, 1), ("a.txt", 2, 4)]
    assert {r["secret"] for r in got} == {TOKEN} and is_binary(b"\0") and not is_binary(b"")


def test_custom_detectors(tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"detectors": [{"id": "acme", "regex": "acme_([0-9a-z]{12})", "keywords": ["acme_"], "secret_group": 1}]}))
    own = registry.load_custom(p)
    assert own[0].severity == "medium" and own[0].name == "acme"
    assert [s for _, s, _, _ in scan_text(Plan(own), "acme_0123456789ab")] == ["0123456789ab"]
    p.write_text(json.dumps({"detectors": [{"id": "x", "regex": "("}]}))
    with pytest.raises(ValueError):
        registry.load_custom(p)


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archives():
    inner = _zip({"nested.env": "x"})
    got = dict(archives.expand("outer.zip", _zip({"inner.zip": inner, "../bad": "y", "a/b.txt": "z"})))
    assert got == {"outer.zip!/inner.zip!/nested.env": b"x", "outer.zip!/a/b.txt": b"z"}
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("app/c.env")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert dict(archives.expand("b.tar.gz", out.getvalue())) == {"b.tar.gz!/app/c.env": b"abc"}
    assert dict(archives.expand("x/c.txt.gz", gzip.compress(b"q"))) == {"x/c.txt.gz!/c.txt": b"q"}
    small = archives.Limits(entry=2, total=4, entries=9)
    assert dict(archives.expand("o.zip", _zip({"a": "xxx", "b": "yy", "c": "zz", "d": "w"}), small)) == {"o.zip!/b": b"yy", "o.zip!/c": b"zz"}
    assert archives.safe_path("/x") is None and archives.safe_path("a/../../b") is None and archives.safe_path("a\\b") == "a/b"
    deep = _zip({"d.zip": _zip({"c.zip": _zip({"b.zip": _zip({"a": "1"})})})})
    assert [p for p, _ in archives.expand("e.zip", deep)] == ["e.zip!/d.zip!/c.zip!/b.zip"]


def test_folder_scan_baseline_and_sinks(spark, tmp_path):
    root = tmp_path / "r"
    for name, text in {"config.txt": f"t={TOKEN}", "ignored.env": f"t={TOKEN}", "node_modules/x.txt": TOKEN, "i.png": TOKEN, "sub/a.txt": TOKEN}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = scan.of_folder(spark, str(root), include=["*.txt"], exclude=["ignored.*"])
    assert {r["file"] for r in got.collect()} == {"config.txt", "sub/a.txt"}
    sinks.write_baseline(got, str(tmp_path / "b" / "base.json"))
    base = sinks.read_baseline(spark, str(tmp_path / "b" / "base.json"))
    assert scan.of_folder(spark, str(root), include=["*.txt"], baseline=base).isEmpty()
    report = json.loads("\n".join(sinks.render(got, "json", {"target": "r"})))
    assert {f["secret"] for f in report["findings"]} == {""} and "commit" not in report["findings"][0]
    assert json.loads("\n".join(sinks.render(got, "sarif")))["runs"][0]["results"][0]["level"] == "error"
    assert TOKEN not in "\n".join(sinks.render(got, "human")) and TOKEN in "\n".join(sinks.render(got, "jsonl", raw=True))
    assert json.loads("\n".join(sinks.render(got.where("false"), "json")))["findings"] == []
    with pytest.raises(ValueError):
        sinks.check_format("xml")


def test_globs(spark):
    df = spark.createDataFrame([("config.txt",), ("a/config.txt",), ("ignored.txt",), ("image.png",), ("a/b/c.md",)], "p string")
    ok = {r["p"] for r in df.where(files.allowed(F.col("p"), ["*.txt", "a/b/*", "[x"], ["ignored.*"])).collect()}
    assert ok == {"config.txt", "a/config.txt", "a/b/c.md"}
    assert files.glob_pattern("[x") is None and files.glob_pattern("a*") == "a[^/]*"


def test_history(spark, tmp_path):
    repo = str(tmp_path / "g")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", repo], check=True)
    for k, names in enumerate((("a.txt", "copy.txt"), ("b.txt",))):
        for n in names:
            (tmp_path / "g" / n).write_text(f"x {TOKEN}\n")
        run("add", "-A")
        run("commit", "-qm", str(k))
    run("rm", "-q", "a.txt")
    run("commit", "-qm", "gone")
    got = scan.of_history(spark, repo).collect()
    assert sorted(r["file"] for r in got) == ["a.txt", "b.txt", "copy.txt"] and len({r["fingerprint"] for r in got}) == 3
    assert list(git.parse(["commit:c1", "\nx", "y", "commit:c2", "z"])) == [("c1", "x"), ("c1", "y"), ("c2", "z")]


def test_clone():
    assert git.clone_url("https://github.com/o/r", "t/x") == "https://x-access-token:t%2Fx@github.com/o/r"
    assert git.clone_url("https://example.com/o/r", "t") == "https://example.com/o/r"
    waits, calls = [], []

    class Done:
        returncode, stderr = 1, "fatal: connection reset sekret"

    with pytest.raises(RuntimeError) as e:
        git.clone("https://github.com/o/r", "d", "sekret", run=lambda *a, **k: calls.append(a) or Done, sleep=waits.append)
    assert waits == [1, 4, 9] and len(calls) == 4 and "sekret" not in str(e.value)


def test_discovery(spark):
    pages = {"https://h/orgs/o/repos?type=all&per_page=100": ('<https://h/p2>; rel="next"', [{"full_name": "o/a"}]), "https://h/p2": ("", [{"full_name": "o/b", "private": True}, {"full_name": "o/a", "clone_url": "u"}, {"full_name": " "}])}
    client = hosting.Client("t", "https://h", lambda m, u, h: (200, {"Link": pages[u][0]}, json.dumps(pages[u][1]).encode()))
    rows = state.last_by_name(hosting.repositories(spark, client.organisation("o")), "idx").collect()
    assert [(r["full_name"], r["clone_url"]) for r in rows] == [("o/a", "u"), ("o/b", "")]
    assert hosting.owner("https://github.com/x/y.git") == "x" and hosting.owner("https://example.com/x/y") == "" and hosting.owner("x/y") == "x"
    now, calls = [0.0], []
    cache = hosting.TokenCache(lambda k: calls.append(k) or (f"t{len(calls)}", now[0] + 3600), lambda: now[0])
    assert cache.get("a") == cache.get("a") == "t1"
    now[0] = 3100
    assert cache.get("a") == "t2"


def test_jobs(spark, tmp_path):
    t = spark.createDataFrame([("a", "running", "", 1), ("a", "completed", "", 2), ("b", "running", "", 1), ("b", "failed", "e", 3), ("b", "running", "", 2)], "target string, status string, error string, at int")
    now = state.latest(t)
    assert {(r["target"], r["status"], r["attempts"]) for r in now.collect()} == {("a", "completed", 1), ("b", "failed", 2)}
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(state.to_resume(targets, now)) == ["b", "c"] and names(state.to_retry(targets, now)) == ["b"] and names(state.unseen(targets, now)) == ["c"]
    p = tmp_path / "s" / "job.json"
    sinks.write_job(str(p), "j1", {"a": {"status": "completed"}})
    assert sinks.read_job(str(p), "j1") == {"a": {"status": "completed"}} and p.stat().st_mode & 0o777 == 0o600
    with pytest.raises(ValueError):
        sinks.read_job(str(p), "j2")


def test_verification_once(spark):
    df = detect(spark.createDataFrame([(f"f{i}", "", TOKEN) for i in range(5)], "file string, commit string, content string"))
    assert {r["verified"] for r in verify(df, {"github-token": lambda s: s == TOKEN}).collect()} == {True}


def test_stream(spark, tmp_path):
    from leakloom.streaming import scan as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"x {TOKEN}")
    for _ in range(2):
        q = stream.scan(stream.read_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_targets(spark, tmp_path):
    (tmp_path / "l").write_text("# c\n\n o/a \no/b\no/a\n")
    assert sorted(r[0] for r in files.read_targets(spark, str(tmp_path / "l")).collect()) == ["o/a", "o/b"]
    (tmp_path / "l").write_text("# c\n")
    with pytest.raises(ValueError):
        files.read_targets(spark, str(tmp_path / "l"))
