import base64
import gzip
import hashlib
import io
import json
import random
import subprocess
import tarfile
import zipfile

import pytest

from leakloom import cli
from leakloom.functions import plausible
from leakloom.operators import registry, state
from leakloom.operators.detect import Plan, detect, scan_text, verifiers
from leakloom.plans import scan
from leakloom.sources import archives, git, hosting, sinks

TOKEN = "ghp_" + "a1B2" * 9


def test_damaged_archives_end_quietly():
    """Any bit may be wrong: opening gives what can be read, and never raises."""
    rng = random.Random(5)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(4):
            z.writestr(f"f{k}.txt", TOKEN * 20 + str(k))
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for k in range(4):
            info = tarfile.TarInfo(f"f{k}.txt")
            info.size = 400
            t.addfile(info, io.BytesIO(TOKEN.encode() * 10))
    plain = gzip.decompress(tar.getvalue())
    for name, data in (("a.zip", out.getvalue()), ("a.tar.gz", tar.getvalue()), ("a.tar", plain), ("a.gz", gzip.compress(TOKEN.encode() * 50))):
        for _ in range(300):
            broken = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
            list(archives.expand(name, bytes(broken[: rng.randint(1, len(broken))] if rng.random() < 0.3 else broken)))


def test_paths_with_line_breaks_and_renames(spark, tmp_path):
    repo = str(tmp_path / "g")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", repo], check=True)
    (tmp_path / "g" / "a\nb.txt").write_text(f"x {TOKEN}\n" * 30)
    (tmp_path / "g" / "link").symlink_to("a\nb.txt")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("mv", "a\nb.txt", "c d.txt")
    run("commit", "-qm", "two")
    assert sorted(p for _, p, _ in git.changes(repo)) == ["a\nb.txt", "c d.txt"]
    got = scan.of_history(spark, repo).collect()
    assert sorted(r["file"] for r in got) == ["a\nb.txt", "c d.txt"] and len({r["commit"] for r in got}) == 2
    with pytest.raises(RuntimeError):
        list(git.changes(str(tmp_path)))


def _key():
    """A small RSA key in both wrappings, from fixed primes."""
    p, q = 2**607 - 1, 2**521 - 1
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))

    def der(tag, body):
        size = bytes([len(body)]) if len(body) < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(len(body).to_bytes((len(body).bit_length() + 7) // 8, "big"))
        return bytes([tag]) + size + body

    number = lambda x: der(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))
    inner = der(0x30, b"".join(map(number, (0, n, e, d, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p)))))
    outer = der(0x30, number(0) + der(0x30, bytes.fromhex("06092a864886f70d0101010500")) + der(4, inner))
    pem = lambda name, x: f"-----BEGIN {name}-----\n{base64.encodebytes(x).decode()}-----END {name}-----\n"
    return n, e, d, pem("RSA PRIVATE KEY", inner), pem("PRIVATE KEY", outer)


def test_application_keys_and_tokens():
    n, e, d, *pems = _key()
    for pem in pems:
        assert hosting.read_key(pem) == (n, d)
        jwt = hosting.app_jwt("7", hosting.signer(pem), 1000)
        head, body, sig = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in jwt.split("."))
        opened = pow(int.from_bytes(sig, "big"), e, n).to_bytes((n.bit_length() + 7) // 8, "big")
        assert opened.endswith(hashlib.sha256(".".join(jwt.split(".")[:2]).encode()).digest()) and opened[:2] == b"\0\1"
        assert json.loads(body) == {"iat": 940, "exp": 1540, "iss": "7"} and json.loads(head)["alg"] == "RS256"
    for bad in ("", "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\n!\n-----END PRIVATE KEY-----"):
        with pytest.raises(ValueError):
            hosting.read_key(bad)

    calls = []

    def transport(method, url, headers):
        calls.append((method, url))
        if url.endswith("access_tokens"):
            return 201, {}, json.dumps({"token": f"t{url.split('/')[-2]}", "expires_at": "2030-01-01T00:00:00Z"}).encode()
        return 200, {}, json.dumps([{"id": 2, "account": {"login": "Zeta"}}, {"id": 1, "account": {"login": "Acme"}}]).encode()

    own = lambda **k: [(a, c.token) for a, c in hosting.clients(transport, "https://h", app_id="7", key=pems[0], **k)]
    assert own(every=True) == [("Acme", "t1"), ("Zeta", "t2")] and own(orgs=["ACME"]) == [("Acme", "t1")] and own(installation="9") == [("", "t9")]
    with pytest.raises(RuntimeError):
        own(orgs=["none"])
    assert [c.token for _, c in hosting.clients(transport, token="x")] == ["x"] and hosting.clients(transport) == []


def test_scan_of_an_organisation(spark, tmp_path, capsys):
    """Discovery, clones by the owner's token, a failing repository that is recorded, output as it comes, summary, retry."""
    repos = [{"full_name": "o/a", "clone_url": "https://github.com/o/a.git"}, {"full_name": "o/b", "clone_url": "https://github.com/o/b.git"}, {"full_name": "o/a", "clone_url": "https://github.com/o/a.git"}]
    transport = lambda m, u, h: (200, {}, json.dumps(repos).encode())
    seen, broken = [], {"https://github.com/o/b.git"}

    def clone(target, into, token=None):
        seen.append((target, token))
        if target in broken:
            raise RuntimeError("clone failed: no such repository")
        (tmp_path / "x").mkdir(exist_ok=True)
        import os

        os.makedirs(into)
        with open(f"{into}/f.txt", "w") as f:
            f.write(f"x {TOKEN}")

    paths = {k: str(tmp_path / k) for k in ("out.jsonl", "sum.json", "job.json")}
    argv = ["--orgs", "o", "--token", "tok", "--format", "jsonl", "--output", paths["out.jsonl"], "--summary", paths["sum.json"], "--job-id", "j", "--state", paths["job.json"]]
    assert cli.main([*argv, "--fail-on-findings"], spark, transport, clone) == 2
    assert sorted(seen) == [("https://github.com/o/a.git", "tok"), ("https://github.com/o/b.git", "tok")]
    lines = [json.loads(x) for x in open(paths["out.jsonl"])]
    assert [x["detector_id"] for x in lines] == ["github-token"] and lines[0]["secret"] == "" and TOKEN not in capsys.readouterr().err
    found = json.load(open(paths["sum.json"]))
    assert found["targets"] == {"total": 2, "completed": 1, "failed": 1, "running": 0, "pending": 0} and found["failures"] == [{"target": "https://github.com/o/b.git", "error": "clone failed: no such repository"}]
    assert found["findings"] == {"before_baseline": 1, "after_baseline": 1} and found["discovery"]["orgs"] == [{"name": "o", "repositories": 2, "findings": 1}]
    broken.clear()
    seen.clear()
    retry = ["--orgs", "o", "--token", "tok", "--format", "jsonl", "--output", paths["out.jsonl"], "--retry-failed", "j", "--state", paths["job.json"], "--quiet"]
    assert cli.main(retry, spark, transport, clone) == 0
    assert [t for t, _ in seen] == ["https://github.com/o/b.git"] and len(open(paths["out.jsonl"]).readlines()) == 2
    jobs = json.load(open(paths["job.json"]))["targets"]
    assert {t: (x["status"], x["attempts"]) for t, x in jobs.items()} == {"https://github.com/o/a.git": ("completed", 1), "https://github.com/o/b.git": ("completed", 2)}
    assert cli.main(["--orgs", "o", "--token", "tok", "--summary-only", "--summary", paths["sum.json"]], spark, transport, None) == 0
    assert json.load(open(paths["sum.json"]))["discovery"]["repositories"] == 2
    for bad in (["--resume", "a", "--retry-failed", "b"], ["--repo-list", "x", "--orgs", "o"], ["--orgs", "o", "--token", ""], ["--resume", "j", "--output", "x", "--format", "json"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark, transport, clone)
    with pytest.raises(Exception):
        cli.main(["--target", str(tmp_path / "nowhere"), "--quiet"], spark)


def test_job_scopes():
    scope = lambda **k: sinks.job_id(sinks.job_scope(**k), 0).rsplit("-", 1)[0]
    assert scope(enterprise="Big Corp") == "enterprise-big-corp" and scope(orgs=["A", "B c"]) == "org-a-b-c" and scope(accessible=True) == "accessible"
    assert scope(target=".", repo_list="/x/mine.txt") == "repo-list-mine" and scope(target="https://github.com/O/R.git") == "repo-o-r" and scope(target="/x/Some Dir") == "target-some-dir"


def test_installations_and_outcomes(spark):
    installations = spark.createDataFrame([(1, "Acme"), (2, "none")], "installation long, account string")
    repositories = spark.createDataFrame([("ACME",), ("acme",), ("x",)], "account string")
    assert sorted(tuple(r) for r in state.by_installation(installations, repositories).collect()) == [(1, "Acme", 2), (2, "none", 0)]
    targets = spark.createDataFrame([("a", "aCME"), ("b", "x"), ("c", None)], "target string, owner string")
    assert sorted((r[0], r[2]) for r in state.with_token(targets, installations).collect()) == [("a", 1), ("b", None), ("c", None)]
    own = spark.createDataFrame([("b", "failed", "e"), ("a", "failed", None), ("c", "completed", ""), ("d", "running", "")], "target string, status string, error string")
    r = state.outcomes(own).first()
    assert (r["succeeded"], r["failed"], [tuple(x) for x in r["failures"]]) == (1, 2, [("a", ""), ("b", "e")])
    every = spark.createDataFrame([("a",), ("zz",)], "target string")
    assert sorted(tuple(r) for r in state.status_counts(own, every).collect()) == [("failed", 1), ("pending", 1)]
    found = spark.createDataFrame([("f",), ("g",), ("g",)], "fingerprint string")
    assert tuple(state.totals(found, found.where("fingerprint = 'g'")).first()) == (3, 1) and tuple(state.totals(found).first()) == (3, 3)


def test_detectors_as_functions(spark):
    own = registry.Detector("even", "Even", "medium", ("n=",), "", find=lambda text: [(i, i + 1, c) for i, c in enumerate(text) if c in "02468"])
    assert [s for _, s, _, _ in scan_text(Plan((own,)), "n=1234")] == ["2", "4"] and not list(scan_text(Plan((own,)), "1234"))
    rows = spark.createDataFrame([("f", "", "n=12")], "file string, commit string, content string")
    assert [(r["detector_id"], r["secret"]) for r in detect(rows, (own,)).collect()] == [("even", "2")]


def test_keywords_with_blanks_must_be_there_with_them():
    own = registry.Detector("d", "D", "medium", ("Bot ",), "x([0-9]{8})")
    assert [s for _, s, _, _ in scan_text(Plan((own,)), "bot x12345678")] == ["12345678"] and not list(scan_text(Plan((own,)), "bots x12345678"))


def test_long_dotted_names(spark):
    """A value of a million parts is judged by columns as by Python; nothing recurses."""
    from pyspark.sql import functions as F

    values = [".".join(["secret"] * 5000), "$" + ".".join(["a"] * 200_000), "%" + ".".join(["a1"] * 200_000) + "%", "config." + "secret." * 9 + "x", "a..b.secret", "password = ${X};", "x;api-key='API_KEY' ", "Pass=${X}", "token=abc;secret=$(x)"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", plausible.reference(F.col("v")).alias("r"), plausible.placeholder(F.col("v")).alias("p")).collect()
    for r in got:
        assert r["r"] == plausible.is_reference(r["v"]) and r["p"] == plausible.has_placeholder_assignment(r["v"]), r["v"][:40]


def test_verifiers_are_of_verifiable_detectors():
    assert set(verifiers(registry.load())) == {d.id for d in registry.load() if d.verifiable}


def test_parity(spark):
    counts = {r["status"]: r["mappings"] for r in state.parity_counts(registry.mappings(spark)).collect()}
    assert counts == {"implemented": 807, "partial": 66, "planned": 2} and registry.catalog(spark).count() == 870
    assert state.parity_outside(registry.catalog(spark), registry.mappings(spark)).count() == 4
