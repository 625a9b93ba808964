"""Targets as rows, history by ranges of commits, and streams that give a finding once."""

from __future__ import annotations

import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leakloom.operators import registry
from leakloom.plans import scan, targets
from leakloom.sources import archives, files, git
from leakloom.streaming import scan as stream

OWN = tuple(d for d in registry.load() if d.id in ("github-token", "generic-assigned-secret"))
TOKEN = "ghp_" + "a1B2" * 9


def run(repo, *command):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=n@example.com", *command], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Commits on two branches with a merge, renames, a deletion, odd names and an archive."""
    repo = tmp_path_factory.mktemp("repo")
    run(repo, "init", "-q", "-b", "main")
    for k in range(7):
        (repo / f"f{k}.txt").write_text(f"token = {'x' * k}\nghp_{'%036d' % k}\n")
        (repo / "same.env").write_text(f"n = {k}\n{TOKEN}\n")
        run(repo, "add", "."), run(repo, "commit", "-qm", str(k))
    run(repo, "checkout", "-qb", "side", "HEAD~3")
    run(repo, "mv", "f1.txt", "dir with\nbreak.txt"), run(repo, "commit", "-qm", "renamed")
    (repo / "f2.txt").write_text("changed on the side\n" + TOKEN)
    run(repo, "commit", "-qam", "side")
    run(repo, "checkout", "-q", "main"), run(repo, "merge", "-q", "-m", "merged", "-X", "ours", "side")
    run(repo, "rm", "-q", "f0.txt"), run(repo, "commit", "-qm", "deleted")
    return repo


def test_ranges_of_commits_equal_the_log(spark, repository):
    log = sorted(git.changes(str(repository)))
    assert len(log) > 15 and git.commit_count(str(repository)) == 11
    for together in (1, 3, 100):
        assert sorted(map(tuple, git.places(spark, str(repository), together).collect())) == log
    with pytest.raises(RuntimeError):
        git.places(spark, str(repository / "nothing"))


def test_history_in_one_task_equals_the_distributed_one(spark, repository, tmp_path):
    rows = spark.createDataFrame([(str(repository),)], "target string")
    both = targets.found(targets.scan_targets(spark, rows, str(tmp_path), OWN, history=True))
    got = {(r["detector_id"], r["file"], r["commit"], r["line"], r["column"], r["secret"], r["fingerprint"]) for r in both.collect() if r["commit"]}
    want = {(r["detector_id"], r["file"], r["commit"], r["line"], r["column"], r["secret"], r["fingerprint"]) for r in scan.of_history(spark, str(repository), OWN).collect()}
    assert got == want and len(got) > 15


def test_a_thousand_targets_in_one_job(spark, tmp_path):
    places = []
    for k in range(1000):
        place = tmp_path / "t" / str(k)
        (place / "node_modules").mkdir(parents=True)
        (place / "a.env").write_text(f"x\n ghp_{'%036d' % k}\n" * (k % 3))
        (place / "node_modules" / "b.env").write_text(TOKEN)
        (place / "c.png").write_text(TOKEN)
        places.append(str(place))
    single = tmp_path / "one.png"
    single.write_text(TOKEN)
    listed = [*places, places[0], f"  {places[1]} ", "", None, str(tmp_path / "gone"), str(single), "https://github.com/acme/good", "https://github.com/acme/bad"]
    seen = str(tmp_path / "seen")

    def clone(target, into, token=None):
        Path(seen).mkdir(exist_ok=True)
        if target.endswith("bad"):
            raise RuntimeError("no such repository")
        Path(into).mkdir(parents=True)
        (Path(into) / "k.txt").write_text(f"{TOKEN}\n# {token}")

    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    rows = targets.scan_targets(spark, spark.createDataFrame([(t,) for t in listed], "target string"), str(tmp_path / "clones"), OWN, tokens={"acme": "s3cret"}, clone=clone)
    rows.write.parquet(str(tmp_path / "out"))
    jobs = len(tracker.getJobIdsForGroup(None)) - before
    rows = spark.read.parquet(str(tmp_path / "out"))
    ends = {r["target"]: r for r in targets.outcomes(rows).collect()}
    assert len(ends) == 1004 and jobs <= 3
    assert {t for t, r in ends.items() if r["status"] == "failed"} == {str(tmp_path / "gone"), "https://github.com/acme/bad"}
    assert "no such repository" in ends["https://github.com/acme/bad"]["error"]
    assert all(ends[p]["findings"] == min(k % 3, 1) for k, p in enumerate(places))
    assert ends[str(single)]["findings"] == 1 and ends["https://github.com/acme/good"]["findings"] == 1
    assert not list((tmp_path / "clones").glob("*"))
    got = {(r["target"], r["file"], r["line"]) for r in targets.found(rows).collect()}
    assert (places[2], "a.env", 2) in got and ("https://github.com/acme/good", "k.txt", 1) in got
    assert len(got) == sum(min(k % 3, 1) for k in range(1000)) + 2


def test_targets_open_archives(spark, tmp_path):
    import zipfile

    (tmp_path / "t").mkdir()
    with zipfile.ZipFile(tmp_path / "t" / "a.zip", "w") as z:
        z.writestr("in/k.env", TOKEN)
    rows = spark.createDataFrame([(str(tmp_path / "t"),)], "target string")
    assert targets.found(targets.scan_targets(spark, rows, str(tmp_path), OWN)).count() == 0
    assert [r["file"] for r in targets.found(targets.scan_targets(spark, rows, str(tmp_path), OWN, limits=archives.Limits())).collect()] == ["a.zip!/in/k.env"]


def test_path_filters_agree(spark):
    paths = ["a.txt", "a/b.png", "x.zip", "d/e/f.env", "[", "d/x y.md", "A.PNG", "a\nb.txt", "deep/a.txt/c"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    for include, exclude, packed in (([], [], False), (["*.txt", "d/*/f.env"], ["a.*"], True), ([" "], ["[", "?.zip"], True), (["d/*"], [], False)):
        want = {r["path"] for r in table.where(files.allowed(table["path"], include, exclude, packed)).collect()}
        own = files.path_filter(include, exclude, packed)
        assert {p for p in paths if own(p)} == want


def test_a_stream_gives_a_finding_once_over_restarts(spark, tmp_path):
    rows = lambda: spark.readStream.schema("file string, commit string, content string").json(str(tmp_path / "in"))

    def batch(name, *texts):
        spark.createDataFrame([(f, "", t) for f, t in texts], "file string, commit string, content string").write.mode("append").json(str(tmp_path / "in"))
        query = stream.scan(rows(), str(tmp_path / "out"), str(tmp_path / "state"), raw=True)
        query.awaitTermination()
        return sorted((r["file"], r["secret"]) for r in spark.read.json(str(tmp_path / "out")).collect())

    other = "ghp_" + "b2C3" * 9
    assert batch("1", ("a", TOKEN), ("a", f"again {TOKEN}")) == [("a", TOKEN)]
    assert batch("2", ("a", TOKEN), ("b", TOKEN), ("a", other)) == [("a", TOKEN), ("a", other), ("b", TOKEN)]
    assert batch("3", ("a", other)) == [("a", TOKEN), ("a", other), ("b", TOKEN)]


def test_output_without_a_name(spark, tmp_path, monkeypatch):
    from leakloom import cli

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "k.env").write_text(TOKEN)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--target", str(tmp_path / "src"), "--format", "sarif", "--output", "--quiet"], spark) == 0
    assert TOKEN[:4] in (tmp_path / "findings.sarif").read_text()


def test_a_secret_is_asked_for_once_over_runs(spark, tmp_path):
    from leakloom.operators.detect import verify

    log, store = str(tmp_path / "asked"), str(tmp_path / "store")

    def check(secret):
        with open(log, "a") as f:
            f.write(secret + "\n")
        return secret.startswith("live")

    rows = [("d", f"live{k % 5}", k) for k in range(40)] + [("d", "dead", 1), ("e", "live0", 2), ("d", None, 3)]
    found = spark.createDataFrame(rows, "detector_id string, secret string, n int").withColumn("verified", F.lit(False)).repartition(5)
    for run_ in range(2):
        got = {(r["detector_id"], r["secret"], r["n"]): r["verified"] for r in verify(found, {"d": check}, store).collect()}
        assert len(got) == 43 and all(v == (i == "d" and str(s).startswith("live")) for (i, s, _), v in got.items())
        asked = sorted(Path(log).read_text().split())
        # What isn't live is asked for in every run.
        assert asked == sorted([f"live{k}" for k in range(5)] + ["dead"] * (run_ + 1))
    verify(found, {"d": check}, store, max_age="0 seconds").collect()
    assert len(Path(log).read_text().split()) == 7 + 6
    assert not any("live" in r["key"] for r in spark.read.parquet(store).collect())
