"""The log of a job's transitions."""

import json
import os
import subprocess
from concurrent.futures import ThreadPoolExecutor

import pytest

from leakloom import cli
from leakloom.sources import joblog


def _all(spark, folder):
    return sorted((r["target"], r["status"], r["at"]) for r in joblog.transitions(spark, folder, "j").collect())


def test_an_absent_log(spark, tmp_path):
    assert joblog.states(spark, str(tmp_path / "none"), "j").collect() == [] and joblog.append(str(tmp_path), "j", []) == 0
    assert joblog.compact(spark, str(tmp_path)) == 0
    with pytest.raises(ValueError):
        joblog.read(spark, str(tmp_path), "j")


def test_writers_at_a_time_lose_nothing(spark, tmp_path):
    """Sixteen writers, and compactions beside them: every transition is there once."""
    folder = str(tmp_path / "log")

    def one(k):
        for i in range(10):
            joblog.append(folder, "j", [(f"t{k}", "running", None, 100 * k + i), (f"t{k}", "failed" if i % 2 else "completed", "é\n", 100 * k + i)])
            if k < 2 and i % 5 == 4:
                joblog.compact(spark, folder)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(one, range(16)))
    joblog.append(folder, "other", [("t0", "pending", None, 10**6)])
    want = sorted((f"t{k}", s, 100 * k + i) for k in range(16) for i in range(10) for s in ("running", "failed" if i % 2 else "completed"))
    assert _all(spark, folder) == want
    for _ in range(3):
        joblog.compact(spark, folder, grace=0)
        assert _all(spark, folder) == want
    assert len([n for n in os.listdir(folder) if n[0] in "ts"]) <= 2
    got = joblog.read(spark, folder, "j")
    assert len(got) == 16 and got["t3"] == {"status": "running", "attempts": 10, "error": ""}


def test_files_stay_for_those_that_listed_them(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(3):
        joblog.append(folder, "j", [(f"t{k}", "running", None, k)])
    before = set(os.listdir(folder))
    rows = joblog.transitions(spark, folder, "j")
    assert joblog.compact(spark, folder, now=0.0) == 3 and before <= set(os.listdir(folder))
    assert rows.count() == 3 and len(_all(spark, folder)) == 3
    joblog.append(folder, "j", [("t9", "running", None, 9)])
    joblog.compact(spark, folder, now=joblog.GRACE - 1)
    assert before <= set(os.listdir(folder))
    joblog.compact(spark, folder, now=joblog.GRACE + 1)
    assert not before & set(os.listdir(folder)) and len(_all(spark, folder)) == 4


def test_a_compaction_that_is_lost(spark, tmp_path, monkeypatch):
    """A driver that ends between the snapshot and its mark, or before, leaves every row once."""
    folder = str(tmp_path)
    for k in range(3):
        joblog.append(folder, "j", [(f"t{k}", "running", None, k)])
    want, place = _all(spark, folder), joblog._place

    def dies(at, name, blocks):
        if name.startswith("_holds"):
            raise KeyboardInterrupt
        place(at, name, blocks)

    monkeypatch.setattr(joblog, "_place", dies)
    with pytest.raises(KeyboardInterrupt):
        joblog.compact(spark, folder, grace=0)
    monkeypatch.undo()
    (tmp_path / ".t-draft").write_text('{"id": "half')
    assert _all(spark, folder) == want
    joblog.compact(spark, folder, grace=0)
    joblog.compact(spark, folder, grace=0)
    assert _all(spark, folder) == want


def test_the_command_line_resumes_from_a_log(spark, tmp_path, capsys):
    bad, good, log = "https://github.com/a/bad", "https://github.com/a/good", str(tmp_path / "log")
    asked = []

    def clone(url, place, token):
        asked.append(url)
        if url == bad and len(asked) < 3:
            raise subprocess.CalledProcessError(1, "git")
        os.makedirs(place)
        with open(os.path.join(place, "x.txt"), "w") as f:
            f.write("nothing")

    def run(*more):
        return cli.main(["--target", bad, "--target", good, "--job-log", log, "--format", "json", "--quiet", "--clones", str(tmp_path / f"c{len(asked)}"), *more], spark=spark, clone=clone)

    run("--job-id", "j1")
    got = joblog.read(spark, log, "j1")
    assert (got[bad]["status"], got[good]["status"]) == ("failed", "completed") and got[bad]["error"]
    run("--resume", "j1")
    assert asked == [bad, good, bad] and joblog.read(spark, log, "j1")[bad] == {"status": "completed", "attempts": 2, "error": ""}
    assert not os.path.exists(".leakloom")
    with pytest.raises(ValueError):
        run("--resume", "j2")
    assert json.loads(capsys.readouterr().out.split("\n]}\n")[0] + "\n]}")["findings"] == []
