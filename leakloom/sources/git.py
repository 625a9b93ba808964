"""Git history: the changed files of all commits, and their objects, read once each.

The driver asks for the number of commits alone. Executors take ranges of them, list each range's changes (commits,
paths and object names, no contents) and later read the objects, one git process at a time, so the clone must be at a path that
they share.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Messages of a clone that may work when tried again, and the seconds between tries.
TRANSIENT = ("timeout", "timed out", "connection reset", "connection refused", "could not resolve host", "early eof", "remote end hung up", "rpc failed", "http 429", "http 502", "http 503", "tls handshake")
WAITS = (1, 4, 9)


def records(data: bytes) -> Iterator[str]:
    yield from (x.decode("utf-8", "surrogateescape") for x in data.split(b"\0") if x)


def parse(parts: Iterable[str], mark: str = "commit:") -> Iterator[tuple[str, str]]:
    """(commit, path) of a log whose commits are marked; one leading newline of a record goes."""
    commit = ""
    for part in parts:
        part = part.removeprefix("\n")
        if part.startswith(mark):
            commit = part[len(mark) :].strip()
        elif part and commit:
            yield commit, part


def parse_raw(parts: Iterable[str], mark: str = "commit:") -> Iterator[tuple[str, str, str]]:
    """(commit, path, oid) of a raw log: after each line of modes, object names and status come a path, or two if it
    was renamed or copied, of which the second one counts. Links and submodules are no files."""
    commit, own, left = "", None, 0
    for part in parts:
        if own is None:
            part = part.lstrip("\n")
        if own is None and part.startswith(mark):
            commit = part[len(mark) :].strip()
        elif own is None and part.startswith(":"):
            own = part[1:].split(" ")
            left = 2 if own[4][:1] in ("R", "C") else 1
        elif own is not None:
            left -= 1
            if not left:
                if own[1].startswith("100") and commit:
                    yield commit, part, own[3]
                own = None


def _records(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The non-empty records of a stream that end with NUL."""
    rest = b""
    while data := stream.read(size):
        *whole, rest = (rest + data).split(b"\0")
        yield from (x for x in whole if x)
    if rest:
        yield rest


def changes(repo: str) -> Iterator[tuple[str, str, str]]:
    """(commit, path, oid) of files that any commit added, changed or renamed, of all references; paths may hold any character."""
    command = ["git", "-C", repo, "log", "--all", "--root", "--diff-filter=AMR", "--raw", "--no-abbrev", "--no-color", "-z", "--format=commit:%H"]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        yield from parse_raw(x.decode("utf-8", "surrogateescape") for x in _records(p.stdout))
        p.stdout.close()
        message = p.stderr.read()
        if p.wait():
            raise RuntimeError(f"git log of {repo} failed: {message.decode('utf-8', 'replace').strip()}")


def blobs(repo: str, oids: Iterable[str], max_bytes: int) -> Iterator[tuple[str, bytes]]:
    """Contents of objects up to a size, from one process."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for oid in oids:
            p.stdin.write(f"{oid}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) != 3:
                continue
            size = int(head[2])
            if head[1] == b"blob" and size <= max_bytes:
                yield oid, p.stdout.read(size)
                p.stdout.read(1)
            else:
                left = size + 1
                while left:
                    left -= len(p.stdout.read(min(left, 1 << 20)))
        p.stdin.close()


def commit_count(repo: str) -> int:
    """How many commits all references reach."""
    done = subprocess.run(["git", "-C", repo, "rev-list", "--all", "--count"], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git rev-list of {repo} failed: {done.stderr.strip()}")
    return int(done.stdout)


def changes_of(repo: str, first: int, many: int) -> Iterator[tuple[str, str, str]]:
    """(commit, path, oid), as ``changes`` has them, of some commits: ``many`` from the ``first`` on in the order of the list."""
    commits = ["git", "-C", repo, "rev-list", "--all", f"--skip={first}", f"--max-count={many}"]
    diffs = ["git", "-C", repo, "diff-tree", "--stdin", "--root", "-r", "-M", "--diff-filter=AMR", "--raw", "--no-abbrev", "-z", "--format=commit:%H"]
    with subprocess.Popen(commits, stdout=subprocess.PIPE) as listed, subprocess.Popen(diffs, stdin=listed.stdout, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        listed.stdout.close()
        yield from parse_raw(x.decode("utf-8", "surrogateescape") for x in _records(p.stdout))
        p.stdout.close()
        message = p.stderr.read()
        if p.wait() or listed.wait():
            raise RuntimeError(f"git diff-tree of {repo} failed: {message.decode('utf-8', 'replace').strip()}")


def places(spark: SparkSession, repo: str, together: int = 2000) -> DataFrame:
    """(commit, path, oid) of a local clone, each (commit, path) once; a task lists the changes of ``together`` commits."""
    n = commit_count(repo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                rows: list[tuple[str, str, str]] = []
                # A commit is in one range only, and has a path once.
                for commit, path, oid in changes_of(repo, first, together):
                    rows.append((commit, path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), oid))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["commit", "path", "oid"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["commit", "path", "oid"])

    ranges = spark.range(0, n, together, max(1, -(-n // together)))
    return ranges.mapInArrow(run, "commit string, path string, oid string")


def objects(spark: SparkSession, repo: str, where: DataFrame, max_bytes: int = 25 << 20) -> DataFrame:
    """(oid, file, commit, content) of each distinct object, under one of its paths."""
    one = where.groupBy("oid").agg(F.min("path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for oid, content in blobs(repo, names, max_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([oid]), pa.array([names[oid]]), pa.array([""]), pa.array([content], pa.binary())], ["oid", "file", "commit", "content"])

    return one.mapInArrow(run, "oid string, file string, commit string, content binary")


def clone_url(target: str, token: str | None) -> str:
    """The address to clone from; a token is only given to the public host over https."""
    from urllib.parse import quote, urlsplit, urlunsplit

    u = urlsplit(target)
    if token and u.scheme == "https" and u.hostname in ("github.com", "www.github.com"):
        return urlunsplit(u._replace(netloc=f"x-access-token:{quote(token, safe='')}@{u.hostname}"))
    return target


def is_transient(message: str) -> bool:
    return any(x in message.lower() for x in TRANSIENT)


def clone(target: str, into: str, token: str | None = None, run=subprocess.run, sleep=None) -> None:
    """Clone a repository, up to four times where the failure may pass; the token never shows in an error."""
    import time

    for wait in (*WAITS, None):
        done = run(["git", "clone", "--quiet", clone_url(target, token), into], capture_output=True, text=True, timeout=3600)
        if not done.returncode:
            return
        message = done.stderr.replace(token, "***") if token else done.stderr
        if wait is None or not is_transient(message):
            raise RuntimeError(f"clone of {target} failed: {message.strip()}")
        (sleep or time.sleep)(wait)
