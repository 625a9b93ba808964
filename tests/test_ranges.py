"""Archives read where they lie, and reports joined from parts."""

import gzip
import io
import json
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from leakloom.operators import registry
from leakloom.plans import scan
from leakloom.sources import archives, ranges, sinks, stores

TOKEN = "ghp_" + "a1B2" * 9


def _zip(entries, method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in entries:
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    """Archives of every kind, nested, damaged, empty, with a name that must be quoted."""
    many = [(f"d/{k}.txt", f"{k} " * (k % 50 + 1)) for k in range(300)]
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name, text in [*many, ("../out", "x"), ("/abs", "y")]:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    damaged = bytearray(_zip(many, zipfile.ZIP_STORED))
    damaged[100:104] = b"\xff\xff\xff\xff"
    contents = {
        "a b%20c.zip": _zip([*many, ("in.zip", _zip([("k.env", TOKEN)])), ("../bad", "z"), ("dir/", "")]),
        "sub/t.tar": tar.getvalue(), "t.tar.gz": gzip.compress(tar.getvalue()), "T.TGZ": gzip.compress(tar.getvalue()),
        "c.txt.gz": gzip.compress(TOKEN.encode()), "cut.zip": _zip(many)[:-30], "hit.zip": bytes(damaged),
        "empty.zip": b"", "none.zip": _zip([]), "plain.txt": TOKEN.encode(), "cut.tar.gz": gzip.compress(tar.getvalue())[:2000],
    }
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path, contents


@pytest.mark.parametrize("limits", [archives.Limits(), archives.Limits(entries=7), archives.Limits(total=900), archives.Limits(entry=40), archives.Limits(depth=0), archives.Limits(entry=40, total=3000, entries=290)])
def test_ranges_equal_whole_archives(spark, folder, limits):
    """Whatever the ranges, the entries are those of an archive that is read as a whole, budgets included."""
    path, contents = folder
    want = sorted(x for name, content in contents.items() for x in archives.expand(name, content, limits))
    listed = spark.createDataFrame([(str(path / n), n) for n in contents if archives.kind(n)] + [(str(path / "gone.zip"), "gone.zip")], "path string, file string")
    for size in (1, 500, 1 << 26):
        got = sorted((r["file"], bytes(r["content"])) for r in ranges.opened(listed, limits, size).collect())
        assert got == [x for x in want if x[0] != "plain.txt"]
    got = sorted((r["file"], bytes(r["content"])) for r in ranges.read_folder(spark, str(path), limits).collect())
    assert got == want


def test_ranges_of_an_archive(spark, folder):
    path, _ = folder
    one = spark.createDataFrame([(str(path / "a b%20c.zip"), "a.zip")], "path string, file string")
    rows = sorted(ranges.ranges(one, size=1000).collect(), key=lambda r: r["first"])
    assert len(rows) > 5 and rows[0]["first"] == 0 and all(a["last"] == b["first"] for a, b in zip(rows, rows[1:])) and rows[-1]["last"] == 303
    assert [tuple(r)[2:4] for r in ranges.ranges(one, archives.Limits(entries=5), 1000).collect()] == [(0, None)]


def test_contents_of_archives_are_never_rows(spark, folder):
    """What lists the archives reads no content."""
    listed = ranges.files.listed(spark, str(folder[0]), archives=True).select("path", "file")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_scans_open_archives_where_they_lie(spark, folder):
    own = tuple(d for d in registry.load() if d.id == "github-token")
    got = {r["file"] for r in scan.of_folder(spark, str(folder[0]), own, limits=archives.Limits()).collect()}
    assert got == {"a b%20c.zip!/in.zip!/k.env", "c.txt.gz!/c.txt", "plain.txt"}
    assert [r["file"] for r in scan.of_folder(spark, str(folder[0] / "c.txt.gz"), own, limits=archives.Limits()).collect()] == ["c.txt.gz!/c.txt"]


def test_an_archive_beyond_a_row(tmp_path):
    """Over 2 GB: a sparse first entry that is stored, then small ones; memory stays bounded by an entry."""
    import resource

    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("large.bin"), "w", force_zip64=True) as f:
            for _ in range(2200):
                f.write(bytes(1 << 20))
        for k in range(100):
            z.writestr(f"{k}.env", TOKEN)
    assert path.stat().st_size > 2 << 30
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with ranges.open_file(str(path)) as source:
        spans = list(ranges._ranges("big.zip", source, archives.Limits(), 1000))
        got = [x for first, last, _ in spans for x in archives.expand_from("big.zip", source, archives.Limits(), 0, first, last)]
    assert len(spans) > 2 and got == [(f"big.zip!/{k}.env", TOKEN.encode()) for k in range(100)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    os.remove(path)


def test_a_store_that_fails_is_no_damaged_archive(folder):
    class Broken(io.BytesIO):
        def read(self, size=-1):
            raise OSError("connection lost")

    with pytest.raises(ranges.ReadFailed):
        list(archives.expand_from("a.tar", ranges._Reads(Broken(b"x" * 1024))))


def _found(spark, n):
    rows = spark.range(n, numPartitions=5).select(
        F.lit("d").alias("detector_id"), F.lit("N\"é").alias("name"), F.lit("high").alias("severity"), F.format_string("f\n%d\\.txt", "id").alias("file"), F.when(F.col("id") % 3 == 0, "c1").when(F.col("id") % 3 == 1, "").alias("commit"),
        F.lit(1).alias("line"), F.lit(2).alias("column"), F.lit("se,cret").alias("secret"), F.lit("s***").alias("redacted"), F.when(F.col("id") % 2 == 0, True).alias("verified"), F.col("id").cast("string").alias("fingerprint"))
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_reports_from_parts(spark, tmp_path, n):
    """Every format is whole, and but for SARIF in the order of the rows, whatever part is empty."""
    found = _found(spark, n).where("id % 7 <> 3") if n == 2 else _found(spark, n)
    rows = found.collect()
    text = {how: b"".join(sinks.report(found, how, {"t": 1})) for how in sinks.FORMATS}
    plain = [{k: v for k, v in (r.asDict() | {"secret": ""}).items() if k != "commit" or v} for r in rows]
    assert json.loads(text["json"]) == {"meta": {"t": 1}, "findings": plain}
    assert [json.loads(x) for x in text["jsonl"].splitlines()] == plain
    run = json.loads(text["sarif"])["runs"][0]
    assert sorted(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]) == sorted(r["file"] for r in rows)
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["d"] * bool(rows) and all(r["level"] == "error" and r["message"]["text"] == 'N"é s***' for r in run["results"])
    lines = text["human"].decode().split("\n")
    assert lines[-2:] == [f"{len(rows)} findings", ""] and len(lines) == len(rows) + 2
    writer = sinks.LineWriter(str(tmp_path / "o.jsonl"), raw=True)
    assert writer.write(found) == len(rows)
    writer.close()
    assert [json.loads(x)["secret"] for x in (tmp_path / "o.jsonl").read_text().splitlines()] == ["se,cret"] * len(rows)


def test_parts_in_order(tmp_path):
    for k in (100000, 2, 10, 99999):
        (tmp_path / f"part-{k:05d}-x-c000.txt").write_text(f"{k}\n")
    (tmp_path / "_SUCCESS").write_text("")
    assert b"".join(stores.blocks(str(tmp_path), 3)) == b"2\n10\n99999\n100000\n"


def test_ranges_that_follow_one_another_read_a_directory_once():
    rows = [("a", "a.zip", 0, 2), ("a", "a.zip", 2, 5), ("a", "a.zip", 7, 9), ("b", "b.zip", 9, 10), ("c", "c.tar", 0, None), ("c", "c.tar", 0, None)]
    assert list(ranges.joined(iter(rows))) == [("a", "a.zip", 0, 5), *rows[2:]] and list(ranges.joined(iter([]))) == []


def test_zips_are_packed_into_files_as_their_rows_come(spark, tmp_path, monkeypatch):
    """The bytes of an archive are in no column; its file has what ``zipped`` has, and only whole files are there."""
    entries = spark.createDataFrame([(f"a{k % 3}.zip", f"{k:04d}.txt", b"x%d" % k * (k % 40)) for k in range(900)], "archive string, name string, content binary").repartition(4)
    monkeypatch.setattr(ranges, "BATCH_RANGES", 2)
    rows = ranges.zip_files(entries, str(tmp_path / "new"))
    assert "content" not in rows.columns
    listed = sorted((r["path"], r["file"]) for r in rows.collect())
    assert listed == [(str(tmp_path / "new" / n), n) for n in sorted(os.listdir(tmp_path / "new"))] and len(listed) == 3
    read = lambda data: [(i.filename, z.read(i)) for z in [zipfile.ZipFile(io.BytesIO(data))] for i in z.infolist()]
    packed = {r["file"]: bytes(r["content"]) for r in archives.zipped(entries).collect()}
    for path, name in listed:
        with open(path, "rb") as f:
            assert read(f.read()) == read(packed[name])
    planned = ranges.ranges(spark.createDataFrame(listed, "path string, file string").coalesce(1), size=1024)
    assert planned.count() > 6 and ranges.opened(planned.select("path", "file").distinct(), size=1024).count() == 900
