"""The index of grams: candidates of a new detector, and findings equal to a full scan."""

import base64
import random
from dataclasses import replace

import pytest

from leakloom.operators import grams, registry
from leakloom.operators.detect import detect, example
from leakloom.sources import files, tables

ODD = [("null", None, None), ("empty", "", b""), ("short", "", b"abc"), ("nul", "", b"ghp_\0" * 9), ("bad", "c", b"\xff\xfe ghp_" + b"a1B2" * 9)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Examples of 200 detectors among other words, some in base64, twice or in a commit."""
    rng, rows = random.Random(3), []
    for k, d in enumerate(registry.load()[::5][:200]):
        words = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(rng.randint(0, 300)))
        text = f"{words}\n{example(d)[0]}\n{words[::-1]}"
        rows.append((f"f{k}", "" if k % 3 else "c1", (base64.b64encode(text[:6000].encode()).decode() if k % 7 == 0 else text).encode("utf-8", "surrogateescape")))
    rows += [*ODD, rows[5], ("é'`", "", rows[3][2])]
    return tables.written(spark.createDataFrame(rows, "file string, commit string, content binary"), "corpus")


def _keys(found):
    return sorted((r["detector_id"], r["file"], r["commit"], r["secret"], r["line"]) for r in found.collect())


def test_findings_equal_a_full_scan(spark, corpus):
    own = tables.written(grams.index(corpus), "grams")
    every = registry.load()
    for some in (every[:40:5], every[500:560:3], every[-15:], tuple(d for d in every if d.id == "github-token")):
        want = _keys(detect(corpus, some))
        assert _keys(grams.rescan(corpus, own, some)) == want
    assert want


def test_candidates_are_few(spark, corpus):
    own = tables.written(grams.index(corpus), "grams")
    assert own.count() == corpus.count() - 2
    few = next((d,) for d in registry.load()[::5] if d.usable_keywords and min(map(len, d.usable_keywords)) > 8)
    assert 1 <= grams.candidates(own, few).count() < 20
    plan = grams.candidates(own, few)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= sum(s in plan.split("ReadSchema")[-1] for s in grams.SLICES) < 16
    short = (replace(few[0], keywords=("pg",)),)
    assert grams.candidates(own, short).count() == grams.candidates(own, (replace(few[0], keywords=()),)).count() == own.count()
    assert grams.candidates(own, ()).count() == 0


def test_chunks_and_columns_have_every_gram(spark):
    data = random.Random(1).randbytes(30_000)
    want = {int.from_bytes(data[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF for i in range(len(data) - 3)}
    size, grams.CHUNK = grams.CHUNK, 1000
    try:
        assert set(grams._hashes(data).tolist()) == want
    finally:
        grams.CHUNK = size
    text = "".join(random.Random(2).choices("abcdefgh 0123é", k=5000))
    own = tables.written(grams.index(spark.createDataFrame([("a", "", text.upper())], "file string, commit string, content string")), "one")
    row = own.first().asDict()
    assert all(grams._has(row[c], place) for lo in range(4990) for c, place in grams._grams(text[lo : lo + 9]))
    assert not any(all(grams._has(row[c], place) for c, place in grams._grams(w)) for w in ("qrstuvw", "zzzzyyy", "nmnmnmnm", "wxyzwxyz"))


def test_only_candidates_are_read(spark, tmp_path):
    token = "ghp_" + "a1B2" * 9
    for k in range(30):
        (tmp_path / f"{k} x.txt").write_text(token if k % 10 == 0 else f"nothing here {k}")
    own = tables.written(grams.index(files.read_folder(spark, str(tmp_path))), "grams")
    some = tuple(d for d in registry.load() if d.id == "github-token")
    listed = tables.written(files.listed(spark, str(tmp_path)).select("path", "file", "commit"), "listed")
    for k in range(30):  # what isn't a candidate may change unseen: it is not opened
        if k % 10:
            (tmp_path / f"{k} x.txt").write_text(token)
    (tmp_path / "20 x.txt").unlink()
    assert sorted(r["file"] for r in grams.rescan_files(listed, own, some).collect()) == ["0 x.txt", "10 x.txt"]
