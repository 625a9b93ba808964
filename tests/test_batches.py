"""What tasks hold and how often a pattern is compiled: bounds that don't follow the session's batches."""

from __future__ import annotations

import io
import weakref
import zipfile

import pyarrow as pa

from leakloom.operators import detect, registry
from leakloom.sources import archives


def _watched(batches, seen):
    """The batches, each one only when those before it are gone."""
    for batch in batches:
        assert all(ref() is None for ref in seen)
        seen.append(weakref.ref(batch))
        yield batch
        del batch


def _batch(*texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def test_detectors_see_many_texts_at_once(monkeypatch):
    plan, calls, found_in = detect.plan_of("one", tuple(d for d in registry.load() if d.id == "github-token")), [], detect.found_in
    monkeypatch.setattr(detect, "found_in", lambda plan, texts: calls.append(len(texts)) or found_in(plan, texts))
    texts = [("lorem ipsum\n" * 80_000) + f" ghp_{k:036d} " for k in range(12)]  # 11 MB: three times what one or two detectors see
    assert [[secret for _, secret, _, _ in x] for x in detect.scan_texts(plan, texts)] == [[f"ghp_{k:036d}"] for k in range(12)]
    assert calls == [12, 12]  # the texts, and what their base64 runs hold


def test_small_batches_are_put_together_for_a_scan():
    batches = [_batch(*(f"{b} {k}" for k in range(100)), None) for b in range(50)]
    (whole,) = detect.gathered(iter(batches), 1)
    assert whole.column(1).to_pylist() == [x for b in batches for x in b.column(1).to_pylist()]
    assert [b.num_rows for b in detect.gathered(iter(batches), 1, 4000)] != [whole.num_rows] and list(detect.gathered(iter([]), 1)) == []


def test_large_batches_are_cut_by_bytes():
    texts = ["x" * 1000, None, "é" * 600, "", "y" * 5000, "z"]
    cut = [b.column(1).to_pylist() for b in detect.cut([_batch(*texts)], 1, 2500)]
    assert cut == [texts[:4], texts[4:5], texts[5:]]


def test_a_task_holds_one_batch():
    seen = []
    rows = list(archives.rows_of(_watched((_batch("a" * k, None) for k in range(4)), seen)))
    assert rows == [x for k in range(4) for x in ((0, "a" * k), (1, None))] and len(seen) == 4


def test_zips_are_packed_from_sorted_rows(spark):
    long = b"lorem ipsum " * 20
    entries = [(f"a{k % 7}.zip", f"{k:04d}.txt", long if k % 2 else b"%d" % k) for k in range(700)]
    frame = spark.createDataFrame(entries, "archive string, name string, content binary").repartition(5)
    packed = {r["file"]: bytes(r["content"]) for r in archives.zipped(frame).collect()}
    again = {r["file"]: bytes(r["content"]) for r in archives.zipped(frame.repartition(3)).collect()}
    assert packed == again and len(packed) == 7  # no time in it: a task that runs again makes the same bytes
    for name, data in packed.items():
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert [(i.filename, z.read(i)) for i in z.infolist()] == [x[1:] for x in entries if x[0] == name]
            assert {i.compress_type for i in z.infolist() if i.file_size > 64} == {zipfile.ZIP_DEFLATED}
            assert {i.compress_type for i in z.infolist() if i.file_size <= 64} == {zipfile.ZIP_STORED}
    assert "Group" not in archives.zipped(frame)._jdf.queryExecution().executedPlan().toString()


def test_what_arrow_holds_of_a_batch_goes_back_before_the_next_one(monkeypatch):
    """Idle workers keep Arrow's pool: a batch of 64 MB stayed with each of them."""
    gone, pool = [], detect.pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            gone.append(len(seen))
            pool.release_unused()

    seen: list = []
    monkeypatch.setattr(detect.pa, "default_memory_pool", Pool)
    for batch in detect.cut([_batch("a", "b"), _batch("c")], 1):
        seen.append(batch)
    assert gone == [1, 2]


def test_spark_sends_small_batches_to_one_or_two_detectors(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        detect.matches(spark.createDataFrame([(1, "x")], "doc_id long, text string"), registry.load()[:1])
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == detect.SENT
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
