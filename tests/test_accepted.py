"""The index of accepted fingerprints."""

import hashlib

import pytest
from pyspark.sql import functions as F

from leakloom import cli
from leakloom.operators import accepted, state
from leakloom.sources import tables


def _prints(spark, first, last):
    return spark.range(first, last).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.col("id").alias("n"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = _prints(spark, 0, 50_000).select("fingerprint")
    odd = spark.createDataFrame([("",), (None,), ("no hash",), ("no hash",)], "fingerprint string")
    return accepted.write(rows.unionByName(odd), str(tmp_path_factory.mktemp("accepted") / "it's"), buckets=8)


@pytest.mark.parametrize("bound", [256 << 20, 0])
def test_findings_that_are_new(spark, index, bound):
    """With the blocks and without, the findings are those of the plain anti-join; repeats, nulls and empty ones stay."""
    odd = spark.createDataFrame([("", 1), (None, 2), (None, 3), ("no hash", 4), ("other", 5), ("other", 5)], "fingerprint string, n long")
    found = _prints(spark, 45_000, 60_000).unionByName(odd)
    got = sorted((r["n"] for r in accepted.without(found, accepted.load(index.folder), bound).collect()))
    assert got == sorted([1, 2, 3, 5, 5, *range(50_000, 60_000)])
    plain = _prints(spark, 0, 50_000).select("fingerprint").unionByName(spark.createDataFrame([("no hash",)], "fingerprint string"))
    assert got == sorted(r["n"] for r in state.without_baseline(found, plain).collect())


def test_blocks_have_every_fingerprint_and_few_others(spark, index):
    assert index.count == 50_001 and index.blocks == 16 and accepted.load(index.folder) == index
    assert accepted.asked(_prints(spark, 0, 50_000), index).where("NOT __may").count() == 0
    assert accepted.asked(_prints(spark, 10**6, 10**6 + 50_000), index).where("__may").count() < 1250  # 2.5 %


def test_the_index_is_not_shuffled(spark, index):
    """What is asked goes on without a shuffle, and the join reads the buckets as they lie: the only shuffle is of findings."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan(accepted.asked(_prints(spark, 0, 9), index))
        found = tables.written(_prints(spark, 0, 9), "few")
        text = plan(accepted.without(found, index, 0))
        assert text.count("Exchange hashpartitioning(fingerprint") == 1 and text.count("Exchange") == 1 and "Bucketed: true" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_empty_index(spark, tmp_path):
    empty = accepted.write(spark.createDataFrame([], "fingerprint string"), str(tmp_path / "none"))
    assert accepted.without(_prints(spark, 0, 5), empty).count() == 5 == accepted.without(_prints(spark, 0, 5), empty, 0).count()
    assert accepted.without(_prints(spark, 0, 0), empty).count() == 0
    assert hashlib.sha256(b"0").hexdigest() == _prints(spark, 0, 1).first()[0]


def test_the_command_line_writes_and_uses_an_index(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    token = "ghp_" + "a1B2" * 9
    (tmp_path / "t" / "a.txt").write_text(token)
    run = lambda *more: cli.main(["--target", str(tmp_path / "t"), "--quiet", "--fail-on-findings", *more], spark=spark)
    assert run("--write-baseline-index", str(tmp_path / "index")) == 2
    assert run("--baseline-index", str(tmp_path / "index")) == 0
    (tmp_path / "t" / "b.txt").write_text(token[:-1] + "9")
    assert run("--baseline-index", str(tmp_path / "index")) == 2
    out = capsys.readouterr().out.splitlines()
    assert [x for x in out if x.endswith(" findings")] == ["1 findings", "0 findings", "1 findings"]
    with pytest.raises(SystemExit):
        run("--baseline-index", str(tmp_path / "index"), "--baseline", str(tmp_path / "x"))
