import os

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from leakloom.llm import minhash, packing, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")
def test_pipeline(spark):
    """The stages' decisions, taken again one by one, give the pieces that ``run`` gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 100
    assert minhash.near_duplicates(docs).where("not kept").isEmpty()
    assert secrets.scan(docs).where("size(spans) > 0").isEmpty()
    encode = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    want = {r["doc_id"]: encode.whole(r["text"]) + b"\1\0\0\0" for r in docs.collect()}
    got = {r["doc_id"]: bytes(r["ids"]) for r in packing.unpack(corpus_pipeline.run(spark, SF)).collect()}
    assert got == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties, clashing columns, an empty table; what stays is what plain rules say."""
    from rules import classes, statistics

    words = [f"word{i}" for i in range(60)]
    text = " ".join(words)
    near = " ".join([*words[:30], "changed", *words[31:]]) * 1
    rows = [(1, None), (2, ""), (3, "too short"), (10, text), (11, text), (12, text + " end"), (11, text), (13, near), (None, text), (None, "null id " + text), (14, "same five words again here " * 20), (15, " ".join(reversed(words)) + " token = abcdef123456")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, spans int, row string, kept boolean"
    docs = spark.createDataFrame([(i, x, None, "s", 1, "k", 2, "r", False) for i, x in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left, own = [(i, x) for i, x in rows if (lambda s: s[0] >= 10 and 100 * s[4] <= 20 * s[0])(statistics(x))], docs
    named = classes([(i, x) for i, x in left if i is not None])
    left = [(i, x) for i, x in left if i is None or named[i] == i]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, str(tmp_path))
        assert own.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in own.collect()), key=repr)
    assert got == sorted(((i, x.replace("token = abcdef123456", "[SECRET]")) for i, x in left), key=repr) and {i for i, _ in got} == {None, 10, 15}
    empty = tmp_path / "empty"
    docs.where("false").write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).where("false").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
