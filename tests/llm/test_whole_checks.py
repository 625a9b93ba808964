"""Checks that a query makes of all of its rows."""

from __future__ import annotations

import pytest

pytest.importorskip("leakloom.llm")
pytest.importorskip("public_tokenizers")


def test_op10_holds_every_text_against_the_library(spark, tmp_path, monkeypatch):
    from leakloom.llm import queries, sentencepiece

    spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked, encode = [], sentencepiece.encode
    monkeypatch.setattr(sentencepiece, "encode", lambda *args, **kw: asked.append(kw.get("verify")) or encode(*args, **kw))
    assert queries.op10_sentencepiece(spark, str(tmp_path)).where("round_trip").count() == 40
    assert asked == [1]  # one text in one


TEXTS = ["", " ", "a", "\n", "a \n", " a", "a ", "a  b", "one two\nthree one", "two ▁ one", "日本語 😀 é one", "x" * 100 + " two", "<unk> </s> two", " ".join(f"w{k}" for k in range(2000))]


def _seen(monkeypatch, owner, name):
    """What the method gets from now on."""
    got, method = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda ids, **kw: got.extend(ids) or method(ids, **kw), raising=False)
    return got


class _Proxy:
    def __init__(self, own):
        self.own = own

    def __getattr__(self, name):
        return getattr(self.own, name)


def test_op10_decodes_a_part_once_and_every_text_as_a_whole(monkeypatch):
    import public_tokenizers
    import sentencepiece as library

    from leakloom.llm import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, other = sentencepiece.Codec(path, 2), _Proxy(library.SentencePieceProcessor(model_file=path))
    own.tokenizer = _Proxy(own.tokenizer)
    parts, wholes = _seen(monkeypatch, own.tokenizer, "decode_batch"), _seen(monkeypatch, other, "decode")
    for times in (1, 2, 3):
        found = own.encode(TEXTS)
        assert [x[1] for x in found] == ["▁" not in x for x in TEXTS]
        if times == 1:
            parts.clear()  # of new parts
        own.hold(other, TEXTS, found)
        assert wholes == times * other.encode(TEXTS)
        # long parts are not remembered; the rest of the second and third time was met before
        assert sum(map(len, parts)) <= (times - 1) * len(other.encode("x" * 100))
    own.hold(other, [], [])
    own.hold(other, [""], own.encode([""]))
    for wrong, says in (((found[4][0], True), "library differ"), ((found[8][0], False), "decode otherwise")):
        with pytest.raises(ValueError, match=says):
            own.hold(other, TEXTS, [*found[:8], wrong, *found[9:]])


def test_op10_remembers_parts_that_do_not_come_back(tmp_path):
    import struct

    import sentencepiece as library

    from leakloom.llm import sentencepiece

    def piece(text, score, kind=1):
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    parts = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁", -2.0, 1), ("a", -2.5, 1), ("b", -2.0, 1), ("ab", -2.2, 1)]
    path = tmp_path / "unigram.model"
    path.write_bytes(b"".join(piece(*p) for p in parts) + b"\x12\x02\x18\x01" + b"\x1a\x06\x18\x01\x20\x00\x28\x01")
    own, other = sentencepiece.Codec(str(path), 1), library.SentencePieceProcessor(model_file=str(path))
    texts = ["ab a", "ab z", "b b z a", "a b", "z"]
    for _ in range(2):
        found = own.encode(texts)
        own.hold(other, texts, found)
        assert [x[1] for x in found] == [True, False, False, True, False]
    assert own.lost == {"z"} and set(own.memo) == {"ab", "a", "b", "z"}
