import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tidemark.llm.sentence_pieces import Pieces, decode_documents, encode_documents, merged_long

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "   ", "a", " a", "a  b   c", "tab\tand\nline\r\n", "x" * 500, "=" * 300 + " " * 70, "日本語のテキスト, 漢字", "🙂👍🏽 é", "▁ mark ▁▁", "1234567 3.14", "don't stop http://a.b/c?d=e",
    "The quick brown fox JUMPED over", "ſtraße ÀÉ", " trailing ", "null\x00byte", "internationalization" * 9, "the" * 60,
]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces and scores, as a model of the other type."""
    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    at = tmp_path_factory.mktemp("sp") / "unigram.model"
    at.write_bytes(m.SerializeToString())
    return str(at)


def expected(model, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = []
    for i, t in rows:
        ids = sp.encode(t or "")
        out.append((i, ids, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    return sorted(out, key=repr)


def test_library_ids(spark, frame):
    rows = [*enumerate(ODD), (None, "no id"), (3, "again"), *[(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]]
    got = sorted((tuple(r) for r in encode_documents(frame(rows), MODEL).collect()), key=repr)
    for g, e in zip(got, expected(MODEL, rows), strict=True):
        assert g == e


def test_viterbi(spark, frame, unigram):
    """The fold's paths have the best score that any path has (paths may tie)."""
    rows = [x for x in enumerate(ODD) if len(x[1] or "") < 200] + [(100 + i, r.text[:300]) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect())]
    pieces = Pieces(unigram)
    score = {p: s for p, _, s in pieces.rows}
    back = {i: s for _, i, s in pieces.rows}
    for i, ids, n, _, same in encode_documents(frame(rows), unigram).collect():
        text = dict(rows)[i] or ""
        s = ("▁" + text.replace(" ", "▁")) if text else ""
        best = [0.0]
        for e in range(1, len(s) + 1):
            best.append(max(best[a] + score.get(s[a:e], pieces.unk_score if e - a == 1 else -1e18) for a in range(max(0, e - pieces.longest), e)))
        unknown = sum(c not in score for c in s)
        assert same and n == len(ids)
        assert sum(back.get(k, 0.0) for k in ids) + unknown * pieces.unk_score == pytest.approx(best[-1], abs=1e-6)


@pytest.mark.parametrize("units", [0, 3, 40])
def test_tail_join(frame, units):
    rows = [*enumerate(ODD), (None, "no id"), (None, "another without"), (2, "same id")]
    got = sorted((tuple(r) for r in encode_documents(frame(rows), MODEL, dictionary_units=units).collect()), key=repr)
    assert got == expected(MODEL, rows)


def test_decoding(frame):
    rows = [x for x in enumerate(ODD) if "▁" not in (x[1] or "")]
    got = {r.doc_id: r.text for r in decode_documents(encode_documents(frame(rows), MODEL), MODEL).collect()}
    assert got == {i: t or "" for i, t in rows}


def test_long_units():
    pieces, r = Pieces(MODEL), random.Random(2)
    ids = {p: (i, s) for p, i, s in pieces.rows}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(200):
        s = "".join(r.choice("abcdetioné") for _ in range(r.randrange(1, 90)))
        assert merged_long("▁" + s, pieces, ids) == sp.encode(s)
    assert len(merged_long("a" * 50_000, pieces, ids)) > 1000


def test_empty_table(spark, docs_schema):
    assert encode_documents(spark.createDataFrame([], docs_schema), MODEL).collect() == []
