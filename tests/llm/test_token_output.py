import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.token_output import BLOCK, CachedEncoder, decode_blocks, encode_blocks, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 40), st.integers(0, 49407), st.integers(0, 2**64 - 1)), max_size=600), st.sampled_from([1, 7, 64, BLOCK]))
def test_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, at = encode_blocks(v, block)
    assert (decode_blocks(words, at) == v).all()
    for b in range(len(at) - 1):  # each block decodes alone
        part = decode_blocks(words[at[b] : at[b + 1]], at[b : b + 2] - at[b])
        assert (part == v[b * block : (b + 1) * block]).all()


def test_packs():
    v = np.random.default_rng(0).integers(0, 1 << 15, 10_000).astype(np.uint64)
    assert len(encode_blocks(v)[0]) <= 10_000 / 4 * 1.02
    assert len(encode_blocks(np.zeros(BLOCK, np.uint64))[0]) < 15


ODD = [
    "", " \t\n", "It's we'LL DON'T 'sx", "a1b22c", "<|endoftext|>x <|startoftext|> <|", "ÀÉÎ straße ÿ × ÷", "é ́a", "漢字 ΑΣ ΟΔΟΣ", "a b c\x1cd\x85e",
    "###%%% $5,000.00 http://x.y/z?q=1", "x" * 3000, "ªº²¼ İ ſ K", "🙂👍🏽", "'" * 50, "don't", "no apostrophe 12,34.5 ### À la carte",
]


def test_encoder_equals_library(spark):
    t = Tokenizer.from_file(PATH)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = CachedEncoder(PATH).encode([x.encode() for x in texts])
    for text, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text[:50]


def test_splitting_is_told_by_the_definition(tmp_path):
    """Not by the file's name; of a tokenizer that is defined otherwise, every text goes to the library."""
    same, other = tmp_path / "a.json", tmp_path / "word_bpe.json"
    text = open(PATH, encoding="utf-8").read()
    same.write_text(text, encoding="utf-8")
    other.write_text(text.replace("[\\\\p{N}]|", "[\\\\p{N}]+|"), encoding="utf-8")
    assert CachedEncoder(str(same)).splits and not CachedEncoder(str(other)).splits and not CachedEncoder(public_tokenizers.path("byte_bpe_50k.json")).splits
    for at in (same, other):
        t = Tokenizer.from_file(str(at))
        for x in ("abc 123,45 x9", "It's 2024!"):
            assert np.frombuffer(CachedEncoder(str(at)).encode([x.encode()])[0], "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


def test_small_cache(monkeypatch):
    monkeypatch.setattr(CachedEncoder, "LIMIT", 50)
    t = Tokenizer.from_file(PATH)
    text = " ".join(f"w{i} word{chr(97 + i % 26)}{i % 7}" for i in range(500))
    assert np.frombuffer(CachedEncoder(PATH).encode([text.encode()])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def expected(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, frame):
    rows = [(5, "hello world"), (None, "null id"), (2, None), (9, "a" * 70_000), (2, "again"), (-3, ""), *[(100 + i, x) for i, x in enumerate(ODD)]]
    segments, _ = write_tokens(frame(rows), PATH)
    got = sorted((tuple(r) for r in read_tokens(segments).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_empty_table(spark, frame, docs_schema):
    segments, _ = write_tokens(spark.createDataFrame([], docs_schema), PATH)
    assert read_tokens(segments).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_whole_table(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts)
    segments, _ = write_tokens(docs, PATH)
    got = sorted((tuple(r) for r in read_tokens(segments).collect()), key=lambda r: r[1])
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
