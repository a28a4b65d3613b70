"""Operator 2. Token ids in Simple-8b words, written as segments and read back."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import grouped, ship, span_hashes, texts_of, written

#: Simple-8b (Anh and Moffat 2010): a word is a 4-bit selector over 60 bits of payload.
#: Selector s holds COUNT[s] values of WIDTH[s] bits; 0 and 1 are runs of zeros.
#: Selector 15 is taken by the escape: the next word is one raw 64-bit value.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64])
ESCAPE = 15
#: Ids of a block, each of which starts at a word, and bytes of text of a segment.
BLOCK, SEGMENT_BYTES = 1024, 4 << 20
END_ID = 1
_BITS = np.array([x.bit_length() for x in range(1 << 16)], np.int8)

SEGMENTS = "part int, seq int, ids_before long, n_ids long, doc_ids binary, doc_nulls binary, doc_tokens binary, block_at binary, words binary"


def encode_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the word at which each block starts. All blocks advance together."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    end = np.minimum((np.arange(n) // block + 1) * block, n)
    left = np.minimum(end - np.arange(n), 240).astype(np.uint8)  # values to the end of the block
    bits = np.zeros(n, np.int8)
    if v.max() < 1 << 16:
        bits = _BITS[v.astype(np.uint16)]
    else:
        for b in (32, 16, 8, 4, 2, 1):
            bits[(v >> bits.astype(np.uint64)) >= np.uint64(1 << b)] += b
        bits += v != 0
    # widest[p][i]: the width that the 2^p values from i need; two of them that overlap cover any count
    widest = [bits]
    while 2 ** len(widest) <= 240:
        shift, m = 2 ** (len(widest) - 1), widest[-1].copy()
        np.maximum(m[:-shift], m[shift:], out=m[:-shift])
        widest.append(m)
    choice = np.full(n, ESCAPE, np.int8)
    for s in range(14, -1, -1):  # the selector of most values that fit, and that end in the block, wins
        c, width = int(COUNT[s]), int(WIDTH[s])
        p = c.bit_length() - 1
        rest = c - 2**p
        fits = widest[p] <= width
        if not fits.any():
            break
        if rest:
            fits[:-rest] &= fits[rest:].copy()
        fits &= left >= c
        choice[fits] = s
    step = COUNT[choice]
    starts = np.arange(0, n, block)
    cursor, live, picked = starts.copy(), np.arange(len(starts)), []
    while len(live):
        picked.append(cursor[live])
        cursor[live] += step[cursor[live]]
        live = live[cursor[live] < end[starts[live]]]
    first = np.zeros(n, bool)
    first[np.concatenate(picked)] = True
    pos = np.flatnonzero(first)
    sel = choice[pos]
    size = 1 + (sel == ESCAPE)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(16):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        w = np.full(len(mine), s, np.uint64) << np.uint64(60)
        if s == ESCAPE:
            words[where[mine] + 1] = v[pos[mine]]
        elif WIDTH[s]:
            for i in range(COUNT[s]):
                w |= v[pos[mine] + i] << np.uint64(i * WIDTH[s])
        words[where[mine]] = w
    return words, np.append(where[np.searchsorted(pos, starts)], len(words))


def decode_blocks(words: np.ndarray, block_at: np.ndarray) -> np.ndarray:
    """The values again. Blocks are walked together only for escapes; all else is by selector."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(n, bool)
    if (sel == ESCAPE).any():  # a raw word may look like any other: walk each block's words
        cursor, stop = block_at[:-1].copy(), block_at[1:]
        live = np.flatnonzero(cursor < stop)
        while len(live):
            escaped = sel[cursor[live]] == ESCAPE
            raw[cursor[live][escaped] + 1] = True
            cursor[live] += 1 + escaped
            live = live[cursor[live] < stop[live]]
    held = np.where(raw, 1, np.where(sel == ESCAPE, 0, COUNT[sel]))
    start = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    for s in range(2, 15):
        mine = np.flatnonzero((sel == s) & ~raw)
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        for i in range(COUNT[s] if len(mine) else 0):
            out[start[mine] + i] = (words[mine] >> np.uint64(i * WIDTH[s])) & mask
    out[start[raw]] = words[raw]
    return out


# ------------------------------------------------------------------ tokenizer

#: Texts of these characters only, without an apostrophe (contractions are pieces) or the start of a special token,
#: are split here just as the tokenizer splits them: runs of letters, runs of marks, single digits.
_PLAIN = re.compile("[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_KIND[48:58] = 2
_encoders: dict[str, CachedEncoder] = {}


def _splits_plainly(path: str) -> bool:
    """Whether a tokenizer's own definition says that it lower-cases, drops white space, and models runs of letters,
    single digits and runs of marks on their own, each piece's last token being told by a word end."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (d["normalizer"] or {}).get("normalizers", ())]
    cuts = (d["pre_tokenizer"] or {}).get("pretokenizers", ())
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": _SPLIT} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and d["model"]["type"] == "BPE" and d["model"]["end_of_word_suffix"] == "</w>" and not d["model"]["continuing_subword_prefix"] and not d["model"]["dropout"]
        and not any(t["normalized"] or not t["content"].startswith("<|") for t in d["added_tokens"])
    )


class CachedEncoder:
    """Encodes texts by pieces (as the tokenizer itself splits plain texts) or else by chunks between white
    space, each of which the tokenizers library encodes once.

    The tokenizer must never join characters across ASCII white space; that is so where, as in
    word_bpe_49k.json, white space is dropped before the model. Pieces are told by 64-bit hashes."""

    LIMIT = 400_000
    RUN = 1 << 20

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.chunks: dict[bytes, bytes] = {}
        self.splits = _splits_plainly(path)  # else every text goes to the library by chunks
        self.ends = np.zeros(1 << 17, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if self.splits else ():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        """Empties the piece cache: place of a piece by hash, and where its ids start in the pool, and how many they are."""
        self.place: dict[int, int] = {}
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.kind), 0

    @classmethod
    def of(cls, path: str) -> CachedEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        """Pieces are encoded many at a time; a token that ends a word ends a piece."""
        for i in range(0, len(pieces), 1024):
            some = pieces[i : i + 1024]
            ids = np.array(self._ids([" ".join(some)])[0], np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):
                parts = self._ids(some)
                ids, cut = np.array([x for p in parts for x in p], np.int64), np.cumsum([len(p) for p in parts])
            k = len(self.place)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while k + len(some) > len(self.start):
                self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
            first = np.append(0, cut[:-1])
            self.pool[self.used : self.used + len(ids)] = ids
            self.start[k : k + len(some)], self.count[k : k + len(some)] = first + self.used, cut - first
            self.place.update(zip(hashes[i : i + 1024], range(k, k + len(some)), strict=True))
            self.used += len(ids)

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Texts in Latin-1, lower-cased."""
        a = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        kind = _KIND[a]
        edge = np.ones(len(a), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        at = np.append(np.flatnonzero(edge), len(a))
        real = kind[at[:-1]] != 0
        start, end = at[:-1][real], at[1:][real]
        u, first, back = grouped(span_hashes(a, start, end))
        keys = u.tolist()
        place = list(map(self.place.get, keys))
        gaps, k = [], -1
        for _ in range(place.count(None)):
            k = place.index(None, k + 1)
            gaps.append(k)
        if gaps and len(self.place) + len(gaps) > self.LIMIT:
            self._forget()
            gaps = list(range(len(keys)))
        if gaps:
            raw, where = a.tobytes().decode("latin-1"), first[gaps]
            self._learn([keys[g] for g in gaps], [raw[s:e] for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            place = list(map(self.place.__getitem__, keys))
        p = np.array(place, np.int64)[back]
        n, s = self.count[p], self.start[p]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(s - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        heads = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds = (np.append(0, stop)[np.searchsorted(start, heads)] * self.pool.itemsize).tolist()
        return [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def _chunked(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.chunks)
        if new and len(self.chunks) + len(new) > self.LIMIT:
            self.chunks.clear()
            new = set().union(*words)
        some = sorted(new)
        for c, ids in zip(some, self._ids([c.decode() for c in some]), strict=True):
            self.chunks[c] = np.array(ids, self.kind).tobytes()
        return [b"".join(map(self.chunks.__getitem__, w)) for w in words]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of each text (null: of the empty text), whole."""
        out: dict[int, bytes] = {}
        plain: dict[int, bytes] = {}
        size = 0
        for k, text in enumerate(texts):
            s = (text or b"").decode()
            if self.splits and _PLAIN.fullmatch(s) and "<|" not in s:
                plain[k] = s.lower().encode("latin-1")
                size += len(s)
            else:
                out[k] = self._chunked([text or b""])[0]
            if size > self.RUN:
                out |= zip(plain, self._plain(list(plain.values())), strict=True)
                plain, size = {}, 0
        out |= zip(plain, self._plain(list(plain.values())), strict=True)
        return [out[k] for k in range(len(texts))]


# ------------------------------------------------------------------- segments


def _segments(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = CachedEncoder.of(path)
        end = np.array([end_id], encoder.kind).tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        width = np.dtype(encoder.kind).itemsize

        def segment(ids: list, packed: list[bytes]):
            nonlocal seq, before
            values = np.frombuffer(b"".join(packed), encoder.kind)
            words, at = encode_blocks(values)
            row = {
                "part": [part], "seq": [seq], "ids_before": [before], "n_ids": [len(values)],
                "doc_ids": [np.array([i or 0 for i in ids], "<i8").tobytes()], "doc_nulls": [np.array([i is None for i in ids], np.uint8).tobytes()],
                "doc_tokens": [np.array([len(p) // width for p in packed], "<u4").tobytes()],
                "block_at": [at.astype("<u4").tobytes()], "words": [words.astype("<u8").tobytes()],
            }
            seq, before = seq + 1, before + len(values)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        ids, packed, size = [], [], 0
        for batch in batches:
            column, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for i in range(0, len(texts), 1024):
                for doc, text, p in zip(column[i : i + 1024], texts[i : i + 1024], encoder.encode(texts[i : i + 1024]), strict=True):
                    ids.append(doc)
                    packed.append(p + end)
                    size += len(text or b"") + 8
                    if size >= SEGMENT_BYTES:
                        yield segment(ids, packed)
                        ids, packed, size = [], [], 0
        if ids:
            yield segment(ids, packed)

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Encode every whole text, append ``end_id``, and write the ids in ascending id order.

    The file format: a Parquet table in the shared folder, written under Spark's commit protocol so that a
    lost executor leaves no half file; each row is one self-contained segment of a range partition (part, seq)
    with its documents' ids and token counts, the Simple-8b words of all ids, and for each block of 1024 ids the
    word where it starts. ``part`` and ``seq`` ascend with doc_id; null ids come first and rows of one id are
    ordered by text. Returns the segments as read back, and the path."""
    ship(docs.sparkSession)
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_segments(tokenizer_path, end_id), SEGMENTS), "tokens")


def _documents(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            ids, nulls, n = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_nulls"], np.uint8).astype(bool), np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
            values = decode_blocks(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_at"], "<u4").astype(np.int64)).astype("<u4")
            first = np.cumsum(n) - n
            data = memoryview(values.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + c)]) for a, c in zip(first.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row["part"], np.int32)), pa.array(ids, pa.int64(), mask=nulls), pa.array(first + row["ids_before"]), pa.array(n), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(segments: DataFrame) -> DataFrame:
    """One row for each document of a written token table: doc_id, start, n_tokens, ids_crc32.

    A partition's first offset is a running sum over one row for each partition."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sums.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    rows = segments.mapInArrow(_documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    segments, _ = write_tokens(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(segments)
