"""Operator 1. SentencePiece encoding and decoding over a relational lattice."""

from __future__ import annotations

import heapq
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import RUN_BYTES, grouped, mixed, removed, ship, texts_of, written

#: Units (word parts that no piece reaches across) that are sent to the executors as one packed dictionary;
#: rarer ones reach the documents that have them by a join.
DICTIONARY_UNITS = 4_000_000
#: Code points of the longest unit that is folded by Spark.
FOLDED = 60
#: Units of a partition of the lattice, whose groups are kept in a hash table.
LATTICE_UNITS = 8_000

_MARK = "▁"
#: Above any rank.
_NEVER = 1 << 30


class Pieces:
    """The piece table of a model file, and what else an encoder needs of it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces) or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined pieces, a character map, dropped spaces or marks as suffixes aren't supported")
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.rows = [(p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        self.unk = proto.trainer_spec.unk_id
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.bridges = frozenset(p[k : k + 2] for p, _, _ in self.rows for k in range(len(p) - 1))
        if not all(a == _MARK or b != _MARK for a, b in self.bridges):
            raise ValueError("pieces must not span words")
        self.unk_score = min(s for _, _, s in self.rows) - 10
        self.surface = [b"" if p.type == kinds.CONTROL else b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(_MARK, " ").encode() for p in proto.pieces]
        self.kind = "<u2" if len(proto.pieces) <= 1 << 16 else "<u4"

    def marked(self, text: bytes | None) -> str:
        """A text as the model sees it."""
        s = (text or b"").decode().replace(" ", _MARK)
        return _MARK + s if s and self.prefix else s

    def units(self, text: str) -> list[str]:
        """A marked text, cut where no piece has the two characters side by side."""
        cut = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.bridges]
        return [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)] if text else []

    def unknown(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unk]

    def spines(self) -> dict[str, tuple[int, list[int], list[int]]]:
        """Of a BPE model, each piece's rank (0 is best, equal scores share one) and its left and right spine.

        When a piece's characters are merged, the symbol at its left edge grows. left[n - 1] is the rank of the merge that
        ends the symbol of n characters there, _NEVER for the whole piece, -1 if there is no such symbol; right is
        the same at the right edge. Pieces that their own characters don't merge into are left out: they never occur."""
        rank = {score: k for k, score in enumerate(sorted({score for _, _, score in self.rows}, reverse=True))}
        ranks = {p: rank[score] for p, _, score in self.rows}
        out = {}
        for piece in ranks:
            ends, last = list(range(len(piece) + 1)), -1  # boundaries between symbols
            left, right, at_left, at_right = [-1] * len(piece), [-1] * len(piece), 1, 1
            while len(ends) > 2:
                found = [(ranks[piece[a:b]], k) for k, (a, b) in enumerate(zip(ends, ends[2:], strict=False)) if piece[a:b] in ranks]
                if not found:
                    break
                r, k = min(found)
                if r < last:
                    raise ValueError("a piece must be merged from pieces of better scores")
                last = r
                if k == 0:
                    left[at_left - 1], at_left = r, ends[2]
                if k == len(ends) - 3:
                    right[at_right - 1], at_right = r, len(piece) - ends[k]
                del ends[k + 1]
            if len(ends) == 2:
                left[-1] = right[-1] = _NEVER
                out[piece] = ranks[piece], left, right
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The pieces as rows, and one of the empty text."""
        if not self.bpe:
            return spark.createDataFrame([("", 0, 0.0), *self.rows], "piece string, id int, score double")
        ids = {p: i for p, i, _ in self.rows}
        rows = [(p, ids[p], *spine) for p, spine in self.spines().items()]
        return spark.createDataFrame([("", 0, 0, [], []), *rows], "piece string, id int, rank int, left array<int>, right array<int>")


# -------------------------------------------------------------------- lattice


def lattice(units: DataFrame, pieces: Pieces, table: DataFrame) -> DataFrame:
    """Edges of each unit: unit, n, edges; an edge is a piece that covers the code points from i to e (1-based).

    Substrings of bounded length are exploded and joined by equality with the piece table, whose size the
    vocabulary fixes; ``units`` comes partitioned by unit, so the group by unit moves nothing. An edge of a unigram model
    has its score, one of a BPE model its rank and spines."""
    starts = units.select("unit", "n", F.explode(F.sequence(F.lit(1), F.char_length("unit"))).alias("i"))
    # one more, empty substring keeps units of which no substring is a piece
    cut = starts.select("unit", "n", "i", F.explode(F.sequence(F.when(F.col("i") == 1, 0).otherwise(1), F.least(F.lit(pieces.longest), F.char_length("unit") - F.col("i") + 1))).alias("k"))
    found = cut.withColumn("piece", F.expr("substring(unit, i, k)")).join(F.broadcast(table), "piece")
    edge = F.struct((F.col("i") + F.col("k") - 1).alias("e"), "i", "id", *(("rank", "left", "right") if pieces.bpe else ("score",)))
    return found.groupBy("unit").agg(F.first("n").alias("n"), F.collect_list(F.when(F.col("k") > 0, edge)).alias("edges"))


#: Characters that are no piece are edges of id -1.
_LONE = "filter(sequence(1, char_length(unit)), p -> NOT exists(edges, x -> x.i = p AND x.e = p))"


def _viterbi(unk_score: float) -> str:
    """Viterbi of a unigram model: a fold over end positions whose state has, for each, the best total score, and the
    start and id of the last edge."""
    return f"""aggregate(sequence(1, char_length(unit)), array(struct(0.0D AS score, 0 AS i, -1 AS id)), (best, e) -> array_append(best,
        array_max(transform(
          concat(filter(edges, x -> x.e = e), if(exists(edges, x -> x.i = e AND x.e = e), cast(array() AS array<struct<e:int,i:int,id:int,score:double>>), array(struct(e AS e, e AS i, -1 AS id, {unk_score!r}D AS score)))),
          x -> struct(element_at(best, x.i).score + x.score AS score, x.i AS i, x.id AS id)))))"""


def _viterbi_of_pairs() -> str:
    """Viterbi of a BPE model. Merging best first isn't a best sum of scores, but it is a best path whose transitions
    score: pieces A and B may stand side by side, at 0, if merging A's and B's characters together gives A and B again, and
    at minus infinity if not; a text's pieces are the one path of finite score (Berglund and van der Merwe 2023). So of
    all edges that end at a position just one survives, and the fold takes edges by their ends and keeps it.

    A and B meet at a boundary, and are merged across it if some piece c is made of a symbol of A's right spine and one of
    B's left spine while both are there: its rank is better than those of the merges that end them, or as good as
    B's, since of equal scores the leftmost goes first. All such c are edges of the lattice themselves."""
    empty = "cast(array() AS array<int>)"
    every = f"if(size(filter(edges, x -> x.i = x.e)) = char_length(unit), edges, concat(edges, transform({_LONE}, p -> struct(p AS e, p AS i, -1 AS id, 0 AS rank, {empty} AS left, {empty} AS right))))"
    across = "exists(long, c -> c.i < x.i AND c.e >= x.i AND coalesce(get(element_at(best, x.i).right, x.i - c.i - 1), -1) > c.rank AND coalesce(get(x.left, c.e - x.i), -1) >= c.rank)"
    return every, f"""aggregate(ranked, array(struct(0 AS i, -1 AS id, {empty} AS right)), (best, x) ->
        if(size(best) = x.e AND NOT {across}, array_append(best, struct(x.i AS i, x.id AS id, x.right AS right)), best))"""


def folded(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, n and ids: the pieces of each unit, by a Viterbi fold over the lattice's edges, read back from the last position."""
    if pieces.byte:
        first = pieces.byte[0]
        if any(pieces.byte[b] != first + b for b in range(256)):
            raise ValueError("byte pieces must be in order")
        unknown = f"transform(sequence(1, octet_length(substring(unit, t.i, 1))), b -> {first} + cast(conv(substring(hex(encode(substring(unit, t.i, 1), 'UTF-8')), 2 * b - 1, 2), 16, 10) AS int))"
    else:
        unknown = f"array({pieces.unk})"
    if pieces.bpe:
        every, fold = _viterbi_of_pairs()
        edges = edges.withColumn("ranked", F.expr(f"sort_array({every})")).withColumn("long", F.expr("filter(edges, x -> x.i < x.e)"))
        edges = edges.withColumn("best", F.expr(fold))
    else:
        edges = edges.withColumn("best", F.expr(_viterbi(pieces.unk_score)))
    back = """aggregate(sequence(1, char_length(unit)), struct(char_length(unit) AS at, cast(array() AS array<struct<i:int,id:int>>) AS out), (s, n) ->
        if(s.at = 0, s, struct(element_at(best, s.at + 1).i - 1 AS at, array_prepend(s.out, struct(element_at(best, s.at + 1).i AS i, element_at(best, s.at + 1).id AS id)) AS out)), s -> s.out)"""
    spelled = f"if(exists(path, t -> t.id < 0), flatten(transform(path, t -> if(t.id >= 0, array(t.id), {unknown}))), transform(path, t -> t.id))"
    return edges.withColumn("path", F.expr(back)).select("unit", "n", F.expr(spelled).alias("ids"))


def merged_long(unit: str, pieces: Pieces, ids: dict[str, tuple[int, float]]) -> list[int]:
    """The same for a unit of any length, with the edges that can be taken in a heap: n log n."""
    n = len(unit)
    if not pieces.bpe:
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for e in range(1, n + 1):
            options = [(best[s][0] + ids[unit[s:e]][1], s, ids[unit[s:e]][0]) for s in range(max(0, e - pieces.longest), e) if unit[s:e] in ids]
            if unit[e - 1] not in ids:
                options.append((best[e - 1][0] + pieces.unk_score, e - 1, -1))
            best.append(max(options))
        out, at = [], n
        while at:
            _, s, i = best[at]
            out.append([i] if i >= 0 else pieces.unknown(unit[s:at]))
            at = s
        return [i for x in reversed(out) for i in x]
    after, before, end, heap = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), []

    def offer(a: int) -> None:
        b = after[a] if a >= 0 else n
        if a >= 0 and b < n and (found := ids.get(unit[a : end[b]])) is not None:
            heapq.heappush(heap, (-found[1], a, end[a], end[b]))

    for a in range(n):
        offer(a)
    gone = bytearray(n)
    while heap:
        _, a, mid, stop = heapq.heappop(heap)
        b = after[a]
        if gone[a] or end[a] != mid or b >= n or end[b] != stop:
            continue
        gone[b], end[a], after[a] = 1, stop, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(before[a])
        offer(a)
    out, a = [], 0
    while a < n:
        found = ids.get(unit[a : end[a]])
        out += [found[0]] if found else pieces.unknown(unit[a])
        a = after[a]
    return out


# ------------------------------------------------------------------ documents

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_P = 0xA0761D6478BD642F | 1
_powers: list[np.ndarray] = []


class _Cutter:
    """Cuts marked texts into units and hashes them, a run of texts at a time."""

    RUN = RUN_BYTES

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        alphabet = sorted({c for p in pieces.bridges for c in p})  # others never join
        self.size = len(alphabet) + 1
        self.of = np.zeros(0x110000, np.int32)
        self.of[[ord(c) for c in alphabet]] = np.arange(1, self.size)
        self.bridge = np.zeros(self.size * self.size, bool)
        self.bridge[[self.of[ord(p[0])] * self.size + self.of[ord(p[1])] for p in pieces.bridges]] = True

    def hashes(self, text: str, starts: np.ndarray | None = None, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of a text start (or where given, or where texts begin), with the end, and their hashes."""
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if starts is None:
            cls = self.of[a]
            cut = np.ones(len(a), bool)
            cut[1:] = ~self.bridge[cls[:-1].astype(np.int64) * self.size + cls[1:]]
            cut[heads[heads < len(a)]] = True
            starts = np.flatnonzero(cut)
        if not _powers or len(_powers[0]) < len(a) + 1:
            n = max(len(a) + 1, 1 << 19)
            _powers.clear()
            for p in (_P, pow(_P, -1, 1 << 64)):
                x = np.full(n, p, np.uint64)
                x[0] = 1
                _powers.append(np.multiply.accumulate(x))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + _C1) * _powers[0][: len(a)], out=sums[1:])
        at = np.append(starts, len(a))
        return at, mixed((sums[at[1:]] - sums[at[:-1]]) * _powers[1][at[:-1]] ^ np.diff(at).astype(np.uint64) * _C2)

    def unit_hashes(self, units: list[str]) -> np.ndarray:
        at = np.cumsum([0] + [len(u) for u in units])
        return self.hashes("".join(units), at[:-1])[1] if units else np.zeros(0, np.uint64)

    def runs(self, texts: list[bytes | None]):
        """(first, last + 1, marked text, where texts start in it, where units start, their hashes)."""
        i = 0
        while i < len(texts):
            j, size, part = i, 0, []
            while j < len(texts) and (j == i or size + len(texts[j] or b"") <= self.RUN):
                part.append(self.pieces.marked(texts[j]))
                size += len(texts[j] or b"")
                j += 1
            text, head = "".join(part), np.cumsum([0] + [len(x) for x in part])
            yield i, j, text, head, *self.hashes(text, heads=head[:-1])
            i = j


_cutters: dict[str, _Cutter] = {}


def _cutter(model: str) -> _Cutter:
    """One cutter a worker and model. The model file is read where the work is, as are libraries."""
    if model not in _cutters:
        _cutters[model] = _Cutter(Pieces(model))
    return _cutters[model]


def _new_units(model: str):
    """Distinct units of a task's texts that Spark folds; n counts tasks."""

    def run(batches):
        import pyarrow as pa

        cutter, seen = _cutter(model), set()
        for batch in batches:
            found = []
            for _, _, text, _, at, h in cutter.runs(texts_of(batch.column(0))):
                u, k, _ = grouped(h)
                a, b = at[k], at[k + 1]
                short = b - a <= FOLDED
                for x, s, e in zip(u[short].tolist(), a[short].tolist(), b[short].tolist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        found.append(text[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.ones(len(found), np.int64))], names=["unit", "n"])

    return run


def _packed(model: str):
    """Hashes, numbers of ids and ids of a batch's units, each as one binary value."""

    def run(batches):
        import pyarrow as pa

        cutter = _cutter(model)
        for batch in batches:
            units, ids = batch.column(0).to_pylist(), batch.column(1)
            data = ids.flatten().to_numpy(zero_copy_only=False).astype(cutter.pieces.kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([cutter.unit_hashes(units).astype("<u8").tobytes()], pa.binary()), pa.array([np.diff(ids.offsets.to_numpy()).astype("<u2").tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["hash", "n", "ids"])

    return run


class _Dictionary:
    """Ids of units by hash: sorted hashes, and where the ids of each start in a pool, and how many they are."""

    def __init__(self, hashes: np.ndarray, start: np.ndarray, count: np.ndarray, pool: np.ndarray) -> None:
        self.hashes, self.start, self.count, self.pool = hashes, start, count, pool

    @classmethod
    def of(cls, parts: list[tuple[bytes, bytes, bytes]], kind: str) -> _Dictionary:
        h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(p[0], "<u8") for p in parts]])
        n = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(p[1], "<u2") for p in parts]])
        pool = np.frombuffer(b"".join(p[2] for p in parts), kind)
        start = (np.cumsum(n, dtype=np.int64) - n).astype(np.uint32)
        order = np.argsort(h, kind="stable")
        h = h[order]
        if (h[1:] == h[:-1]).any():
            raise RuntimeError("two units of the dictionary have one 64-bit hash")
        return cls(h, start[order], n[order], pool)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and which of them are there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return k, self.hashes[k] == h


class _Encoder:
    def __init__(self, model: str, dictionary: _Dictionary) -> None:
        self.dictionary, self.cutter = dictionary, _cutter(model)
        pieces = self.pieces = self.cutter.pieces
        self.ids = {p: (i, s) for p, i, s in pieces.rows}
        self.width = np.array([len(x) for x in pieces.surface])
        self.begin = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(pieces.surface), np.uint8)

    def missing(self, texts: list[bytes | None]) -> list[tuple[int, str]]:
        """(text, unit) of units that Spark folds and the dictionary doesn't have."""
        out = []
        for i, _, text, head, at, h in self.cutter.runs(texts):
            lost = np.flatnonzero(~self.dictionary.find(h)[1] & (np.diff(at) <= FOLDED))
            out += [(i + int(np.searchsorted(head, at[k], "right")) - 1, text[at[k] : at[k + 1]]) for k in lost.tolist()]
        return list(dict.fromkeys(out))

    def encode(self, texts: list[bytes | None], more: dict[str, list[int]] | None = None):
        """Over runs: (first, last + 1, ids of all, offsets of each text's)."""
        d, kind = self.dictionary, self.pieces.kind
        for i, j, text, head, at, h in self.cutter.runs(texts):
            u, first, back = grouped(h)
            k, hit = d.find(u)
            start, count = (x[k].astype(np.int64) if len(d.hashes) else np.zeros(len(u), np.int64) for x in (d.start, d.count))
            pool, size = [d.pool], len(d.pool)
            for x in np.flatnonzero(~hit).tolist():
                unit = text[at[first[x]] : at[first[x] + 1]]
                ids = merged_long(unit, self.pieces, self.ids) if len(unit) > FOLDED else (more or {}).get(unit)
                if ids is None:
                    raise RuntimeError(f"a unit without pieces: {unit!r}")
                start[x], count[x] = size, len(ids)
                pool.append(np.array(ids, kind))
                size += len(ids)
            pool_ = np.concatenate(pool) if len(pool) > 1 else d.pool
            n, s = count[back], start[back]
            end = np.cumsum(n)
            ids = pool_[np.repeat(s - (end - n), n) + np.arange(end[-1] if len(end) else 0)] if len(n) else np.zeros(0, kind)
            bounds = np.append(0, end)[np.searchsorted(at[:-1], head)]
            if not self.pieces.byte and len(ids):  # the library gives a run of unknown characters of a text one id
                keep = np.append(True, (ids[1:] != self.pieces.unk) | (ids[:-1] != self.pieces.unk))
                keep[bounds[:-1][np.diff(bounds) > 0]] = True
                ids, bounds = ids[keep], np.append(0, np.cumsum(keep))[bounds]
            yield i, j, ids, bounds

    def spell(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and offsets of each text's."""
        n = self.width[ids]
        end = np.cumsum(n)
        data = self.bytes[np.repeat(self.begin[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        return data, np.append(0, end)[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        data, at = self.spell(ids, bounds)
        texts = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [x[1:] if self.pieces.prefix and x[:1] == b" " else x for x in texts]


_encoders: dict = {}


def _encoder(model: str, shared) -> _Encoder:
    """One encoder a worker and dictionary, which is put together here, so that the driver only passes its parts on."""
    name, parts = shared.value
    if (model, name) not in _encoders:
        _encoders.clear()
        _encoders[model, name] = _Encoder(model, _Dictionary.of(parts, _cutter(model).pieces.kind))
    return _encoders[model, name]


def _missing(model: str, shared):
    """Units of each text that the dictionary doesn't have."""

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(model, shared)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = [(keys[k], unit) for k, unit in encoder.missing(texts_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], names=["key", "unit"])

    return run


def _encoded(model: str, shared):
    def run(batches):
        import pyarrow as pa

        encoder = _encoder(model, shared)
        mark = _MARK.encode()
        for batch in batches:
            docs, texts = batch.column(0), texts_of(batch.column(1))
            extra = batch.column(2).to_pylist() if batch.num_columns > 2 else []
            more = {e["unit"]: e["ids"] for x in extra for e in x or ()}
            for i, j, ids, bounds in encoder.encode(texts, more):
                data, at = encoder.spell(ids, bounds)
                want = b"".join((b" " if t and encoder.pieces.prefix else b"") + (t or b"").replace(mark, b" ") for t in texts[i:j])
                if data.tobytes() == want:
                    same = [True] * (j - i)
                else:
                    same = [x == (t or b"").replace(mark, b" ") for x, t in zip(encoder.decode(ids, bounds), texts[i:j], strict=True)]
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs.slice(i, j - i), lists, pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decodes"])

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", dictionary_units: int = DICTIONARY_UNITS) -> DataFrame:
    """Pieces of every whole text: doc_id, ids, n_tokens, ids_crc32 (of little-endian 32-bit ids), decodes.

    1. Distinct units of the corpus: a unit is a stretch of a text that no piece reaches out of, mostly a word part.
    2. Their lattice (see ``lattice``), folded by Viterbi with Spark's higher-order functions: by scores of edges for a
       unigram model, by pairs of edges for a BPE model (see ``_viterbi_of_pairs``).
    3. Ids of units go back to the documents: those of the most widespread ``dictionary_units`` at most as one
       packed dictionary, those of all others by a join with the documents that have them.
    4. Ids are decoded again; ``decodes`` says if that gives the text. It can only differ for control characters
       that the model itself drops; a U+2581 of a text counts as the space that it stands for.

    Null texts are empty and have no ids. Each row is encoded on its own, null and repeated ids included."""
    spark = docs.sparkSession
    ship(spark)
    pieces = Pieces(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = pieces.table(spark)
    units = rows.select("text").mapInArrow(_new_units(model), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units, units_at = written(units, "sp-units")
    total = units.count()
    spread = units.repartition(max(1, -(-total // LATTICE_UNITS)), "unit")
    fallback = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"  # groups of such partitions fit into memory
    before = spark.conf.get(fallback, None)
    spark.conf.set(fallback, str(8 * LATTICE_UNITS))
    try:
        encoded, encoded_at = written(folded(lattice(spread, pieces, table), pieces), "sp-encoded")
    finally:
        spark.conf.set(fallback, before) if before is not None else spark.conf.unset(fallback)
    removed(spark, units_at)
    tail, hot = None, encoded
    if total > dictionary_units:
        sizes = sorted((tuple(r) for r in encoded.select(F.least("n", F.lit(1000)).alias("n")).groupBy("n").count().collect()), reverse=True)
        held, least = 0, 1001
        for n, count in sizes:
            if held + count > dictionary_units:
                break
            held, least = held + count, n
        hot, tail = encoded.filter(F.col("n") >= least), encoded.filter(F.col("n") < least)
    packed = hot.select("unit", "ids").mapInArrow(_packed(model), "hash binary, n binary, ids binary")
    parts = [tuple(bytes(x) for x in r) for r in packed.toLocalIterator()]  # at most ``dictionary_units`` of some 20 bytes each
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, parts))
    del parts
    if tail is None:
        removed(spark, encoded_at)
    else:
        keyed = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.xxhash64("text").cast("string"))))
        lost = keyed.select("key", "text").mapInArrow(_missing(model, shared), "key string, unit string").distinct()
        extra = lost.join(tail, "unit").groupBy("key").agg(F.collect_list(F.struct("unit", "ids")).alias("extra"))
        rows = keyed.join(extra, "key", "left").select("doc_id", "text", "extra")
    return rows.mapInArrow(_encoded(model, shared), "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decodes boolean")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """Texts of ids: doc_id, text. The table of pieces is all it needs; ids that aren't in it are an error."""
    ship(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        none = np.zeros(0, np.int64)
        encoder = _Encoder(model, _Dictionary(none.astype(np.uint64), none, none, none))
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            bounds = np.cumsum([0] + [len(x) for x in lists])
            texts = encoder.decode(np.array([i for x in lists for i in x], np.int64), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(errors="replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, model or public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_crc32", "decodes")
