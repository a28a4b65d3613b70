"""Operator 13. Repeated passages of many words: fixed-block anchors, probed by every rolling window, extended to maximal repeats."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.serializers import BatchedSerializer, CPickleSerializer

from tidemark.llm.common import RUN_BYTES, _plain_scan, mixed, ship, word_hashes, written

#: Words of a window, and of an anchor: any window holds a whole one of the blocks at multiples of the anchor's length.
WINDOW, ANCHOR = 20, 10
#: Bytes of text of a unit, which is what asks and is answered at a time; bytes of text for which there is one owner of hashes.
UNIT_BYTES, OWNER_BYTES = 1 << 20, 24 << 20
#: Keys that an owner sorts at a time.
SLICE_KEYS = 500_000
_SEQ_BITS = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NULL = -(1 << 63)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k consecutive values, a polynomial made of those of 1, 2, 4, .. values. Entry i is of values i to i + k - 1."""
    size, n, power, at = max(0, len(h) - k + 1), 1, int(_ODD), 0
    out, part = np.zeros(size, np.uint64), h
    while True:  # part: of n values, power: the multiplier to the n-th; out: of the first ``at`` values
        if k & n:
            out = out * np.uint64(power) + part[at : at + size]
            at += n
        if n * 2 > k:
            return mixed(out ^ np.uint64(k))
        part = part[:-n] * np.uint64(power) + part[n:] if len(part) > n else part[:0]
        n, power = n * 2, power * power % (1 << 64)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order but for their lowest bits, and the place of each: sorting the place together with the key is several times as fast as sorting places by key."""
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    both = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    return both >> bits, (both & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def _starts(ptr: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether a window of k words that starts at each word lies in one document."""
    whole = np.zeros(max(0, total - k + 1), bool)
    n = np.diff(ptr) - k + 1
    n = np.maximum(n, 0)
    first = np.repeat(ptr[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    whole[first] = True
    return whole


def _runs(texts: list[bytes]):
    """Texts some 256 KB at a time: arrays of bytes take a few dozen times as much."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > RUN_BYTES:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield run


class _Unit:
    """Words of a run of documents: their hashes, and where each document's begin."""

    def __init__(self, texts: list[bytes]):
        parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for run in _runs(texts):
            h, start, _ = word_hashes(b" ".join(run))
            parts.append(h)
            counts.append(np.diff(np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in run]))))
        self.h, self.ptr = np.concatenate(parts), np.cumsum(np.concatenate(counts))

    def probes(self, anchor: int):
        """Distinct hashes of all rolling windows of an anchor's length, whether one of each is a block, and whether it's there twice; and the
        place of each window among them."""
        ok = np.flatnonzero(_starts(self.ptr, anchor, len(self.h)))
        hashes = rolled(self.h, anchor)[ok]
        place = ok - self.ptr[np.searchsorted(self.ptr, ok, "right") - 1]
        ranked, order = ordered(hashes)
        new = np.ones(len(ok), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = np.flatnonzero(new)
        back = np.empty(len(ok), np.int64)
        back[order] = np.cumsum(new) - 1
        if not len(ok):
            return hashes, new, new, ok, back
        block = np.bitwise_or.reduceat((place % anchor == 0)[order], first)
        twice = np.diff(np.append(first, len(ok))) > 1
        return hashes[order[new]], block, twice, ok, back

    def windows(self, window: int, anchor: int, hits: np.ndarray):
        """Of the windows that hold a hit: their starts, two hashes, and the place of each among the distinct ones. hits: by word, whether an anchor
        that starts there is one."""
        whole = _starts(self.ptr, window, len(self.h))
        near = np.concatenate([[0], np.cumsum(hits)])
        at = np.flatnonzero(whole)
        at = at[near[at + window - anchor + 1] > near[at]]
        a, b = rolled(self.h, window)[at], rolled(mixed(self.h ^ np.uint64(0x5851F42D4C957F2D)), window)[at]
        return at, a, b


def _packed(units_of: int):
    """Units of a partition: (unit, pickled documents), a unit's number being its partition's and its place in it."""

    def run(part: int, rows):
        ids, texts, size, seq = [], [], 0, 0
        for doc_id, text in rows:
            ids.append(doc_id)
            texts.append((text or "").encode())
            size += len(texts[-1]) + 8
            if size >= units_of:
                yield (part << _SEQ_BITS) + seq, ids, texts
                ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield (part << _SEQ_BITS) + seq, ids, texts

    return run


def _sent(owner: np.ndarray, owners: int, unit: int, *columns: np.ndarray):
    """Messages (owner, (unit, columns as bytes)) in the columns' order; the first owner always gets one, so that each unit is answered."""
    order, at = _grouped(owner, owners)
    for o in range(owners):
        if at[o + 1] > at[o] or o == 0:
            mine = order[at[o] : at[o + 1]]
            yield o, (unit, *[c[mine].tobytes() for c in columns])


def _grouped(owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by owner, in their order, and where each owner's begin."""
    order = np.argsort(owner.astype(np.uint16) if owners <= 1 << 16 else owner, kind="stable")  # 16 bits are sorted by radix
    return order, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))])


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((mixed(hashes) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _probing(anchor: int, owners: int):
    def run(units):
        for unit, _, texts in units:
            hashes, block, twice, _, _ = _Unit(texts).probes(anchor)
            key = (hashes >> np.uint64(32) & np.uint64(0xFFFFFFFC)).astype(np.uint32) | block.astype(np.uint32) | (twice.astype(np.uint32) << np.uint32(1))
            yield from _sent(_owner(hashes, owners), owners, unit, key)

    return run


def _slices(keys: list[np.ndarray], bits: int):
    """Runs of ascending keys, over equal parts of the keys' space that hold some hundred thousand of them: for each part, from where to where in each run."""
    parts = max(1, -(-sum(map(len, keys)) // SLICE_KEYS))
    at = [np.searchsorted(k, np.array([(i << bits) // parts for i in range(1, parts)], k.dtype)) for k in keys]
    at = [np.concatenate([[0], x, [len(k)]]).astype(np.int64) for x, k in zip(at, keys, strict=True)]
    for i in range(parts):
        yield [slice(int(x[i]), int(x[i + 1])) for x in at]


def _runs_of(ranked: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    new = np.ones(len(ranked) + 1, bool)
    new[1:-1] = ranked[1:] != ranked[:-1]
    return np.flatnonzero(new)


def _anchored(messages):
    """Of each message, which of its hashes are of a block and are found more than once. (unit, (question, owner, bits))"""
    for owner, group in _by_owner(messages):
        keys = [np.frombuffer(m[1], np.uint32) for m in group]
        hits = [np.zeros(len(k), bool) for k in keys]
        for cut in _slices(keys, 32):
            part = np.concatenate([k[c] for k, c in zip(keys, cut, strict=True)])
            if not len(part):
                continue
            order = np.sort((part >> np.uint32(2)).astype(np.uint64) << np.uint64(34) | np.arange(len(part), dtype=np.uint64)) & np.uint64((1 << 34) - 1)
            ranked = part[order.astype(np.int64)]
            runs = _runs_of(ranked >> np.uint32(2))
            flags = np.bitwise_or.reduceat(ranked, runs[:-1])
            found = ((np.diff(runs) > 1) | (flags & np.uint32(2)).astype(bool)) & (flags & np.uint32(1)).astype(bool)
            hit = np.zeros(len(part), bool)
            hit[order.astype(np.int64)] = np.repeat(found, np.diff(runs))
            _dealt_back(hits, cut, hit)
        yield from _answers(0, owner, group, hits)


def _dealt_back(bits: list[np.ndarray], cut: list[slice], part: np.ndarray) -> None:
    at = 0
    for b, c in zip(bits, cut, strict=True):
        b[c] = part[at : at + c.stop - c.start]
        at += c.stop - c.start


def _by_owner(messages):
    groups = defaultdict(list)
    for owner, message in messages:
        groups[owner].append(message)
    while groups:
        yield groups.popitem()


def _answers(asked, owner, group, bits):
    for message, b in zip(group, bits, strict=True):
        yield message[0], (asked, owner, np.packbits(b).tobytes())


def _asking(window: int, anchor: int, owners: int):
    def run(pairs):
        for (unit, ids, texts), (answers, _) in pairs:
            asked = _windows_of(texts, ids, window, anchor, owners, answers)
            _, first, a, b, doc = asked
            extra = (b[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield from _sent(_owner(a[first], owners), owners, unit, a[first], extra, doc[first])

    return run


def _bits(answers: dict, owner: np.ndarray, owners: int) -> np.ndarray:
    """The answers' bits in the order of what was asked."""
    order, at = _grouped(owner, owners)
    out = np.zeros(len(owner), bool)
    for o, raw in answers.items():
        mine = order[at[o] : at[o + 1]]
        out[mine] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(mine)).astype(bool)
    return out


def _windows_of(texts, ids, window, anchor, owners, answers):
    """The unit; where its earliest one of each distinct window near a hit is; the windows' two hashes and their documents' ids, with their starts in the unit."""
    unit = _Unit(texts)
    hashes, _, _, ok, back = unit.probes(anchor)
    hits = np.zeros(len(unit.h), bool)
    hits[ok[_bits(answers, _owner(hashes, owners), owners)[back]]] = True
    unit.at, a, b = unit.windows(window, anchor, hits)
    of = np.searchsorted(unit.ptr, unit.at, "right") - 1
    doc = np.array([_NULL if i is None else i for i in ids], np.int64)[of]
    order = np.lexsort((unit.at, doc, b, a))
    new = np.ones(len(order), bool)
    x, y = a[order], b[order]
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return unit, order[new], a, b, doc


def _earliest(messages):
    """Of each message, which of its windows are found in an earlier place: a smaller id, or of one id in a unit before."""
    for owner, group in _by_owner(messages):
        group.sort(key=lambda m: m[0])
        a, b, doc = ([np.frombuffer(m[k], t) for m in group] for k, t in ((1, np.uint64), (2, np.uint32), (3, np.int64)))
        later = [np.zeros(len(x), bool) for x in a]
        for cut in _slices(a, 64):
            x, y, d = (np.concatenate([k[c] for k, c in zip(column, cut, strict=True)]) for column in (a, b, doc))
            order = np.lexsort((np.repeat(np.arange(len(group)), [c.stop - c.start for c in cut]), d, y, x))
            x, y = x[order], y[order]
            again = np.zeros(len(order), bool)
            again[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            _dealt_back(later, cut, again)
        yield from _answers(1, owner, group, later)


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _removing(window: int, anchor: int, owners: int):
    def run(pairs):
        for (_, ids, texts), (answers, later) in pairs:
            unit, first, a, _, _ = _windows_of(texts, ids, window, anchor, owners, answers)
            repeat = np.ones(len(unit.at), bool)
            repeat[first] = _bits(later, _owner(a[first], owners), owners)
            edge = np.zeros(len(unit.h) + 1, np.int32)
            np.add.at(edge, unit.at[repeat], 1)
            np.add.at(edge, unit.at[repeat] + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                words, spans = text.split(), _spans(covered[unit.ptr[k] : unit.ptr[k + 1]])
                kept, at = [], 0
                for x, y in spans:
                    kept += words[at:x]
                    at = y
                yield doc_id, len(words), spans, b" ".join([*kept, *words[at:]] if spans else words).decode()

    return run


def _back(answers: RDD, parts: int) -> RDD:
    """For each partition of units, the answers to each of its units, in order; one dictionary for each question."""

    def run(rows):
        units = defaultdict(lambda: ({}, {}))
        for unit, (asked, owner, bits) in rows:
            units[unit][asked][owner] = bits
        for unit in sorted(units):
            yield units[unit]

    return answers.partitionBy(parts, lambda unit: unit >> _SEQ_BITS).mapPartitions(run)


def _beside(units: RDD, answers: RDD) -> RDD:
    """Units with their answers, one at a time in memory. Where there are more partitions of answers, empty ones are put behind the units'."""
    more, one = answers.getNumPartitions() - units.getNumPartitions(), BatchedSerializer(CPickleSerializer(), 1)
    return (units.union(units.context.parallelize([], more)) if more else units)._reserialize(one).zip(answers._reserialize(one))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Texts without repeated passages: doc_id, n_words, repeats (spans of words, end exclusive), kept (the other words, joined by a space).

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of 20 words that covers it stands in an earlier place too: in a document of a
    smaller id, or further to the front of its own. Windows are judged on the input.

    1. Blocks of 10 words at multiples of 10 are the anchors; any window of 20 words holds a whole one. Units of documents of some MB send the
       hashes of all rolling windows of 10 words, each distinct one once and marked where it is a block, to the hashes' owners: 4 bytes each.
    2. Owners answer with a bit for each: whether it is a block somewhere and stands in several places. A hash that is mistaken for
       another only brings more to verify. No pair of places is ever formed, however many documents share a passage.
    3. Hits are extended: units send all windows of 20 words that hold one, by 96 bits of two hashes, of equal ones in a unit the earliest, with its
       document's id; owners answer which have an earlier one elsewhere. Consecutive windows that do are a maximal repeat.
    4. Units go over their texts once more and leave the repeats out.

    Texts are never shuffled: each pass reads the documents anew, and answers are dealt back to the partition that asked. A unit is some MB of
    text or one document; an owner gets the hashes of about 24 MB of text. Hot passages send a hash once for each unit.

    Null texts have no words. Ids are integers; a null id comes before all others; rows of one id are taken in the table's order. Repeated rows are documents of
    their own. An empty table gives an empty result; other columns are ignored."""
    if anchor * 2 - 1 > window:
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not _plain_scan(docs):  # partitions must be the same in each pass
        rows, _ = written(rows, "substring-rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES))
    units = rows.rdd.mapPartitionsWithIndex(_packed(UNIT_BYTES))
    parts = units.getNumPartitions()
    same = lambda k: k
    hits = units.mapPartitions(_probing(anchor, owners)).partitionBy(owners, same).mapPartitions(_anchored)
    asked = _beside(units, _back(hits, parts)).mapPartitions(_asking(window, anchor, owners))
    later = asked.partitionBy(owners, same).mapPartitions(_earliest)
    out = _beside(units, _back(hits.union(later), parts)).mapPartitions(_removing(window, anchor, owners))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("repeats", T.ArrayType(span)), T.StructField("kept", T.StringType())])
    return spark.createDataFrame(out, schema, verifySchema=False)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM w, unnest(range(1, len(w) - 18)) AS r(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM f, unnest(range(20)) AS r(k) WHERE again),
g AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM c) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
