"""Operator 8. Benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, hashed, numbered, ship, shingled, texts_of, without, written

#: Words of a shingle, least containment, shingles of the items that one pass over the documents searches for.
WORDS, CONTAINED, BLOCK_SHINGLES = 5, 0.8, 2_000_000
#: Highest probability with which the sketches may miss an item that is contained, and the most bins they may
#: have for each shingle of a document; items for which that isn't enough are looked up by every shingle.
MISS, MOST_BINS = 1e-9, 16
_BITS = 22


def bins_per_shingle(shingles: int, contained: float = CONTAINED) -> float:
    """Bins for each shingle of a document that find an item of so many shingles but for MISS; inf: every shingle.

    A document of u shingles in r * u bins holds 1 / r of them in a bin on average, so that one of the item's
    is the least of its bin with probability r * (1 - exp(-1 / r)); one such match is enough."""
    need = math.ceil(contained * shingles)
    r = 1 / 16
    while r <= MOST_BINS:
        if need * math.log(max(1 - r * (1 - math.exp(-1 / r)), 1e-300)) <= math.log(MISS):
            return r
        r *= 2
    return math.inf


def _sketch(value: np.ndarray, bins_log2: int) -> np.ndarray:
    """One-permutation MinHash of sorted hashes: the least of each bin, a bin being the leading bits."""
    if not len(value):
        return value
    of = value >> np.uint64(64 - bins_log2)
    first = np.ones(len(value), bool)
    first[1:] = of[1:] != of[:-1]
    return value[first]


class _Items:
    """An index of some items: for each size class and each number of bins, sketch value to item."""

    def __init__(self, items: list[tuple[int, np.ndarray]], contained: float) -> None:
        self.contained = contained
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sets = [s for _, s in items]
        self.seen = np.zeros(1 << _BITS, bool)
        self.classes: dict[float, list[int]] = {}
        for k, s in enumerate(self.sets):
            self.seen[(s & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.classes.setdefault(bins_per_shingle(len(s), contained), []).append(k)
        self.tables: dict[tuple[float, int], tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, ratio: float, bins_log2: int) -> tuple[np.ndarray, np.ndarray]:
        if (ratio, bins_log2) not in self.tables:
            parts = [(k, self.sets[k] if math.isinf(ratio) else _sketch(self.sets[k], bins_log2)) for k in self.classes[ratio]]
            value, item = np.concatenate([s for _, s in parts]), np.concatenate([np.full(len(s), k) for k, s in parts])
            order = np.argsort(value, kind="stable")
            self.tables[ratio, bins_log2] = value[order], item[order]
        return self.tables[ratio, bins_log2]

    def search(self, value: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the document has) for all items that the document's set contains."""
        found: set[int] = set()
        size = max(len(value) - 1, 0).bit_length()  # the size partition: documents of at most 2^size shingles
        for ratio in self.classes:
            bins = 0 if math.isinf(ratio) else min(max(1, size + round(math.log2(ratio))), 60)
            keys, item = self._table(ratio, bins)
            mine = value if math.isinf(ratio) else _sketch(value, bins)
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update(item[a:b].tolist())
        out = []
        for k in sorted(found):
            s = self.sets[k]
            at = np.minimum(np.searchsorted(value, s), len(value) - 1)
            same = int((value[at] == s).sum())
            if same >= self.contained * len(s) - 1e-9:
                out.append((int(self.ids[k]), len(s), same))
        return out


def _search(items: list[tuple[int, bytes]], words: int, contained: float):
    def run(batches):
        import pyarrow as pa

        index = _Items([(i, np.frombuffer(s, "<u8")) for i, s in items], contained)
        low = np.uint64((1 << _BITS) - 1)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, j, h, ptr in hashed(texts_of(batch.column(1))):
                value, at = shingled(h, ptr, words)
                hits = np.concatenate([[0], np.cumsum(index.seen[(value & low).astype(np.int64)])])
                for d in np.flatnonzero(hits[at[1:]] > hits[at[:-1]]).tolist():
                    out += [(ids[i + d], *x) for x in index.search(value[at[d] : at[d + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def _item_sets(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, h, ptr in hashed(texts_of(batch.column(1))):
                value, at = shingled(h, ptr, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array([value[at[k] : at[k + 1]].astype("<u8").tobytes() for k in range(j - i)], pa.binary())], names=["item_id", "shingles"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, contained: float = CONTAINED, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Pairs of a document and a test item of whose distinct shingles it has the given part: doc_id, item_id, n_shingles, n_shared, containment.

    Shingles are of ``words`` lower-cased words; a shorter text is one shingle, one without words has none and is
    found nowhere. Documents are partitioned by size, a power of two, and each partition is searched with
    one-permutation sketches of as many bins as its size and the item's ask for; a sketch match is a candidate,
    and each candidate is verified on both full sets. A bit table of fixed size passes over documents that have
    no shingle of any item.

    The items are searched for in blocks of bounded size, each with a pass over all documents, so what is sent
    to the executors doesn't grow with the benchmark. The documents are neither shuffled nor paired with each
    other. Rows of one doc_id or item_id are searched one by one, and equal result rows are given once; rows
    with a null id are ignored on the side of the items and give a null doc_id on the side of documents."""
    spark = docs.sparkSession
    ship(spark)
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null").mapInArrow(_item_sets(words), "item_id long, shingles binary").filter("length(shingles) > 0")
    sets, _ = written(sets.distinct(), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, item_id long, n_shingles long, n_shared long"
    out, block, size = None, [], 0

    def one(found: DataFrame | None) -> DataFrame:
        more = texts.mapInArrow(_search(list(block), words, contained), kinds)
        return more if found is None else found.unionByName(more)

    for row in sets.orderBy("item_id").toLocalIterator():  # a block at a time is held here
        if block and size + len(row["shingles"]) // 8 > block_shingles:
            out, block, size = one(out), [], 0
        block.append((row["item_id"], bytes(row["shingles"])))
        size += len(row["shingles"]) // 8
    out = one(out) if block else out if out is not None else spark.createDataFrame([], kinds)
    return out.distinct().withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a test item.

    Rows are told apart by a row number: of rows that share an id, or have none, just those whose own text is found go,
    and rows that are repeated as a whole go or stay together. Null and empty texts stay. Columns of any name pass."""
    rows = numbered(docs)
    found, _ = written(contaminated(rows, items, ROW).select("doc_id").distinct(), "contaminated")
    return without(rows, found)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH t AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT DISTINCT side, id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
      FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id),
p AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s a JOIN s b ON a.s = b.s WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment FROM p JOIN n ON n.id = item_id WHERE n_shared >= 0.8 * n
"""
