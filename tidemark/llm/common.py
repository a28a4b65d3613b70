"""Shared plumbing of the training-data operators: the shared folder, written
intermediate tables, and the vectorised word-hash kernel."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a side may have in memory to be broadcast; a side beyond it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that arrays are made of at a time: a worker's memory, and its caches, hold a few dozen times as much.
RUN_BYTES = 1 << 18


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver started, and bound the batches that they get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    # give memory back, but not after each array
    env.update({"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"})
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset and the master is local, as in tests, it is a folder of the session's warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


#: Rows of a task that writes a table of known size.
WRITTEN_ROWS = 50_000


#: Spark's setting that removes a query's shuffle files as soon as it has ended.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, rows: int | None = None, sweep: bool = False) -> tuple[DataFrame, str]:
    """Cut lineage: write ``df`` to the shared folder, and read it back. Returns the table and its path.

    ``rows``: how many narrow rows it has at most, if that is known; few rows are written by few tasks.
    ``sweep``: Spark removes the shuffle files that the write needed when it has ended, not when it collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SWEEP, None)
    if sweep:
        spark.conf.set(_SWEEP, "true")
    try:
        (df if rows is None else df.coalesce(max(1, -(-rows // WRITTEN_ROWS)))).write.parquet(path)
    finally:
        if sweep:
            spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for a broadcast if its rows are measured to take at most so many bytes; else Spark shuffles it.

    A row counts with what a hashed relation holds of it: 64 bytes, 8 a column, and its strings' own bytes."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(64 + 8 * len(df.columns)).cast("long")
    for column in wide:
        size = size + column
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


#: Column of a row's number, which is never null and never repeated.
ROW = "_tidemark_row"
#: Bits of a row's place in its file.
_PLACE_BITS = 38


def _plain_scan(docs: DataFrame) -> bool:
    """Whether a table is Parquet files as they are, each once."""
    plan = docs._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    if "_metadata" in docs.columns or kind(plan) != "LogicalRelation" or kind(plan.relation()) != "HadoopFsRelation" or not kind(plan.relation().fileFormat()).startswith("Parquet"):
        return False
    paths = list(plan.relation().location().inputFiles())
    return len(set(paths)) == len(paths)


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """``docs``, or the given columns of it, with a number for each row, the same in all plans that read it.

    Rows of a plain scan of Parquet files are numbered by their file and their place in it, so that nothing is
    written: the names of the files are all that the driver gets, as it does to plan a scan. Rows of any other plan
    are numbered and written. A column of the number's own name has another one until ``without`` gives it back."""
    renamed = {c: c + "_" * (1 + max(len(x) for x in docs.columns)) for c in docs.columns if c.lower() == ROW}
    kept = columns or [F.col(f"`{c}`").alias(renamed.get(c, c)) for c in docs.columns]
    out = _numbered(docs, kept)
    out._renamed = {} if columns else {new: c for c, new in renamed.items()}
    return out


def _numbered(docs: DataFrame, kept: list[Column] | tuple) -> DataFrame:
    if not _plain_scan(docs):
        return written(docs.select(*kept, F.monotonically_increasing_id().alias(ROW)), "rows")[0]
    spark = docs.sparkSession
    names = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    files = spark.createDataFrame([(name, k << _PLACE_BITS) for k, name in enumerate(names)], "_tidemark_file string, _tidemark_first long")
    placed = docs.select(*kept, F.col("_metadata.file_path").alias("_tidemark_file"), F.col("_metadata.row_index").alias("_tidemark_place"))
    number = (F.col("_tidemark_first") + F.col("_tidemark_place")).alias(ROW)
    return placed.join(small(files), "_tidemark_file").withColumn(ROW, number).drop("_tidemark_file", "_tidemark_first", "_tidemark_place")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of a numbered table whose number isn't in ``dropped`` (a written table of one column), without the number."""
    left = rows.join(small(dropped.select(F.col(dropped.columns[0]).alias(ROW)).distinct()), ROW, "left_anti").drop(ROW)
    return left.withColumnsRenamed(rows._renamed)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


# ---------------------------------------------------------------- word hashes

_rng = np.random.default_rng(20240229)
_MASK = (1 << 64) - 1
_P = int(_rng.integers(1 << 62, 1 << 63)) | 1
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: \x20\x09-\x0D
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the published MurmurHash3 one)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 19)
        for k, p in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"]


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a buffer, and where each starts and ends.

    A polynomial prefix hash over the whole buffer, so that no word is handled on its own."""
    a = np.frombuffer(buffer, np.uint8)
    if not len(a):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = ~_SPACE[a]
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(a, start, end), start, end


def span_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes, by the polynomial prefix hash."""
    up, down = _power(len(a))
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up, out=prefix[1:])
    return mixed((prefix[end] - prefix[start]) * down[start])


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where one of each is, and the place of each value among them."""
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


def hashed(texts: list[bytes | None], limit: int = RUN_BYTES):
    """Over runs of texts of about ``limit`` bytes: (first, last + 1, hashes of lower-cased words, offsets of each text's words)."""
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= limit):
            part.append(texts[j] or b"")
            size += len(part[-1]) + 1
            j += 1
        h, start, _ = word_hashes(b" ".join(part).lower())
        at = np.cumsum([0] + [len(x) + 1 for x in part])
        yield i, j, h, np.searchsorted(start, at)
        i = j


def shingled(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text; with fewer words, the whole sequence as one. Returns them and offsets."""
    n = np.diff(ptr)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(h)) - np.repeat(ptr[:-1], n)
    step, value = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(h), np.uint64)
    full = pos + k <= np.repeat(n, n)
    at = np.flatnonzero(full)
    if len(at):
        v = np.zeros(len(at), np.uint64)
        for i in range(k):
            v = v * step + h[at + i]
        value[at] = mixed(v)
    keep = full.copy()
    for d in np.flatnonzero((n > 0) & (n < k)):
        v = int(n[d])
        for x in h[ptr[d] : ptr[d + 1]]:
            v = (v * int(step) + int(x)) & _MASK
        value[ptr[d]], keep[ptr[d]] = mixed(np.array([v], np.uint64))[0], True
    doc, value = doc[keep], value[keep]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def texts_of(column) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
