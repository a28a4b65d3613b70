"""Operator 4. MinHash near duplicates by tensored banding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, hashed, mixed, numbered, removed, ship, shingled, small, texts_of, without, written

#: Words of a shingle, least similarity in hundredths, keys of each of the two collections, minhashes of a key.
#: Two sets of similarity 0.8 share a key of a collection with probability 1 - (1 - 0.8^3)^14 > 0.99995.
WORDS, PERCENT, KEYS, HASHES = 4, 80, 14, 3

#: Edges up to which the least neighbours of their nodes are broadcast: at most two nodes an edge, of some 100 bytes.
FEW_EDGES = 150_000

_SIGNATURE = "row long, doc_id long, n_shingles long, cls binary, keys array<long>"


def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 62, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _class_of(value: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes that tell whole shingle sets apart: sums of two independent hashes of all shingles."""
    zero = np.zeros(1, np.uint64)
    sums = [np.diff(np.concatenate([zero, np.cumsum(x)])[at]) for x in (value, mixed(value ^ np.uint64(0x5851F42D4C957F2D)))]
    both = np.stack(sums, 1).astype("<u8").tobytes()
    return [both[16 * i : 16 * i + 16] if at[i + 1] > at[i] else None for i in range(len(at) - 1)]


def _signatures(words: int, keys: int, hashes: int):
    def run(batches):
        import pyarrow as pa

        odd = _odd(2 * keys * hashes)
        for batch in batches:
            rows, ids, texts = batch.column(0), batch.column(1), texts_of(batch.column(2))
            for i, j, h, ptr in hashed(texts):
                value, at = shingled(h, ptr, words)
                n = np.diff(at)
                some = np.flatnonzero(n)
                out = np.zeros((len(n), 2 * keys), np.uint64)
                if len(some):
                    first = at[:-1][some]
                    for k in range(2 * keys):
                        key = np.full(len(some), k + 1, np.uint64)
                        for r in range(hashes):
                            low = np.minimum.reduceat(value * odd[k * hashes + r], first)
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
                        out[some, k] = key
                flat = pa.array(out.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 2 * keys), flat)
                yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(_class_of(value, at), pa.binary()), lists], names=["row", "doc_id", "n_shingles", "cls", "keys"])

    return run


def _sets(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, h, ptr in hashed(texts_of(batch.column(0))):
                value, at = shingled(h, ptr, words)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_class_of(value, at), pa.binary()), lists], names=["cls", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, root), root the smallest node reachable; only nodes with edges.

    Alternating large and small stars (Kiveris et al. 2014); each round is written to the shared folder, and none
    gathers a node's neighbours. Nodes' least neighbours are broadcast while they are few; beyond that both sides of
    their join are read from tables, so that Spark can split a node of many edges."""
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool, few: bool) -> DataFrame:
        """e: (a, b) with b < a. To the least neighbour of each node: its larger neighbours, or itself and its smaller ones."""
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        if few:
            low = F.broadcast(low)
        else:
            low, low_at = written(low, "lowest")
            spent.append(low_at)
        met = e.join(low, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return low.select("a", F.col("m").alias("b")).unionByName(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()

    now, at = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        n = now.count()
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty():
            break
        few, spent = n <= FEW_EDGES, [at]
        half, half_at = written(star(now, True, few), "edges", n)  # stars never add edges
        now, at = written(star(half, False, few), "edges", n)
        removed(spark, *spent, half_at)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots that can reach the similarity; sets: cls, root, shingles.

    Any order of all shingles that is one for all sets will do; here the rarest come first. Two sets of the
    similarity share one of their first n - ceil(percent * n / 100) + 1 shingles (Chaudhuri et al. 2006), and the
    first that they share leaves enough behind it in both (Xiao et al. 2008). So a passage that many texts share
    brings no pairs, as it comes last in each of them."""
    often = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    each = sets.select("cls", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(often, "s")
    ordered = each.groupBy("cls", "root", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o"))
    first = F.expr(f"slice(o, 1, cast(n - ceil({percent} * n / 100) + 1 as int))")
    heads, _ = written(ordered.select("cls", "root", "n", F.posexplode(first).alias("i", "x")).filter("x.f > 1").select("cls", "root", "n", "i", F.col("x.s").alias("s")), "near-heads")
    other = heads.select("s", *[F.col(c).alias(c + "2") for c in ("cls", "root", "n", "i")])
    near = f"cls < cls2 AND root <> root2 AND 100 * least(n, n2) >= {percent} * greatest(n, n2) AND least(n - i, n2 - i2) * {100 + percent} >= {percent} * (n + n2)"
    return heads.join(other, (heads["s"] == other["s"]) & F.expr(near)).select(F.col("cls").alias("a"), F.col("cls2").alias("b")).distinct()


def _near(rows: DataFrame, words: int = WORDS, percent: int = PERCENT, keys: int = KEYS, hashes: int = HASHES) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept_row (null: the row itself) of numbered rows with a doc_id and a text."""
    spark = rows.sparkSession
    ship(spark)
    source = rows.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _ = written(source.mapInArrow(_signatures(words, keys, hashes), _SIGNATURE), "near-signatures")
    classes = rows.filter("cls is not null").groupBy("cls", "n_shingles").agg(F.first("keys").alias("keys"))
    keyed = classes.select("cls", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("k", "v"))
    keyed, keyed_at = written(keyed, "near-keys")
    shared, shared_at = written(keyed.groupBy("k", "v").count().filter("count > 1").select("k", "v"), "near-shared")
    live, live_at = written(keyed.join(small(shared), ["k", "v"]), "near-live")
    left, right = live.filter(F.col("k") < keys), live.filter(F.col("k") >= keys).select("cls", F.col("k").alias("k2"), F.col("v").alias("v2"))
    table = left.join(right, "cls").select("cls", "n", F.xxhash64("k", "k2", "v", "v2").alias("key"))
    low = table.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("low"), F.count(F.lit(1)).alias("several")).filter("several > 1").select("key", F.col("low.cls").alias("low"), F.col("low.n").alias("low_n"))
    table, table_at = written(table.join(low, "key"), "near-table")
    removed(spark, keyed_at, shared_at, live_at)

    wanted, wanted_at = written(table.select("cls").distinct(), "near-wanted")
    members = rows.join(small(wanted), "cls", "left_semi").groupBy("cls").agg(F.min("row").alias("row"))
    members, members_at = written(members, "near-members")
    texts = source.join(small(members.select("row")), "row", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words), "cls binary, shingles array<long>")
    sets, sets_at = written(sets, "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
        same = both.select("a", "b", (F.size("x") + F.size("y")).alias("sum"), F.size(F.array_intersect("x", "y")).alias("same"))
        return same.filter(F.col("same") * 100 >= (F.col("sum") - F.col("same")) * percent).select("a", "b")

    near_size = f"cls <> low AND 100 * least(n, low_n) >= {percent} * greatest(n, low_n)"
    stars, stars_at = written(verified(table.filter(near_size).select(F.col("low").alias("a"), F.col("cls").alias("b")).distinct()), "near-links")
    found, _ = written(components(stars), "near-components")
    placed = table.join(small(found), F.col("cls") == F.col("node"), "left").select("key", "low", "cls", F.coalesce("root", "cls").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    still, still_at = written(placed.join(open_keys, "key", "left_semi").select("cls", "root").distinct(), "near-open")
    links, links_at = written(verified(prefix_pairs(sets.join(small(still), "cls"), percent)), "near-links")
    if not links.isEmpty():
        found, _ = written(components(stars.unionByName(links)), "near-components")
    removed(spark, still_at, table_at, wanted_at, members_at, sets_at, stars_at, links_at)

    roots = rows.select("row", "doc_id", "n_shingles", "cls").join(small(found), F.col("cls") == F.col("node"), "left").select("row", "doc_id", "n_shingles", F.coalesce("root", "cls").alias("root"))
    lowest = roots.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    lowest, _ = written(lowest.select("root", F.col("low.doc_id").alias("low"), F.col("low.row").alias("kept_row")), "near-lowest")
    several = roots.join(small(lowest), "root", "left")
    return several.select("row", "doc_id", "n_shingles", F.when(F.col("kept_row").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"), "kept_row")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, keys: int = KEYS, hashes: int = HASHES) -> DataFrame:
    """Groups of near duplicates: doc_id, n_shingles, component_id, kept.

    1. Every document gets a class (its whole set of shingles; documents of one set are one class, so copies
       are never paired) and two collections of ``keys`` keys of ``hashes`` minhashes each.
    2. A key that a single class has can't bring a pair, so neither can any table key made with it: those go
       first. The others are combined, one from each collection, into keys^2 table keys - as many tables as
       2 * keys * hashes minhashes would give of plain bands only with the square of that work.
    3. Of each bucket, the least class is paired with the others; pairs are verified on full sets. The links
       are closed into components. Classes of buckets that still have several components are paired
       across components by the prefixes of their sets, an exact filter, and verified too, whatever their number.
    4. Components of classes become components of documents.

    No cap: every pair that shares a table key is either verified or already in one component. Documents without
    words (null, empty) have 0 shingles, are linked with nothing and kept. Links are between rows, told apart by a
    row number, so rows that share an id, and rows without one, link by their own texts like all others. A null id
    is never a component's smallest id; if a component has none other, its component_id is null. ``kept`` says that
    the row's id is the component's, so several rows are kept where they share the smallest id, or a null one. Other
    columns are ignored."""
    rows = numbered(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _near(rows, words, percent, keys, hashes).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest doc_id.

    Rows are told apart by a row number, so that null and repeated ids, and rows that are repeated as a whole, lose no
    other row: of rows of one group and one id the first one stays; a null id stays only in a group that has none
    other. Texts without words are in no group and stay. Columns of any name pass."""
    rows = numbered(docs)
    dropped, _ = written(_near(rows).filter("row <> kept_row").select("row"), "near-dropped")
    return without(rows, dropped)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i : i + 3] END AS s
      FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS d, doc_id AS r FROM w UNION SELECT u.b, reach.r FROM reach JOIN u ON u.a = reach.d WHERE reach.r < u.b),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.d = w.doc_id
"""
