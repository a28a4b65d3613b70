"""Joins (J1-J30)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import vectors as V
from tidemark.sources.scratch import cut, shipped
from tidemark.sources.tables import first_by

#: Rows, and bytes in memory, up to which a measured side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _bytes(df: DataFrame) -> Column:
    """About what a row takes in a hashed relation: 64 bytes, 8 a column, strings' bytes and arrays' elements."""
    size = F.lit(64 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map"):
            nested = kind == "map" or f.dataType.elementType.typeName() in ("array", "map", "struct", "string")
            size = size + F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) * (128 if nested else 8)
    return size


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for a broadcast if it has few enough rows and bytes (only rows + 1 of them are measured); else Spark picks the join."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_bytes(df)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= most else df


def with_source(targets: DataFrame, sources: DataFrame | None = None, key: str = "tw_id", ref: str = "tw_src_id") -> DataFrame:
    """Each target with its source's columns as src_*; null where the source is absent. One row a target."""
    src = first_by(targets if sources is None else sources, key)
    return targets.select(*[F.col(c).alias(f"trg_{c}") for c in targets.columns]).join(src.select(*[F.col(c).alias(f"src_{c}") for c in src.columns]), F.col(f"trg_{ref}") == F.col(f"src_{key}"), "left")


def response_pairs(posts: DataFrame) -> DataFrame:
    """Replies and quotes with a source that is known and has text, in time order."""
    both = with_source(posts.filter("tw_type in ('r', 'q')"), posts)
    return both.filter("src_tw_id is not null and trg_txt <> '' and src_txt <> ''").orderBy("trg_tw_datetime", "trg_tw_id")


def with_communities(pairs: DataFrame, communities: DataFrame, keep: str = "all") -> DataFrame:
    """trg_com_id and src_com_id by user; ``keep`` is all or either (a row with a community on some side).

    Community ids that aren't integers are null; a user has the least of several."""
    known = communities.select("usr_id", F.col("community").try_cast("int").alias("com")).filter("com is not null").groupBy("usr_id").agg(F.min("com").alias("com"))
    out = pairs
    for side in ("trg", "src"):
        out = out.join(known.select(F.col("usr_id").alias(f"{side}_usr_id"), F.col("com").alias(f"{side}_com_id")), f"{side}_usr_id", "left")
    return out.filter("trg_com_id is not null or src_com_id is not null") if keep == "either" else out


def of_community(profiles: DataFrame, communities: DataFrame) -> DataFrame:
    """Profiles of the users that have a community, with it."""
    return profiles.join(communities.select("usr_id", F.col("community").alias("com_id")), "usr_id")


def with_tref(posts: DataFrame, table: DataFrame) -> DataFrame:
    """Tref, true for retweets whose source is in the table."""
    known = table.select(F.col("tw_id").alias("tw_src_id")).distinct().withColumn("_there", F.lit(True))
    return posts.join(known, "tw_src_id", "left").withColumn("tref", (F.col("tw_type") == "t") & F.coalesce("_there", F.lit(False))).drop("_there")


def upserted(table: DataFrame, new: DataFrame, key: str, update: str | None = None) -> DataFrame:
    """The table with new keys added; if ``update`` is named, that column takes the new value where there is one."""
    fresh = first_by(new, key)
    if update is not None:
        table = table.join(fresh.select(key, F.col(update).alias("_new")), key, "left").withColumn(update, F.coalesce("_new", update)).select(*table.columns)
    return table.unionByName(fresh.join(table.select(key), key, "left_anti").select(*table.columns))


def user_vectors(vectors: DataFrame, posts: DataFrame, start: str, end: str, at: str = "tw_datetime") -> DataFrame:
    """Vectors of the posts of a time range, with the user. Stamps end with the second: for parts of it, ``at`` names a column of timestamps."""
    return vectors.join(posts.filter(F.col(at).between(start, end)).select("tw_id", "usr_id"), "tw_id")


def in_intervals(points: DataFrame, intervals: DataFrame, at: str, assign: str = "first") -> DataFrame:
    """Points with idx and key of the intervals [start, end] that hold them: the first one, or all; the key is null where none does.

    Intervals are cut into the days that they touch, and a point meets those of its own day: an equi-join, so
    points aren't compared with every interval."""
    days = intervals.select("idx", "key", "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_day"))
    rows = points.withColumn("_row", F.monotonically_increasing_id()).withColumn("_day", F.to_date(F.col(at)))
    inside = F.col(at).between(F.col("start"), F.col("end"))
    if assign == "all":
        return rows.join(bounded(days), (rows["_day"] == days["_day"]) & inside).drop("_day", "_row", "start", "end")
    by_day = days.groupBy("_day").agg(F.sort_array(F.collect_list(F.struct("idx", "key", "start", "end"))).alias("_all"))
    met = rows.join(bounded(by_day), "_day", "left")
    first = F.get(F.filter("_all", lambda i: F.col(at).between(i["start"], i["end"])), F.lit(0))
    return met.withColumn("idx", first["idx"]).withColumn("key", first["key"]).drop("_day", "_row", "_all")


def retweet_presence(retweets: DataFrame, posts: DataFrame) -> DataFrame:
    """not_in_data of a retweet: none, ret (the retweeter's post is missing), reted (the retweeted one's), both."""
    known = posts.select("tw_id").distinct()
    out = retweets
    for col, flag in (("tweet_id", "_a"), ("retweeted_from_tweet_id", "_b")):
        out = out.join(known.select(F.col("tw_id").alias(col), F.lit(True).alias(flag)), col, "left")
    word = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "both").when(F.col("_a").isNull(), "ret").when(F.col("_b").isNull(), "reted").otherwise("none")
    return out.withColumn("not_in_data", word).drop("_a", "_b")


def interaction_edges(posts: DataFrame, users: DataFrame, retweets: DataFrame | None = None) -> DataFrame:
    """tw_id, src, trg, kind of replies and quotes to known posts, and retweets; both ends in ``users``; one edge a post, r before q before t."""
    pairs = with_source(posts, posts).filter("src_usr_id is not null and trg_tw_type in ('r', 'q', 't')").select(F.col("trg_tw_id").alias("tw_id"), F.col("trg_usr_id").alias("src"), F.col("src_usr_id").alias("trg"), F.col("trg_tw_type").alias("kind"))
    edges = pairs if retweets is None else pairs.unionByName(retweets.select("tw_id", "src", "trg", F.lit("t").alias("kind")))
    edges = edges.withColumn("_k", F.when(F.col("kind") == "r", 0).when(F.col("kind") == "q", 1).otherwise(2))
    known = users.select("usr_id").distinct()
    for end in ("src", "trg"):
        edges = edges.join(known.withColumnRenamed("usr_id", end), end, "left_semi")
    return first_by(edges, "tw_id", "_k", "src", "trg").drop("_k")


def tiled_pairs(df: DataFrame, key: str, value: Column, within: str | None = None, diagonal: bool = False, block: int = 256) -> DataFrame:
    """Each pair of rows of one ``within`` value once: w, a, b, x, y with a < b (or a <= b).

    All pairs are what is asked for, so the work is dealt out in tiles: a group's rows are dealt into blocks by a hash,
    as many as the group's own size asks for, and each pair of blocks is one key of an equi-join."""
    w = F.col(within) if within else F.lit(0)
    rows = df.select(w.alias("w"), F.col(key).alias("k"), value.alias("v"))
    sizes = rows.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = rows.join(bounded(sizes), "w").withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = rows.select("w", F.col("k").alias("a"), F.col("v").alias("x"), F.col("i").alias("p"), F.explode(every).alias("q")).filter("p <= q")
    right = rows.select("w", F.col("k").alias("b"), F.col("v").alias("y"), F.col("i").alias("q"), F.explode(every).alias("p")).filter("p <= q")
    order = F.when(F.col("p") < F.col("q"), F.col("a") != F.col("b")).otherwise(F.col("a") <= F.col("b") if diagonal else F.col("a") < F.col("b"))
    pairs = left.join(right, ["w", "p", "q"]).filter(order)
    turned = F.col("a") > F.col("b")
    side = lambda one, two: F.when(turned, F.col(two)).otherwise(F.col(one))
    return pairs.select("w", side("a", "b").alias("a"), side("b", "a").alias("b"), side("x", "y").alias("x"), side("y", "x").alias("y"))


#: Rows of a strip whose pairs are all handed out at once, of a side of a tile of which only sums are, and of one that is handed out by strips.
PAIR_ROWS, SUM_ROWS, SENT_ROWS = 1024, 4096, 8192


def tile_sides(rows: DataFrame, block: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The two sides (w, p, q, k, ...) of all pairs of blocks p <= q of each group, to be cogrouped by w, p, q. Rows are (w, k, ...); those of a
    key stay together.

    A group has a block for each ``block`` keys; a small one has up to 8, of no fewer than ``least`` keys, so that several tasks have work."""
    n = F.col("n")
    blocks = F.greatest(F.ceil(n / block), F.least(F.lit(8), F.floor(n / least)), F.lit(1)).cast("long")
    rows = rows.filter("w is not null and k is not null")
    sizes = rows.select("w", "k").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("w", blocks.alias("blocks"))
    dealt = rows.join(bounded(sizes), "w").withColumn("at", F.pmod(F.xxhash64("k"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    values = [c for c in rows.columns if c != "w"]
    left = dealt.select("w", F.col("at").alias("p"), F.explode(F.filter(every, lambda q: q >= F.col("at"))).alias("q"), *values)
    right = dealt.select("w", F.explode(F.filter(every, lambda p: p <= F.col("at"))).alias("p"), F.col("at").alias("q"), *values)
    return left, right.toDF(*left.columns)


def one_group(left: DataFrame, right: DataFrame):
    """The two sides of ``tile_sides`` as one grouped table, for functions that go through a tile by parts; ``two_sides`` tells them apart."""
    return left.withColumn("_side", F.lit(False)).unionByName(right.withColumn("_side", F.lit(True))).groupBy("w", "p", "q")


def two_sides(batches: Iterator) -> tuple:
    table = pa.Table.from_batches(list(batches))
    left, right = (table.filter(side).drop_columns("_side") for side in (pc.invert(table["_side"]), table["_side"]))
    return left, right


def _by_length(column) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """Vectors of a column of arrays by their length: places and matrix; and the number of rows. Missing ones are left out."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(flat), -1).to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    found = {}
    for size in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == size)
        found[size] = at, values[starts[at][:, None] + np.arange(size)[None, :]].astype(float)
    return found, len(flat)


def block_values(left, right, one: Callable[[np.ndarray, np.ndarray], np.ndarray], missing: float) -> np.ndarray:
    """Values of each row of a block with each of another: ``one`` of two matrices; ``missing`` where a vector is, or two lengths differ."""
    (x, n), (y, m) = _by_length(left), _by_length(right)
    out = np.full((n, m), missing)
    for size, (i, a) in x.items():
        if size in y:
            j, b = y[size]
            if len(i) == n and len(j) == m:
                return one(a, b)
            out[np.ix_(i, j)] = one(a, b)
    return out


def _later(left, right, diagonal: bool) -> np.ndarray:
    """Of a block with itself: where the left key is before the right one (or is it)."""
    keys = pc.rank(pa.concat_arrays([left["k"].combine_chunks(), right["k"].combine_chunks()]), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = keys[: len(left)], keys[len(left) :]
    return a[:, None] <= b[None, :] if diagonal else a[:, None] < b[None, :]


def block_pairs(rows: DataFrame, one: Callable[[np.ndarray, np.ndarray], np.ndarray], missing: float, block: int | None = None, diagonal: bool = False, least: float | None = None) -> DataFrame:
    """Each pair of rows (w, k, v) of one w once: (w, a, b, value) with a < b (or a <= b), of values that reach ``least``; NaN is null.

    As in ``tiled_pairs`` the work is dealt out in tiles, pairs of blocks, of many rows, as each row is sent to all tiles of its block. A task goes
    through a tile strip by strip: the values of two strips are one operation on two matrices, and handed out before the next."""
    block = block or SENT_ROWS
    kinds = dict(rows.dtypes)

    def tile(w, left, right, same: bool):
        value = block_values(left["v"], right["v"], one, missing)
        hit = _later(left, right, diagonal) if same else None
        if least is not None:
            with np.errstate(invalid="ignore"):
                hit = value >= least if hit is None else hit & (value >= least)
        i, j = np.nonzero(hit) if hit is not None else (np.repeat(np.arange(value.shape[0], dtype=np.int32), value.shape[1]), np.tile(np.arange(value.shape[1], dtype=np.int32), value.shape[0]))
        picked = value[hit] if hit is not None else value.ravel()
        a, b = left["k"].combine_chunks().take(pa.array(i)), right["k"].combine_chunks().take(pa.array(j))
        return pa.table([pa.repeat(w, len(picked)), a, b, pa.array(picked, from_pandas=True)], names=["w", "a", "b", "value"])

    strip = min(block, PAIR_ROWS)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = two_sides(batches)
        for at in range(0, len(left), strip):
            for to in range(0, len(right), strip):
                yield from tile(key[0], left.slice(at, strip), right.slice(to, strip), key[1].as_py() == key[2].as_py()).combine_chunks().to_batches()

    left, right = tile_sides(shipped(rows), block, 128)
    pairs = one_group(left, right).applyInArrow(run, f"w {kinds['w']}, a {kinds['k']}, b {kinds['k']}, value double")
    return pairs.select("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")


def vector_rows(df: DataFrame, key: str, value: Column, within: str | None) -> DataFrame:
    """(w, k, v); a vector with a missing element is missing."""
    rows = df.select((F.col(within) if within else F.lit(0)).alias("w"), F.col(key).alias("k"), value.alias("v"))
    return rows.withColumn("v", F.when(~F.exists("v", lambda x: x.isNull()), F.col("v")))


def similar_pairs(df: DataFrame, key: str, vec: str, within: str | None = None, least: float | None = None, diagonal: bool = False, block: int | None = None) -> DataFrame:
    """Cosine of all pairs of rows (of one ``within`` value): a, b, similarity; a < b, or a <= b.

    A zero or missing vector has similarity 0. A tile of two blocks is a product of two matrices."""
    pairs = block_pairs(vector_rows(df, key, V.unit(F.col(vec)), within), products, 0.0, block, diagonal, least)
    return pairs.select(*([F.col("w").alias(within)] if within else []), "a", "b", F.col("value").alias("similarity"))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def similarity_sums(df: DataFrame, key: str, vec: str, within: str | None = None, block: int = SUM_ROWS) -> DataFrame:
    """(w, pairs, total): number and sum of the cosines of all pairs of rows of one ``within`` value, summed up tile by tile, so that no pair becomes a row."""
    rows = vector_rows(df, key, V.unit(F.col(vec)), within)

    def run(key, left, right):
        same, n, total = key[1].as_py() == key[2].as_py(), 0, 0.0
        for at in range(0, len(left), 1024):  # a strip of the tile at a time
            strip = left.slice(at, 1024)
            value = block_values(strip["v"], right["v"], products, 0.0)
            hit = _later(strip, right, False) if same else None
            n += value.size if hit is None else int(hit.sum())
            total += float(value.sum() if hit is None else value[hit].sum())
        return pa.table([pa.repeat(key[0], 1), pa.array([n], pa.int64()), pa.array([total])], names=["w", "pairs", "total"])

    left, right = tile_sides(shipped(rows), block, 128)
    tiles = left.groupBy("w", "p", "q").cogroup(right.groupBy("w", "p", "q")).applyInArrow(run, f"w {dict(rows.dtypes)['w']}, pairs long, total double")
    return tiles.groupBy("w").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def graph_pair_similarity(edges: DataFrame, vectors: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """Similarity of the undirected pairs of a graph; a missing vector gives 0."""
    pairs = edges.filter("src <> trg").select(F.least("src", "trg").alias("src"), F.greatest("src", "trg").alias("trg")).distinct()
    side = lambda e, v: vectors.select(F.col(key).alias(e), F.col(vec).alias(v))
    return pairs.join(side("src", "x"), "src", "left").join(side("trg", "y"), "trg", "left").select("src", "trg", V.cosine(F.col("x"), F.col("y"), 0.0).alias("weight"))


def matched_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Values of the same pair in two tables (key, similarity) and (key, distance): a missing similarity is 0, a missing distance 1, and either is flagged."""
    out = left.join(right, key, "full")
    return out.select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("distance", F.lit(1.0)).alias("distance"), (F.col("similarity").isNull() | F.col("distance").isNull()).alias("incomplete"))


def nearest_centre(rows: DataFrame, centres: DataFrame, vec: str = "vec", least: float | None = None) -> DataFrame:
    """Rows with cid and similarity of the nearest centre by cosine; ties go to the lowest cid. Below ``least`` the cid is null.

    Centres are a fixed few (a model's parameters): they travel as one array, and each row looks through it."""
    table = centres.agg(F.sort_array(F.collect_list(F.struct("cid", V.unit(F.col("cvec")).alias("cvec")))).alias("_centres"))
    best = F.array_max(F.transform("_centres", lambda c: F.struct(F.coalesce(V.dot(F.col(vec), c["cvec"]), F.lit(0.0)).alias("product"), (-c["cid"]).alias("minus"))))
    size = V.norm(F.col(vec))
    out = rows.join(bounded(table)).withColumn("_best", best).withColumn("similarity", F.when(size > 0, F.col("_best.product") / size).otherwise(F.lit(0.0))).withColumn("cid", -F.col("_best.minus")).drop("_best", "_centres")
    return out.withColumn("cid", F.when(F.col("similarity") >= least, F.col("cid"))) if least is not None else out


def centre_products(rows: DataFrame, centres: DataFrame, key: str, vec: str = "vec", threshold: float | None = None) -> DataFrame:
    """V9: (key, products): products with each centre in the order of cid; below a threshold (none by default) they are 0."""
    table = centres.agg(F.sort_array(F.collect_list(F.struct("cid", "cvec"))).alias("_centres"))
    product = lambda c: V.dot(F.col(vec), c["cvec"])
    value = product if threshold is None else (lambda c: F.when(product(c) >= threshold, product(c)).otherwise(F.lit(0.0)))
    return rows.join(bounded(table)).select(key, F.transform("_centres", value).alias("products"))


def propagated_vectors(posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """V5: (tw_id, vec): a post's own vector, or, of a retweet without one, its source's."""
    own = posts.join(vectors.select("tw_id", "vec"), "tw_id", "left")
    source = vectors.select(F.col("tw_id").alias("tw_src_id"), F.col("vec").alias("_src"))
    return own.join(source, "tw_src_id", "left").select("tw_id", F.coalesce("vec", F.when(F.col("tw_type") == "t", F.col("_src"))).alias("vec")).filter("vec is not null")


def with_ids(phrases: DataFrame, known: DataFrame, key: str = "phrase", ident: str = "phid") -> DataFrame:
    """(phrase, id): known phrases keep theirs, new ones get the next in the order of the phrase.

    Numbers come from a count by range partition, not from one sorted task."""
    rows = phrases.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key, ident), key, "left")
    top = known.agg(F.coalesce(F.max(ident), F.lit(-1))).first()[0]
    new = numbered(rows.filter(F.col(ident).isNull()).select(key), key, ident, top + 1)
    return rows.filter(F.col(ident).isNotNull()).unionByName(new)


def numbered(df: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """Rows numbered without gaps in the order of a column."""
    return placed(df, [F.asc(order)], name).withColumn(name, F.col(name) + (first - 1))


def placed(df: DataFrame, order: Sequence[Column], name: str, weight: str | None = None) -> DataFrame:
    """Rows with the running sum of a weight (or their number, from 1) in an order that no two rows tie in, or whose ties may stand either way."""
    return running_sums(df, order, {name: weight})


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str | None]) -> DataFrame:
    """Rows with running sums by name, each of a column (None: of 1), in an order that no two rows tie in, or whose ties may stand either way.

    Rows are dealt into range partitions and written once, so that both the sums of whole partitions and the sums within
    them see the same partitions, however the two plans are pruned; none is sorted in one task."""
    spread = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    each = {name: F.col(weight) if weight else F.lit(1).cast("long") for name, weight in sums.items()}
    parts = spread.groupBy("__p").agg(*[F.sum(c).alias(f"__s_{name}") for name, c in each.items()])
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("__p", *[F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__base_{name}") for name in each])
    upto = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = spread.join(F.broadcast(starts), "__p")
    return met.select(*df.columns, *[(F.col(f"__base_{name}") + F.sum(c).over(upto)).cast("long").alias(name) for name, c in each.items()])


def phrase_pairs(pairs: DataFrame, phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """Response pairs (src, trg) with phrases and raw texts of both ends."""
    out = pairs
    for side in ("src", "trg"):
        out = out.join(phrases.select(F.col("tw_id").alias(side), F.col("phids").alias(f"{side}_phids")), side).join(texts.select(F.col("tw_id").alias(side), F.col("raw_txt").alias(f"{side}_txt")), side)
    return out


def labelled(docs: DataFrame, labels: DataFrame, key: str = "tw_id") -> DataFrame:
    """J21."""
    return docs.join(labels, key)


def pair_phrases(pairs: DataFrame) -> DataFrame:
    """Each distinct source phrase of a response pair with each distinct target phrase, and the time. Bounded by the row's own arrays."""
    one = pairs.select("src", "trg", "tw_datetime", F.explode(F.array_distinct("src_phids")).alias("src_phid"), "trg_phids")
    return one.select("src", "trg", "tw_datetime", "src_phid", F.explode(F.array_distinct("trg_phids")).alias("trg_phid"))


def edge_union(a: DataFrame, b: DataFrame, directed: bool = True) -> DataFrame:
    """Edges of two graphs with both weights, 0 where one has none."""
    ends = (lambda e: e) if directed else (lambda e: e.select(F.least("src", "trg").alias("src"), F.greatest("src", "trg").alias("trg"), "weight").groupBy("src", "trg").agg(F.max("weight").alias("weight")))
    one, two = (ends(e).select("src", "trg", F.col("weight").alias(w)) for e, w in ((a, "w1"), (b, "w2")))
    return one.join(two, ["src", "trg"], "full").select("src", "trg", F.coalesce("w1", F.lit(0.0)).alias("w1"), F.coalesce("w2", F.lit(0.0)).alias("w2"))


def common_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Node overlap of two edge tables: n1, n2, common, sig_1, sig_2."""
    nodes = lambda e, f: e.select(F.col("src").alias("n")).unionByName(e.select(F.col("trg").alias("n"))).distinct().withColumn(f, F.lit(1))
    both = nodes(a, "x").join(nodes(b, "y"), "n", "full")
    s = both.agg(F.count("x").alias("n1"), F.count("y").alias("n2"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"))
    return s.select("*", (F.col("common") / F.col("n1")).alias("sig_1"), (F.col("common") / F.col("n2")).alias("sig_2"))


def aligned_labels(a: DataFrame, b: DataFrame, node: str = "usr_id", label: str = "com") -> DataFrame:
    """Labels of the nodes of ``a`` in two labellings; a node that ``b`` doesn't have gets a fresh label of its own."""
    both = a.select(node, F.col(label).alias("label_1")).join(b.select(node, F.col(label).alias("label_2")), node, "left")
    top = b.agg(F.coalesce(F.max(label), F.lit(-1))).first()[0]
    fresh = numbered(both.filter("label_2 is null").select(node, "label_1"), node, "label_2", top + 1)
    return both.filter("label_2 is not null").withColumn("label_2", F.col("label_2").cast("long")).unionByName(fresh)


def induced(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select(key).distinct()
    return edges.join(n.withColumnRenamed(key, "src"), "src", "left_semi").join(n.withColumnRenamed(key, "trg"), "trg", "left_semi").select(*edges.columns)

