"""Operator 11. Merkle trees of a table: one for each group, and one over their roots, from a range-sorted RDD."""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BROADCAST_BYTES, ship, written

#: Nodes of a run, rows that a range partition is cut to hold, and rows below which a partition isn't worth a task.
FANOUT, PARTITION_ROWS, LEAST_ROWS = 3, 200_000, 1000
#: Columns of a leaf of ``documents``.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())]))
_LEAF, _RAGGED, _ROOT = 0, 1, 2


def leaf(columns: dict[str, Column] | tuple = LEAF_COLUMNS) -> Column:
    """sha256 (lowercase hex) of a row's values, each ``-`` if null, else its UTF-8 bytes' count, ``:``, and the value as text."""
    values = columns.values() if isinstance(columns, dict) else [F.col(f"`{c}`") for c in columns]
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text]).cast("binary"), 256)


def _ends(part: int, rows):
    """One row for a partition that has rows: its number, first group and its rows, last group and its rows."""
    first = last = None
    n_first = n = 0
    for grp, run in groupby(rows, key=lambda r: r[0]):
        n = sum(1 for _ in run)
        if first is None:
            first, n_first = grp, n
        last = grp
    if first is not None:
        yield part, first, n_first, last, n


def _offsets(ends: list[tuple]) -> tuple[dict[int, tuple[int, int, int]], int]:
    """By partition: rows of its first group in partitions before it, all rows of its first group, and of its last one.
    And the rows of the largest group that several partitions share (0: none)."""
    rows_of: dict[str, int] = {}
    parts_of: dict[str, int] = {}
    before = {}
    for part, first, n_first, last, n_last in sorted(ends):
        before[part] = rows_of.get(first, 0)
        for grp, n in {first: n_first, last: n_last}.items():
            rows_of[grp] = rows_of.get(grp, 0) + n
            parts_of[grp] = parts_of.get(grp, 0) + 1
    return {p: (before[p], rows_of[a], rows_of[b]) for p, a, _, b, _ in ends}, max((n for g, n in rows_of.items() if parts_of[g] > 1), default=0)


def _subtrees(offsets: dict[int, tuple[int, int, int]], fanout: int):
    """Of a partition: its leaves with their paths as far as they are local, the nodes whose parents aren't, and whole groups' roots."""

    def run(part: int, rows):
        before, whole_first, whole_last = offsets.get(part, (0, 0, 0))
        first, held = True, None
        for grp, members in groupby(rows, key=lambda r: r[0]):
            if held:  # not the last group; the first one may have begun in another partition
                yield from local(*held, before if first else 0, whole_first if first else len(held[1]))
                first = False
            held = grp, list(members)
        if held:  # the last group may go on in the next one
            yield from local(*held, before if first else 0, whole_first if first else whole_last)

    def local(grp, members, at, width):
        nodes, levels, level, start = [m[1] for m in members], [], 0, at
        while width > 1:
            end, up_width = at + len(nodes), -(-width // fanout)
            low, high = -(-at // fanout), up_width if at + len(nodes) == width else end // fanout
            if low >= high:
                low = high = -1
            steps: list = [None] * len(nodes)
            for k in [*range(at, end)] if low < 0 else [*range(at, low * fanout), *range(high * fanout, end)]:
                yield _RAGGED, grp, level, k, width, bytes.fromhex(nodes[k - at]), None, None
            levels.append((at, steps))
            if low < 0:
                break
            up = []
            for j in range(low, high):
                a, b = j * fanout - at, min((j + 1) * fanout, width) - at
                kids = nodes[a:b]
                raw = [bytes.fromhex(x) for x in kids]
                for k in range(a, b):
                    steps[k] = (b"".join(raw[: k - a]), b"".join(raw[k - a + 1 :]))
                up.append(hashlib.sha256("".join(kids).encode()).hexdigest())
            at, nodes, width, level = low, up, up_width, level + 1
        root = bytes.fromhex(nodes[0]) if width == 1 else None
        if root is not None:
            yield _ROOT, grp, -1, 0, 1, root, None, None
        for i, m in enumerate(members):
            path, anchor, k = [], None, start + i
            for level, (at, steps) in enumerate(levels):
                step = steps[k - at]
                if step is None:
                    anchor = level, k
                    break
                path.append(step)
                k //= fanout
            yield _LEAF, grp, *(anchor or (-1, 0)), None, root if anchor is None else None, path, (m[1], *m[2])

    return run


def _tree(rows: DataFrame, order: list[str], fanout: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """rows: grp (never null), node (hex), kept (a struct), and columns of the order. Returns leaves (grp, node, kept, path, root) and
    roots (grp, root), digests as raw bytes in path and root.

    1. Rows are range-sorted by group, order and node; a row number behind them parts equal rows. The RDD is computed once; both
       passes below read the same shuffle, so that they see the same partitions.
    2. Each partition tells its first and last group and their rows; the driver, which gets these few values for each partition,
       adds up where in its group a partition begins.
    3. Partitions build all complete runs of three that lie within them, level by level. A node whose run reaches into another
       partition is ragged: at most two at each end of each level.
    4. Ragged nodes are shuffled by coordinate (group, level, place), one level after the other, to runs that are now complete.
    5. Leaves take the rest of their path from the ragged node above them."""
    spark, n = rows.sparkSession, rows.count()
    by = ["grp", *order, "node", "salt"]
    parts = max(1, -(-n // PARTITION_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)))
    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rdd = ordered.select("grp", "node", "kept").rdd
    offsets, largest = _offsets(rdd.mapPartitionsWithIndex(_ends).collect())
    kept = T.StructType([T.StructField("node", T.StringType()), *rows.schema["kept"].dataType.fields])
    schema = T.StructType([T.StructField(c, t) for c, t in [("kind", T.IntegerType()), ("grp", T.StringType()), ("level", T.IntegerType()), ("place", T.LongType()), ("width", T.LongType()), ("node", T.BinaryType()), ("path", _PATH), ("kept", kept)]])
    built, _ = written(spark.createDataFrame(rdd.mapPartitionsWithIndex(_subtrees(offsets, fanout)), schema, verifySchema=False), f"{tag}-local")

    ragged = built.filter(f"kind = {_RAGGED}").select("grp", "level", "place", "width", F.lower(F.hex("node")).alias("node"))
    levels, above, runs = 0, None, []
    while largest > 1:
        now = ragged.filter(F.col("level") == levels).select("grp", "place", "width", "node")
        now = now if above is None else now.unionByName(above)
        kids = F.sort_array(F.collect_list(F.struct("place", "node")))
        run = now.groupBy("grp", F.expr(f"place div {fanout}").alias("up")).agg(kids.alias("kids"), F.max("width").alias("width"))
        digest = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]), "").cast("binary"), 256)
        run, _ = written(run.select("grp", F.lit(levels + 1).alias("level"), "up", "kids", F.expr(f"(width + {fanout - 1}) div {fanout}").alias("width"), digest.alias("node")), f"{tag}-level")
        runs.append(run)
        above = run.filter("width > 1").select("grp", F.col("up").alias("place"), "width", "node")
        levels, largest = levels + 1, -(-largest // fanout)

    leaves = built.filter(f"kind = {_LEAF}").select("grp", "level", "place", "kept", "path", F.col("node").alias("root"))
    roots = built.filter(f"kind = {_ROOT}").select("grp", F.col("node").alias("root"))
    if not runs:
        return leaves.select("grp", "kept", "path", "root"), roots
    joined = runs[0]
    for run in runs[1:]:
        joined = joined.unionByName(run)
    joined = joined.withColumnRenamed("level", "run_level")
    roots = roots.unionByName(joined.filter("width = 1").select("grp", F.unhex("node").alias("root")))
    # every ragged node meets the runs above it at once: its ancestor k levels up is its place divided by fanout^k
    powers = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(fanout**k).alias("p")) for k in range(levels)])
    up = ragged.select("grp", "level", "place", F.explode(powers).alias("x")).select(
        "grp", "level", "place", (F.col("level") + F.col("x.k") + 1).alias("run_level"), F.expr("place div x.p").alias("child"), F.expr(f"place div x.p div {fanout}").alias("up")
    )
    side = lambda k: F.unhex(F.array_join(F.transform(F.filter("kids", k), lambda x: x["node"]), ""))
    met = up.join(joined, ["grp", "run_level", "up"]).select(
        "grp", "level", "place", "run_level", "width", "node", side(lambda x: x["place"] < F.col("child")).alias("left"), side(lambda x: x["place"] > F.col("child")).alias("right")
    )
    path = F.transform(F.sort_array(F.collect_list(F.struct("run_level", "left", "right"))), lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
    anchors = met.groupBy("grp", "level", "place").agg(path.alias("rest"), F.unhex(F.max_by("node", "run_level")).alias("top"))
    anchors, _ = written(anchors, f"{tag}-anchors")
    if anchors.count() * (200 + levels * fanout * 48) <= BROADCAST_BYTES:
        anchors = F.broadcast(anchors)
    whole = leaves.join(anchors, ["grp", "level", "place"], "left")
    return whole.select("grp", "kept", F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path"), F.coalesce("root", "top").alias("root")), roots


def merkle_proofs(docs: DataFrame, columns: tuple = LEAF_COLUMNS, group: str = "source", order: str = "doc_id", carried: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Proofs of all rows: the order column, leaf, subroot, root (lowercase hex), proof, and the carried columns.

    A leaf is the sha256 of its row (``leaf``). Of each group, leaves ascend by the order column, and while there are several nodes, each
    three consecutive ones (the last run: fewer) become the sha256 of their digests as hex text; what remains is the subroot.
    Subroots, ordered by group (null first, by UTF-8 bytes), likewise give the root. ``proof`` is an array of a step for each
    level from the leaf over its subroot to the root: the raw digests of the siblings to the left, and to the right, each joined;
    both are empty where the last run is a single node. ``folded`` goes back from a leaf and its proof to the root.

    Null values have their own mark in leaves; null groups are a group, null order values come first. Rows of one order value are ordered
    by leaf, so that the result doesn't depend on how the table is stored; equal rows are leaves of their own. An empty table
    gives an empty result. Columns of any name pass by: only those named are read. Groups of any size are cut by range; the
    driver gets a few values for each range partition."""
    ship(docs.sparkSession)
    carried = carried or {}
    at = {c: F.col(f"`{c}`") for c in {*columns, group, order}}
    grp = F.coalesce(F.concat(F.lit("="), at[group].cast("string")), F.lit(""))
    kept = F.struct(at[order].alias("id"), *[v.alias(f"kept_{k}") for k, v in carried.items()])
    rows = docs.select(grp.alias("grp"), at[order].alias("place_by"), leaf(columns).alias("node"), kept.alias("kept"))
    leaves, roots = _tree(rows, ["place_by"], fanout, "merkle")
    tops = roots.select(F.lit("").alias("grp"), F.col("grp").alias("by"), F.lower(F.hex("root")).alias("node"), F.struct("grp").alias("kept"))
    tops, _ = _tree(tops, ["by"], fanout, "merkle-top")
    tops = tops.select(F.col("kept.grp").alias("grp"), F.col("path").alias("rest"), F.col("root").alias("top"))
    tops, _ = written(tops, "merkle-tops")
    size = F.sum(F.octet_length("grp") + F.size("rest") * fanout * 48 + 200)
    if (tops.agg(size).first()[0] or 0) <= BROADCAST_BYTES:
        tops = F.broadcast(tops)
    hexed = lambda c: F.lower(F.hex(c))
    return leaves.join(tops, "grp").select(
        F.col("kept.id").alias(order), F.col("kept.node").alias("leaf"), hexed("root").alias("subroot"), hexed("top").alias("root"), F.concat("path", "rest").alias("proof"), *[F.col(f"kept.kept_{k}").alias(k) for k in carried]
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), node, F.lower(F.hex(s["right"]))).cast("binary"), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = leaf({c: F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in LEAF_COLUMNS})
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0  # null ids: not tampered
    proofs = merkle_proofs(docs, carried={"tampered": F.when(even, tampered)})
    siblings = F.array_join(F.transform("proof", lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a short ASCII text bit by bit: DuckDB has no such function.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}) + 1), lambda i: list_transform(range(8), lambda b: (ascii(substr({0}, i::BIGINT, 1)) >> b::INTEGER) & 1)))::BIGINT[]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

OP11_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT *, source AS s, CASE WHEN {CRC_SQL.format("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bad FROM documents),
e AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(s) || ':' || s, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
l AS (SELECT doc_id, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS bad FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS w FROM l),
t AS (
  SELECT s, 0 AS lv, i, leaf AS h, w FROM o
  UNION ALL
  SELECT s, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (w + 2) // 3 FROM t WHERE w > 1 GROUP BY s, lv, i // 3, w),
r AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS w FROM t WHERE w = 1),
u AS (
  SELECT 0 AS lv, i, subroot AS h, w FROM r
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (w + 2) // 3 FROM u WHERE w > 1 GROUP BY lv, i // 3, w),
sib AS (SELECT a.s, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS x, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS y
  FROM t a JOIN t b ON a.s IS NOT DISTINCT FROM b.s AND a.lv = b.lv AND a.i // 3 = b.i // 3 WHERE a.w > 1 GROUP BY ALL),
sib2 AS (SELECT a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS x, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS y
  FROM u a JOIN u b ON a.lv = b.lv AND a.i // 3 = b.i // 3 WHERE a.w > 1 GROUP BY ALL),
f AS (
  SELECT s, i AS id, 0 AS lv, i, bad AS h, '' AS p FROM o
  UNION ALL
  SELECT f.s, f.id, f.lv + 1, f.i // 3, sha256(x || h || y), p || x || y FROM f JOIN sib ON f.s IS NOT DISTINCT FROM sib.s AND f.lv = sib.lv AND f.i = sib.i),
f1 AS (SELECT s, id, max_by(h, lv) AS h, max_by(p, lv) AS p FROM f GROUP BY s, id),
g AS (
  SELECT f1.s, id, 0 AS lv, r.i, h, p FROM f1 JOIN r ON f1.s IS NOT DISTINCT FROM r.s
  UNION ALL
  SELECT g.s, g.id, g.lv + 1, g.i // 3, sha256(x || h || y), p || x || y FROM g JOIN sib2 ON g.lv = sib2.lv AND g.i = sib2.i),
g1 AS (SELECT s, id, max_by(h, lv) AS h, max_by(p, lv) AS p FROM g GROUP BY s, id),
top AS (SELECT h AS root FROM u WHERE w = 1)
SELECT doc_id, leaf, subroot, root, sha256(g1.p) AS proof_sha256, g1.h AS folded_root, g1.h = root AS verified
FROM o JOIN r ON o.s IS NOT DISTINCT FROM r.s JOIN g1 ON o.s IS NOT DISTINCT FROM g1.s AND o.i = g1.id, top
"""
