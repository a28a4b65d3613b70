"""Operator 10. Exact duplicates by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, numbered, removed, small, without, written

#: Bytes of the first digit, how much longer each next one is, and the longest.
FIRST, GROWTH, LONGEST = 128, 8, 1 << 20
#: Bytes of a round's groups, digits included, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def _exact(rows: DataFrame, text_col: str = "text", first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """row, doc_id, keep_id, keep_row, group_size, text_sha256 of numbered rows with a doc_id."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    state = rows.select(F.col(ROW).alias("row"), "doc_id", text.alias("rest"), F.lit(0).cast("long").alias("grp"))
    sha, done, length = F.sha2("rest", 256), [], first
    while True:
        digit = state.withColumn("digit", F.substring("rest", 1, length))
        best = F.max(F.struct("doc_id", "row"))
        groups, groups_at = written(
            digit.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).filter("n > 1").withColumn("next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        ended, alone = F.length("digit") < length, F.col("n").isNull()
        split = digit.join(small(groups, BROADCAST_BYTES), ["grp", "digit"], "left").select(
            "row", "doc_id", sha.alias("text_sha256"),
            F.when(alone, F.struct("doc_id", "row")).when(ended, F.col("best")).alias("keep"),
            F.when(alone, F.lit(1).cast("long")).when(ended, F.col("n")).alias("group_size"),
            F.when(~alone & ~ended, F.expr(f"substring(rest, {length + 1})")).alias("rest"),
            F.col("next").alias("grp"),
        )
        split, _ = written(split, "radix")
        removed(rows.sparkSession, groups_at)
        done.append(split.filter("rest is null"))
        state, sha = split.filter("rest is not null").select("row", "doc_id", "text_sha256", "rest", "grp"), F.col("text_sha256")
        if state.isEmpty():
            break
        length = min(length * growth, LONGEST)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("row", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size", "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id (the largest doc_id of the group), group_size, kept, text_sha256.

    All rows begin in one group. Each round splits every open group by the next
    bytes of its texts; a row that is alone leaves, and a group whose texts have
    ended is a group of copies. Equality rests on the bytes alone; the sha256 is
    only a column of the result. A group's rows are counted with partial
    aggregation and meet their subgroup in a join against one row for each
    subgroup, so that a group of any size is never gathered in a task.

    Null texts count as empty. Just one row of each group is kept: of several
    rows of the largest id, the last one in the table. A null id is never the
    largest; a group of null ids only has a null keep_id, and one of its rows is
    kept. An empty table gives an empty result. Other columns are ignored."""
    rows = numbered(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _exact(rows, "text", first, growth)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest doc_id.

    Rows are told apart by a row number, so that null and repeated ids, and rows that are repeated as a whole, lose no
    other row: of rows of one text and one id the last one stays, and of null ids only, one. Columns of any name pass."""
    rows = numbered(docs)
    dropped, _ = written(_exact(rows).filter("row <> keep_row").select("row"), "exact-dropped")
    return without(rows, dropped)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
