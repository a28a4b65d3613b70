"""Operator 12. Conversations are mended to alternate by the cheapest edits: a DuckDB recursion over batches of turns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, ship, written
from tidemark.llm.merkle import CRC_SQL

#: Turns of a segment, segments of a conversation that are joined at a time, and turns of a batch.
SEGMENT, JOINED, BATCH_TURNS = 256, 64, 8000
#: \x20\x09-\x0D
_SPACES = " \t\n\x0b\x0c\r"

#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn. 0 and 3 may end.
#: Insertions before a turn: state, letters, cost, next state.
_INSERTS = "(0,'',0,0),(0,'I',3,2),(0,'II',6,3),(1,'',0,1),(1,'I',3,2),(1,'II',6,3),(2,'',0,2),(2,'I',3,3),(3,'',0,3),(3,'I',3,2)"
#: Edits of the turn itself: state, initial that it asks for (null: any), letter, cost, next state, and whether the turn is left out.
_EDITS = "(0,'s','K',0,1,false),(0,'u','K',0,2,false),(1,'u','K',0,2,false),(3,'u','K',0,2,false),(2,'a','K',0,3,false),(0,NULL,'R',3,2,false),(1,NULL,'R',3,2,false),(3,NULL,'R',3,2,false),(2,NULL,'R',3,3,false),(0,NULL,'D',4,0,true),(1,NULL,'D',4,1,true),(2,NULL,'D',4,2,true),(3,NULL,'D',4,3,true)"

#: Each step advances all segments of a batch by one turn (or piece) at once and keeps, of the ways to a state, the cheapest, of
#: equally cheap ones the one whose audit comes first. Two of them that cost the same are never each other's prefix: what one has
#: more would be insertions, which cost. So the better one stays better whatever follows.
_ADVANCE = """
WITH RECURSIVE moves AS MATERIALIZED (
  SELECT i.st, e.ini, e.out, i.letters || e.letter AS letters, i.cost + e.cost AS cost, e.to_st
  FROM (VALUES {inserts}) i(st, letters, cost, mid) JOIN (VALUES {edits}) e(st, ini, letter, cost, to_st, out) ON e.st = i.mid),
turns AS MATERIALIZED (
  SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY pos) AS k, ini, fault, begins, lag(ini) OVER (PARTITION BY seg ORDER BY pos) || ini AS pair, pos FROM batch),
segs AS (
  SELECT seg, max(k) AS n, bool_or(begins) AS begins, arg_min(ini, pos) AS ini0, arg_max(ini, pos) AS ini1, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY seg),
state AS (
  SELECT seg, 0::BIGINT AS k, s AS init, s AS st, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM segs, (VALUES (0), (1), (2), (3)) v(s) WHERE s = 0 OR NOT begins
  UNION ALL
  SELECT seg, k + 1, init, to_st, min(way) FROM (
    SELECT x.seg, x.k, x.init, m.to_st, {{'cost': x.best.cost + m.cost + CASE WHEN t.fault = 't' AND NOT m.out THEN 3 ELSE 0 END, 'audit': x.best.audit || m.letters}} AS way
    FROM state x JOIN turns t ON t.seg = x.seg AND t.k = x.k + 1 JOIN moves m ON m.st = x.st AND (m.ini IS NULL OR m.ini = t.ini) AND (m.out OR t.fault NOT IN ('b', 'd'))) w
  GROUP BY seg, k, init, to_st)
SELECT grp, block, begins, init, st AS last, best.cost AS cost, best.audit AS audit, ini0, ini1, illegal
FROM state JOIN segs USING (seg) JOIN (SELECT DISTINCT seg, grp, block FROM batch) b USING (seg) WHERE k = n
""".format(inserts=_INSERTS, edits=_EDITS)

_JOIN = """
WITH RECURSIVE pieces AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY seg ORDER BY pos) AS k FROM batch),
ends AS (SELECT DISTINCT seg, k, ini0, ini1, illegal, begins FROM pieces),
pairs AS (SELECT *, lag(ini1) OVER (PARTITION BY seg ORDER BY k) || ini0 AS pair FROM ends),
segs AS (
  SELECT seg, max(k) AS n, bool_or(begins) AS begins, arg_min(ini0, k) AS ini0, arg_max(ini1, k) AS ini1, sum(illegal)::BIGINT + count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY seg),
state AS (
  SELECT seg, 0::BIGINT AS k, s AS init, s AS st, {'cost': 0::BIGINT, 'audit': ''} AS best FROM segs, (VALUES (0), (1), (2), (3)) v(s) WHERE s = 0 OR NOT begins
  UNION ALL
  SELECT seg, k + 1, init, last, min(way) FROM (
    SELECT x.seg, x.k, x.init, p.last, {'cost': x.best.cost + p.cost, 'audit': x.best.audit || p.audit} AS way
    FROM state x JOIN pieces p ON p.seg = x.seg AND p.k = x.k + 1 AND p.init = x.st) w
  GROUP BY seg, k, init, last)
SELECT grp, block, begins, init, st AS last, best.cost AS cost, best.audit AS audit, ini0, ini1, illegal
FROM state JOIN segs USING (seg) JOIN (SELECT DISTINCT seg, grp, block FROM batch) b USING (seg) WHERE k = n
"""

_PIECE = "grp string, block long, begins boolean, init int, last int, cost long, audit string, ini0 string, ini1 string, illegal long"


def _batches(sql: str):
    """Runs the recursion over a batch of whole segments: rows with grp, block, pos and what the SQL asks for."""

    def run(table):
        import duckdb
        import pyarrow as pa

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
            con.register("rows", table)
            con.execute("CREATE TABLE batch AS SELECT *, dense_rank() OVER (ORDER BY grp, block) AS seg FROM rows")
            out = con.sql(sql).to_arrow_table()
        types = {"grp": pa.string(), "block": pa.int64(), "begins": pa.bool_(), "init": pa.int32(), "last": pa.int32(), "cost": pa.int64(), "audit": pa.string(), "ini0": pa.string(), "ini1": pa.string(), "illegal": pa.int64()}
        return out.cast(pa.schema(list(types.items())))

    return run


def _dealt(rows: DataFrame, n: int, sql: str) -> DataFrame:
    """Segments (grp, block) dealt to hash partitions, some 8000 rows in a batch; no segment has more than a few hundred."""
    bucket = F.pmod(F.xxhash64("grp", "block"), F.lit(max(1, -(-n // BATCH_TURNS))))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_batches(sql), _PIECE)


def _ordered(turns: DataFrame) -> tuple[DataFrame, int]:
    """grp, conv_id, turn, role, text, pos: a dense number of the order of conversation, turn (nulls first), role, text. And how many rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    grp = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select(grp.alias("grp"), "conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.monotonically_increasing_id().alias("salt"))
    by = ["grp", "turn", "role", "text", "salt"]  # the salt parts equal rows
    rows, _ = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt").withColumn("pos", F.monotonically_increasing_id()), "turns")
    counts = rows.groupBy(F.shiftright("pos", 33).alias("part")).agg(F.max("pos").alias("n")).collect()  # one row for each range partition
    first, sums = 0, []
    for part, last in sorted(counts):
        sums.append((part, first - (part << 33)))
        first += last - (part << 33) + 1
    offsets = rows.sparkSession.createDataFrame(sums, "part long, shift long")
    return rows.join(F.broadcast(offsets), F.shiftright("pos", 33) == F.col("part")).withColumn("pos", F.col("pos") + F.col("shift")).drop("part", "shift"), first


def _trimmed(text: str) -> Column:
    return F.expr(f"rtrim('{_SPACES}', {text})")


def _repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns in order (``_ordered``), and of each conversation: grp, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    ship(turns.sparkSession)
    rows, n = _ordered(turns)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    # a row of each first saying, told by its number, so that the join below has no key that many rows share
    firsts = rows.groupBy("grp", F.unhex(said).alias("said")).agg(F.min("pos").alias("pos")).select("pos", F.lit(1).alias("fresh"), F.lit(0).alias("begins"))
    begins = rows.groupBy("grp").agg(F.min("pos").alias("pos")).select("pos", F.lit(0).alias("fresh"), F.lit(1).alias("begins"))
    marks = firsts.unionByName(begins).groupBy("pos").agg(F.max("fresh").alias("fresh"), F.max("begins").alias("begins"))
    end = F.right(_trimmed("text"), F.lit(1))
    narrow = rows.select("grp", "turn", "pos", F.substring("role", 1, 1).alias("ini"), end.alias("ending")).join(marks, "pos", "left")
    fault = F.when(F.col("ending") == "", "b").when(F.coalesce("fresh", F.lit(0)) == 0, "d").when(~F.col("ending").isin(".", "!", "?"), "t").otherwise("")
    narrow = narrow.select("grp", "turn", "pos", "ini", fault.alias("fault"), (F.coalesce("begins", F.lit(0)) == 1).alias("begins"), F.expr(f"pos div {SEGMENT}").alias("block"))
    narrow, _ = written(narrow, "turn-faults")

    kinds = [F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    turn_of = narrow.groupBy("grp", "turn").agg(*kinds, F.min("block").alias("block0"), F.max("block").alias("block1"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    stats = turn_of.groupBy("grp").agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")], F.min("block0").alias("lo"), F.max("block1").alias("hi"))
    stats, _ = written(stats, "turn-counts")

    pieces, _ = written(_dealt(narrow.select("grp", "block", "pos", "ini", "fault", "begins"), n, _ADVANCE), "turn-pieces")
    several = stats.filter("lo < hi").select("grp", "lo")
    longest = stats.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 1
    if longest > 1:  # conversations of several segments, which few are: their segments are joined like turns
        held = several.agg(F.count(F.lit(1))).first()[0] * 200 <= BROADCAST_BYTES
        several = F.broadcast(several) if held else several
        now, done = pieces.join(several, "grp").withColumn("block", F.col("block") - F.col("lo")).drop("lo"), pieces.join(several, "grp", "left_anti")
        while longest > 1:
            now = now.withColumn("pos", F.col("block")).withColumn("block", F.expr(f"block div {JOINED}"))
            now, _ = written(_dealt(now, n * 16 // SEGMENT, _JOIN), "turn-pieces")
            longest = -(-longest // JOINED)
        pieces = done.unionByName(now)
    best = F.min(F.when(F.col("last").isin(0, 3), F.struct("cost", "audit")))
    # insertions behind the last turn: an assistant's after a user's, or both after a system turn
    closing = F.when(F.col("last") == 2, F.struct((F.col("cost") + 3).alias("cost"), F.concat("audit", F.lit("I")).alias("audit"))).when(F.col("last") == 1, F.struct((F.col("cost") + 6).alias("cost"), F.concat("audit", F.lit("II")).alias("audit")))
    ways = pieces.filter("init = 0").groupBy("grp").agg(best.alias("x"), F.min(closing).alias("y"), F.max("illegal").alias("illegal"))
    least = F.when(F.col("x").isNull(), F.col("y")).when(F.col("y").isNull(), F.col("x")).otherwise(F.least("x", "y"))
    ways = ways.select("grp", least.alias("way"), "illegal").select("grp", "illegal", "way.cost", "way.audit")
    return rows, stats.join(ways, "grp").select("grp", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _walk(out):
    """Over rows in order of conversation and turn, each conversation's report first: what ``out`` makes of each conversation.

    A stream: a conversation's audit is held, and one turn at a time."""

    def run(batches):
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["pos"] < 0:
                    if held:
                        yield from held.close()
                    held = out(row)
                else:
                    yield from held.turn(row["role"], row["text"])
        if held:
            yield from held.close()

    return run


class _Repaired:
    """Applies an audit to the turns of a conversation in their order; ``emit`` gets each repaired turn."""

    def __init__(self, row):
        self.row, self.audit, self.k, self.state = row, row["audit"] or "", 0, 0

    def _next(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def _inserted(self):
        while self.k < len(self.audit) and self.audit[self.k] == "I":
            self.k += 1
            yield from self.emit("I", self._next(), "")

    def turn(self, role, text):
        yield from self._inserted()
        letter, self.k = self.audit[self.k], self.k + 1
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield from self.emit("K", role, text)
        elif letter == "R":
            yield from self.emit("R", self._next(), text)

    def close(self):
        yield from self._inserted()
        yield from self.end()


class _Digest(_Repaired):
    """The report of a conversation, with the sha256 of its repaired turns."""

    def __init__(self, row):
        super().__init__(row)
        self.sha, self.some = hashlib.sha256(), False

    def emit(self, letter, role, text):
        self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True
        return ()

    def end(self):
        r = self.row
        yield [r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [self.audit, self.sha.hexdigest()]


class _Turns(_Repaired):
    """The repaired turns of a conversation: conv_id, place, edit, role, text."""

    place = 0

    def emit(self, letter, role, text):
        yield [self.row["conv_id"], self.place, letter, role, text]
        self.place += 1

    def end(self):
        return ()


def _in_arrow(out, schema):
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, rows, size = to_arrow_schema(schema), [], 0
        for row in _walk(out)(batches):
            rows.append(row)
            size += 100 + sum(len(v) for v in row if isinstance(v, str))
            if len(rows) >= 2000 or size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types, strict=True)], schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types, strict=True)], schema=arrow)

    return run


def _applied(turns: DataFrame, ids: DataFrame | None, out, columns: str) -> DataFrame:
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    picked = turns.select("conv_id", "turn", "role", "text")
    rows, reports = _repairs(picked)
    ids = (picked if ids is None else ids).select("conv_id").distinct()
    grp = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = ids.withColumn("grp", grp).join(reports, "grp", "left").select("grp", F.lit(-1).cast("long").alias("pos"), "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"))
    both = heads.unionByName(rows.select("grp", "pos", "role", "text"), allowMissingColumns=True)
    ordered = both.repartition("grp").sortWithinPartitions("grp", "pos")
    schema = StructType([StructField("conv_id", picked.schema["conv_id"].dataType), *_parse_datatype_string(columns).fields])
    return ordered.mapInArrow(_in_arrow(out, schema), schema)


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What is wrong with each conversation, and its cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows (conv_id, turn, role, text) are taken by turn, null turns first; of one turn by role, then text. Null roles and texts are a
    space. The first fault of a row counts: blank (white space only), duplicate (role and text seen earlier), truncated (its last
    character that isn't white space is none of ``.!?``). Keeping a row costs 0, calling it user or assistant 3, deleting it 4, which
    blank and duplicate rows must be, and inserting an empty user or assistant turn 3; truncated rows that stay add 3. Of the
    cheapest edits whose roles' initials read ``(s?(ua)+)?`` the audit (K, R, D, I in order) that comes first in ASCII is taken; it
    tells the repaired turns, which ``repaired_turns`` gives and ``repaired_sha256`` sums up (``role:text``, joined by newlines).

    1. Turns are range-sorted and numbered; a conversation of any length lies in segments of at most 256 turns.
    2. Hash partitions of segments run a recursive query in DuckDB. Each recursion advances one turn of all segments of the batch, and
       keeps the least cost and its audit for each state of the grammar; where a segment isn't the first of its conversation, for
       each state that it may begin in.
    3. Long conversations' segments are joined in the same way, 64 at a time, until there is one.
    4. Turns stream past their conversation's audit, in order. A conversation's hash is one pass over it in one task, in bounded memory.

    ``ids``: a table with all conv_ids; those without rows get zeros, an empty audit and the empty text's hash. A null conv_id is a
    conversation. An empty table gives an empty result; other columns are ignored."""
    return _applied(turns, ids, _Digest, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns that ``repair_report`` tells of: conv_id, place, edit (K kept, R other role, I inserted), role, text."""
    return _applied(turns, None, _Turns, "place long, edit string, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of known damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats it, 4 makes it a user's. Null values are a space, but that a null turn stays null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(turns), turns.select("conv_id"))


OP12_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, {CRC_SQL.format("name")} % 20 AS kind FROM c),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1) AS pair,
    CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins(st, letters, cost, mid, said) AS (VALUES (0, '', 0, 0, []::VARCHAR[]), (0, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']), (1, '', 0, 1, []), (1, 'I', 3, 2, ['user:']), (1, 'II', 6, 3, ['user:', 'assistant:']),
  (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant:']), (3, '', 0, 3, []), (3, 'I', 3, 2, ['user:'])),
edit(mid, letter, ini, cost, st, role) AS (VALUES (0, 'K', 's', 0, 1, ''), (0, 'K', 'u', 0, 2, ''), (1, 'K', 'u', 0, 2, ''), (3, 'K', 'u', 0, 2, ''), (2, 'K', 'a', 0, 3, ''), (0, 'R', '', 3, 2, 'user'), (1, 'R', '', 3, 2, 'user'),
  (3, 'R', '', 3, 2, 'user'), (2, 'R', '', 3, 3, 'assistant'), (0, 'D', '', 4, 0, ''), (1, 'D', '', 4, 1, ''), (2, 'D', '', 4, 2, ''), (3, 'D', '', 4, 3, '')),
s AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS st, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS way FROM n
  UNION ALL
  SELECT conv_id, k, st, min(way) FROM (
    SELECT s.conv_id, f.k, e.st, {{'cost': s.way.cost + i.cost + e.cost + CASE WHEN f.fault = 't' AND e.letter <> 'D' THEN 3 ELSE 0 END, 'audit': s.way.audit || i.letters || e.letter,
      'said': s.way.said || i.said || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END}} AS way
    FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = s.k + 1 JOIN ins i ON i.st = s.st JOIN edit e ON e.mid = i.mid
    WHERE (e.letter <> 'K' OR e.ini = f.ini) AND (e.letter = 'D' OR f.fault NOT IN ('b', 'd'))) w
  GROUP BY conv_id, k, st),
best AS (
  SELECT s.conv_id, min({{'cost': s.way.cost + i.cost, 'audit': s.way.audit || i.letters, 'said': s.way.said || i.said}}) AS way
  FROM s JOIN n ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.k = n.n JOIN ins i ON i.st = s.st AND i.mid IN (0, 3) GROUP BY s.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.way.cost, 0)::BIGINT AS cost, coalesce(best.way.audit, '') AS audit, sha256(coalesce(array_to_string(best.way.said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN n ON ids.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""
