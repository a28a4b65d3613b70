"""Temporal windows and time series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import vectors as V
from tidemark.operators.joins import PAIR_ROWS, block_pairs, block_values, bounded, one_group, tile_sides, two_sides, vector_rows
from tidemark.sources.scratch import shipped


def hopping(spark: SparkSession, start: str, end: str, history: int = 3, future: int = 3, stride: int = 3) -> DataFrame:
    """(idx, key, start, end): days around centres that run from start + history to end by ``stride``."""
    day = lambda s: F.to_date(F.lit(s), "yyyyMMdd")
    first = F.date_add(day(start), history)
    # a sequence whose stop is before its start is an error: an empty range has one day too many
    days = spark.range(1).select(F.explode(F.sequence(first, F.greatest(first, day(end)), F.expr(f"interval {stride} days"))).alias("mid")).filter(F.col("mid") <= day(end))
    out = days.select(F.date_sub("mid", history).alias("s"), F.date_add("mid", future).alias("e"))
    return out.select((F.datediff("s", day(start)) / stride).cast("int").alias("idx"), F.concat_ws("_", F.date_format("s", "yyyyMMdd"), F.date_format("e", "yyyyMMdd")).alias("key"), F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))


def tumbling_index(col: str, start: str, days: int = 7) -> Column:
    """Number of the window from an absolute start that holds a time; before the start, null."""
    at = F.unix_timestamp(F.col(col)) - F.unix_timestamp(F.lit(start).cast("timestamp"))
    return F.when(at >= 0, F.floor(at / (days * 86400)).cast("int"))


def tumbling(df: DataFrame, col: str, start: str, days: int = 7, hold_back: int = 1) -> DataFrame:
    """win_idx, win_start and win_end (the next start less ``hold_back`` seconds) of each row; rows before the start go. Arithmetic only, no join."""
    rows = df.withColumn("win_idx", tumbling_index(col, start, days)).filter("win_idx is not null")
    base = F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("win_idx") * (days * 86400)
    return rows.withColumn("win_start", F.timestamp_seconds(base)).withColumn("win_end", F.timestamp_seconds(base + days * 86400 - hold_back))


def slots(spark: SparkSession, start: str, end: str, period: str, step: str) -> DataFrame:
    """Slots [start, start + period) from each step while the slot begins by the end."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {step}"))).alias("start"))
    return rows.select("start", (F.col("start") + F.expr(f"interval {period}")).alias("end"))


def fixed_windows(df: DataFrame, col: str, start: str, end: str, days: int, closed: str = "right") -> DataFrame:
    """Windows of so many days after ``start``, (s, e] (or [s, e)), the last cut at ``end``; rows after a gap are kept."""
    s, t = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    c = F.col(col).cast("timestamp")
    at = F.unix_micros(c) - F.unix_micros(s)
    width = days * 86_400_000_000
    rows = df.filter((c > s) & (c <= t) if closed == "right" else (c >= s) & (c < t))
    idx = F.when(F.lit(closed == "right"), F.ceil(at / width) - 1).otherwise(F.floor(at / width)).cast("int")
    begin = s + F.make_dt_interval(F.col("win_idx") * days)
    return rows.withColumn("win_idx", idx).withColumn("win_start", begin).withColumn("win_end", F.least(begin + F.expr(f"interval {days} days"), t))


def day_grid(df: DataFrame, key: str, col: str) -> DataFrame:
    """Every day of a key, from the table's first to its last."""
    bounds = df.agg(F.to_date(F.min(col)).alias("a"), F.to_date(F.max(col)).alias("b")).filter("a is not null")
    return df.select(key).distinct().join(F.broadcast(bounds)).select(key, F.explode(F.sequence("a", "b")).alias("day"))


def dense_series(df: DataFrame, key: str, col: str) -> DataFrame:
    """Rows of each key and day, zeros included, with the key's total; keys of most rows first."""
    counts = df.groupBy(key, F.to_date(col).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return day_grid(df, key, col).join(counts, [key, "day"], "left").join(totals, key).select(key, "day", F.coalesce("n", F.lit(0)).alias("n"), "total").orderBy(F.desc("total"), key, "day")


def consecutive(df: DataFrame, keys: Sequence[str], order: str, vec: str, adjacent: int | None = 1) -> DataFrame:
    """Js and cosine distance of each vector and the next one of its key; with ``adjacent`` only where the next is so many steps on."""
    if adjacent is not None:  # a join of each step with the one after it, whatever the number of keys
        rows = df.join(df.select(*keys, (F.col(order) - adjacent).alias(order), F.col(vec).alias("_next")), [*keys, order])
    else:
        rows = df.withColumn("_next", F.lead(vec).over(W.partitionBy(*keys).orderBy(order))).filter("_next is not null")
    return rows.select(*keys, order, V.js(F.col(vec), F.col("_next")).alias("js"), (1 - V.cosine(F.col(vec), F.col("_next"))).alias("cos_dist"))


def consecutive_summary(rows: DataFrame, keys: Sequence[str], value: str = "js") -> DataFrame:
    """Mean, deviation and number by key, most first."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")).orderBy(F.desc("n"), *keys)


def subsequences(df: DataFrame, key: str, order: str, vec: str, longest: int, events: DataFrame | None = None) -> DataFrame:
    """(key, start, len, inputs, truth): all runs of 2 to ``longest`` steps; the last input is zeros and its vector the truth; runs whose truth is all zero go. Events (day, event_vec) are joined by the step's day."""
    rows = df.join(events, F.substring(F.col(order).cast("string"), 1, 8) == F.col("event_day"), "left") if events is not None else df.withColumn("event_vec", F.lit(None).cast("array<double>"))
    runs = []
    for n in range(2, longest + 1):
        w = W.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
        runs.append(rows.select(key, F.collect_list(F.struct(F.col(order), F.col(vec), F.col("event_vec"))).over(w).alias("_run")).filter(F.size("_run") == n))
    out = reduce(DataFrame.unionByName, runs)
    last = F.element_at("_run", -1)
    inputs = F.transform("_run", lambda s, i: F.struct(F.when(i == F.size("_run") - 1, F.transform(s[vec], lambda x: F.lit(0.0))).otherwise(s[vec].cast("array<double>")).alias("vec"), s["event_vec"].alias("event_vec")))
    out = out.select(key, F.element_at("_run", 1)[order].alias("start"), F.size("_run").alias("len"), inputs.alias("inputs"), last[vec].alias("truth"))
    return out.filter(F.exists("truth", lambda x: x != 0))


def event_distances(intervals: DataFrame, events: DataFrame, order: str, vec: str, event_day: str, event_vec: str, keys: Sequence[str] = ()) -> DataFrame:
    """Js of every interval with every event (a given few); -0.1 before the event's day and for zero vectors."""
    rows = intervals.join(bounded(events))
    return rows.select(*keys, order, event_day, F.when(F.col(order) >= F.col(event_day), V.js(F.col(vec), F.col(event_vec), sentinel=-0.1)).otherwise(F.lit(-0.1)).alias("js"))


def _js(x: np.ndarray, y: np.ndarray, base: float) -> np.ndarray:
    """``V.js`` of each row with each other, of rows that sum to 1."""
    out = np.zeros((len(x), len(y)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b in zip(x.T, y.T, strict=True):
            a, b = a[:, None], b[None, :]
            half = (a + b) / 2
            out += np.where(a > 0, a * np.log(a / half), 0.0)
            out += np.where(b > 0, b * np.log(b / half), 0.0)
    lost = np.isnan(x).any(1)[:, None] | np.isnan(y).any(1)[None, :]
    return np.where(lost, np.nan, np.sqrt(np.maximum(out / 2, 0.0) / math.log(base)))


def pair_distances(df: DataFrame, key: str, vec: str, within: str | None = None, base: float = math.e) -> DataFrame:
    """Js of pairs of keys i < j, of one ``within`` value; in tiles of an equi-join, each one operation on two matrices. Zero vectors give null."""
    pairs = block_pairs(vector_rows(df, key, V.share(F.col(vec)), within), partial(_js, base=base), math.nan)
    return pairs.select(*([F.col("w").alias(within)] if within else []), F.col("a").alias("i"), F.col("b").alias("j"), F.col("value").alias("js"))


#: Cells of a table of the distances of a tile's distinct vectors.
CLASS_CELLS = 1 << 22
#: Keys of a side of a tile of ``pair_means``, of whose rows each is sent to all tiles of its block.
SENT_KEYS = 32_768


def pair_means(df: DataFrame, key: str, vec: str, within: str, most: float, base: float = math.e) -> DataFrame:
    """(i, j, mean, support) of pairs of keys i < j: the mean js over the ``within`` values that both have, where it is at most ``most``.

    A tile holds all ``within`` values of its keys, so that distances are summed up where they are made, strip by strip, and only close pairs become rows. Distances
    of two strips' distinct vectors are made once, where those are few. A key has one vector for a ``within`` value at most."""
    rows = df.select(F.lit(0).alias("w"), F.col(key).alias("k"), F.col(within).cast("string").alias("d"), V.share(F.col(vec)).alias("v")).filter("d is not null and v is not null and not exists(v, x -> isnull(x))")
    kind = dict(rows.dtypes)["k"]

    def parts(side) -> list[tuple]:
        """Of the rows of some keys each: their keys, each row's key, vectors, those of each day, and the distinct vectors."""
        out, codes = [], side["k"].combine_chunks().dictionary_encode()
        keys, order = codes.dictionary, np.argsort(codes.indices.to_numpy(), kind="stable")
        owner = codes.indices.to_numpy()[order]
        for at in range(0, len(keys), PAIR_ROWS):
            low, high = np.searchsorted(owner, (at, at + PAIR_ROWS))
            rows = side.take(pa.array(order[low:high]))
            out.append((keys.slice(at, PAIR_ROWS), owner[low:high] - at, rows["v"], _days(rows["d"]), _classes(rows["v"])))
        return out

    def tile(left: tuple, right: tuple, same: bool):
        (k, own, x, first, (a, of_a)), (m, other, y, second, (b, of_b)) = left, right
        total, support = np.zeros((len(k), len(m))), np.zeros((len(k), len(m)), np.int32)
        known = block_values(a, b, partial(_js, base=base), math.nan) if len(a) * len(b) <= CLASS_CELLS else None
        for day in first.keys() & second.keys():
            i, j = first[day], second[day]
            js = known[np.ix_(of_a[i], of_b[j])] if known is not None else block_values(x.take(pa.array(i)), y.take(pa.array(j)), partial(_js, base=base), math.nan)
            there = ~np.isnan(js)
            cell = np.ix_(own[i], other[j])
            total[cell] += np.where(there, js, 0.0)
            support[cell] += there
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total / support
            hit = mean <= most
        if same:  # a block with itself: each pair once
            ranks = pc.rank(pa.concat_arrays([k, m]), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
            hit &= ranks[: len(k), None] < ranks[None, len(k) :]
        i, j = np.nonzero(hit)
        return pa.table([k.take(pa.array(i)), m.take(pa.array(j)), pa.array(mean[hit]), pa.array(support[hit].astype(np.int64))], names=["i", "j", "mean", "support"])

    def run(at: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = map(parts, two_sides(batches))
        for one in left:
            for two in right:
                yield from tile(one, two, at[1].as_py() == at[2].as_py()).combine_chunks().to_batches()

    left, right = tile_sides(shipped(rows), SENT_KEYS, 64)
    found = one_group(left, right).applyInArrow(run, f"i {kind}, j {kind}, mean double, support long")
    return found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "mean", "support")


def _days(column) -> dict:
    """Rows of each day."""
    codes = column.combine_chunks().dictionary_encode()
    names = codes.dictionary.to_pylist()
    return {names[c]: at for c, at in _members(codes.indices.to_numpy()).items()}


def _members(codes: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    values, starts = np.unique(codes[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, starts[1:]), strict=True))


def _classes(column) -> tuple[pa.Array, np.ndarray]:
    """Distinct vectors of a column, and the place of each row's among them; vectors without missing elements."""
    flat = column.combine_chunks()
    lengths = flat.value_lengths().to_numpy()
    values, ends = flat.flatten().to_numpy(), np.cumsum(lengths)
    place: dict[bytes, int] = {}
    firsts, of = [], np.empty(len(flat), np.int64)
    for i, (e, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        c = place.setdefault(values[e - n : e].tobytes(), len(firsts))
        if c == len(firsts):
            firsts.append(i)
        of[i] = c
    return flat.take(pa.array(firsts, pa.int64())), of


def presence(df: DataFrame, entity: str, interval: str, intervals: Sequence) -> DataFrame:
    """Entity by interval, 1 where it occurs, most present first."""
    wide = df.select(entity, interval).distinct().withColumn("_x", F.lit(1)).groupBy(entity).pivot(interval, list(intervals)).agg(F.first("_x")).fillna(0)
    return wide.withColumn("n", sum((F.col(f"`{i}`") for i in intervals), F.lit(0))).orderBy(F.desc("n"), entity)


def mean_cosine(a: DataFrame, b: DataFrame, interval: str, vec: str) -> DataFrame:
    """Cosine of two groups' mean vectors in each interval, in time order."""
    return a.select(interval, F.col(vec).alias("x")).join(b.select(interval, F.col(vec).alias("y")), interval).select(interval, V.cosine(F.col("x"), F.col("y")).alias("cosine")).orderBy(interval)
