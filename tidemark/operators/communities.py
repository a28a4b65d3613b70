"""Communities and influencers of graphs of any size (G4, G5): iterations of DataFrames over edges of all intervals at once.

Graphs are told apart by a text key ``g``; vertices keep their ids. Each round is written to the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import grouped as U
from tidemark.operators.joins import bounded, placed, running_sums
from tidemark.sources.scratch import cut, forget, shipped

#: Shares of the vertices that may move in a round, one after the other; a level ends when none of them brings a graph further.
MOVERS = (0.5, 0.5, 0.25, 0.1)
#: Gain of modularity below which a round doesn't count.
LEAST_GAIN = 1e-7
#: Edges up to which what a graph has been contracted to is finished by one task.
TASK_EDGES = 100_000


# ------------------------------------------------------------------ G4 Louvain


def _symmetric(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges (g, src, trg): e (g, a, b, w), each in both directions, without loops; and v (g, id, k, inner): strengths and twice the loops' weight."""
    loops = edges.filter("src = trg").groupBy("g", F.col("src").alias("id")).agg((2.0 * F.count(F.lit(1))).alias("inner"))
    side = lambda a, b: edges.filter("src <> trg").select("g", F.col(a).alias("a"), F.col(b).alias("b"))
    e = cut(side("src", "trg").unionByName(side("trg", "src")).groupBy("g", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))
    ends = e.groupBy("g", F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    v = ends.join(loops, ["g", "id"], "full").select("g", "id", (F.coalesce("k", F.lit(0.0)) + F.coalesce("inner", F.lit(0.0))).alias("k"), F.coalesce("inner", F.lit(0.0)).alias("inner"))
    return e, cut(v)


def modularities(e: DataFrame, v: DataFrame) -> DataFrame:
    """(g, q) of labels: e (g, a, b, w) in both directions, v (g, id, com, k, inner)."""
    side = lambda n: v.select("g", F.col("id").alias(n), F.col("com").alias(f"com_{n}"))
    within = e.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).filter("com_a = com_b").groupBy("g").agg(F.sum("w").alias("w"))
    sums = v.groupBy("g", "com").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    per = sums.groupBy("g").agg(F.sum("k").alias("m2"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum("inner").alias("inner"))
    q = (F.coalesce("w", F.lit(0.0)) + F.col("inner")) / F.col("m2") - F.col("kk") / (F.col("m2") * F.col("m2"))
    return per.join(within, "g", "left").select("g", F.when(F.col("m2") > 0, q).otherwise(F.lit(0.0)).alias("q"))


def _proposed(e: DataFrame, v: DataFrame, salt: int, share: float) -> DataFrame:
    """v with the community in which each vertex gains most, for those vertices whose turn it is.

    The weight of a vertex to each neighbouring community is one aggregated join, its gain comes from communities' totals. Of
    equal gains the least community is taken. Who may move is dealt by a hash, so that neighbours seldom swap places."""
    totals = v.groupBy("g", "com").agg(F.sum("k").alias("tot"))
    near = e.join(v.select("g", F.col("id").alias("b"), "com"), ["g", "b"]).select("g", F.col("a").alias("id"), "com", "w").unionByName(v.select("g", "id", "com", F.lit(0.0).alias("w")))
    links = near.groupBy("g", "id", "com").agg(F.sum("w").alias("w")).join(totals, ["g", "com"])
    own = v.select("g", "id", F.col("com").alias("own"), "k")
    whole = v.groupBy("g").agg(F.sum("k").alias("m2"))
    stays = F.col("com") == F.col("own")
    gain = F.col("w") - (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) * F.col("k") / F.col("m2")
    each = links.join(own, ["g", "id"]).join(bounded(whole), "g").withColumn("loss", -gain)
    best = each.groupBy("g", "id").agg(F.min(F.struct("loss", "com")).alias("best"), F.min(F.when(stays, F.col("loss"))).alias("own_loss"))
    turn = F.pmod(F.xxhash64("g", "id", F.lit(salt)), F.lit(1000)) < int(1000 * share)
    moves = turn & (F.col("best.loss") < F.col("own_loss") - 1e-9)
    return v.join(best, ["g", "id"]).select("g", "id", "k", "inner", F.when(moves, F.col("best.com")).otherwise(F.col("com")).alias("com"))


def _level(e: DataFrame, v: DataFrame) -> DataFrame:
    """Moves of single vertices (v: g, id, k, inner) until no round brings a graph's modularity up: g, id, k, inner, com.

    A graph takes a round's moves only if they raise its modularity, so that moves made at once can't undo each other for ever."""
    now = cut(v.withColumn("com", F.col("id")))
    q, salt, idle = cut(modularities(e, now)), 0, 0
    while idle < len(MOVERS):
        new = cut(_proposed(e, now, salt, MOVERS[salt % len(MOVERS)]))
        better = cut(modularities(e, new).join(q.withColumnRenamed("q", "before"), "g").select("g", F.greatest("q", "before").alias("q"), (F.col("q") > F.col("before") + LEAST_GAIN).alias("up")))
        up = better.filter("up").select("g", F.lit(True).alias("up"))
        idle, salt = (idle + 1 if up.isEmpty() else 0), salt + 1
        if idle == 0:
            both = now.join(new.select("g", "id", F.col("com").alias("new")), ["g", "id"]).join(bounded(up), "g", "left")
            after = cut(both.select("g", "id", "k", "inner", F.when(F.col("up"), F.col("new")).otherwise(F.col("com")).alias("com")))
            forget(now, q)
            now, q = after, better.select("g", "q")
        forget(new)
    return now


def _contracted(e: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of communities: weights between them are summed up, those within become loops."""
    side = lambda n: v.select("g", F.col("id").alias(n), F.col("com").alias(f"com_{n}"))
    met = e.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).groupBy("g", F.col("com_a").alias("a"), F.col("com_b").alias("b")).agg(F.sum("w").alias("w"))
    met = cut(met)
    inner = met.filter("a = b").select("g", F.col("a").alias("id"), F.col("w").alias("more"))
    sums = v.groupBy("g", F.col("com").alias("id")).agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    return met.filter("a <> b"), cut(sums.join(inner, ["g", "id"], "left").select("g", "id", "k", (F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("inner")))


def _finished(e: DataFrame, v: DataFrame) -> DataFrame:
    """(g, id, com): graphs that are small by now, each in one task."""
    kind = dict(v.dtypes)["id"]

    def one(key, ends: pd.DataFrame, vertices: pd.DataFrame) -> pd.DataFrame:
        vertices = vertices.sort_values("id").reset_index(drop=True)
        place = pd.Series(vertices.index, index=vertices["id"])
        half = ends[ends["a"] < ends["b"]]
        label = U.louvain(len(vertices), place[half["a"]].to_numpy(), place[half["b"]].to_numpy(), weight=half["w"].to_numpy(), loops=(vertices["inner"] / 2).tolist())
        first = vertices["id"].groupby(label).transform("min")
        return pd.DataFrame({"g": key[0], "id": vertices["id"], "com": first})

    return shipped(e).groupBy("g").cogroup(v.groupBy("g")).applyInPandas(one, f"g string, id {kind}, com {kind}")


def louvain(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(g, id, com) of undirected graphs (g, src, trg): communities by local moves and contraction, named by one of their members.

    While a graph has more edges than ``task_edges``, vertices move in rounds over the whole table, and communities become the
    vertices of the next, smaller graph; graphs that are small enough, from the start or by then, are finished in a task each.
    0: all rounds are distributed. A graph ends where a level merges nothing."""
    e, v = _symmetric(edges)
    labels, done = v.select("g", "id", F.col("id").alias("com")), []
    while True:
        sizes = cut(v.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(e.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g", "left").select("g", "n", (F.coalesce("m", F.lit(0)) <= task_edges).alias("small")))
        few, rest = sizes.filter("small").select("g"), sizes.filter("not small").select("g")
        if not few.isEmpty():
            ends = _finished(e.join(bounded(few), "g", "left_semi"), v.join(bounded(few), "g", "left_semi"))
            done.append(cut(labels.join(bounded(few), "g", "left_semi").withColumnRenamed("com", "mid").join(ends.withColumnRenamed("id", "mid"), ["g", "mid"]).select("g", "id", "com")))
            labels, e, v = (cut(x.join(bounded(rest), "g", "left_semi")) for x in (labels, e, v))
        if rest.isEmpty():
            break
        moved = _level(e, v)
        labels = cut(labels.withColumnRenamed("com", "mid").join(moved.select("g", F.col("id").alias("mid"), "com"), ["g", "mid"]).select("g", "id", "com"))
        e, v = _contracted(e, moved)
        after = v.groupBy("g").agg(F.count(F.lit(1)).alias("after"))
        ended = cut(sizes.join(after, "g").filter("after = n or after = 1").select("g"))  # nothing was merged, or all
        if not ended.isEmpty():
            done.append(cut(labels.join(bounded(ended), "g", "left_semi")))
            labels, e, v = (cut(x.join(bounded(ended), "g", "left_anti")) for x in (labels, e, v))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def communities(edges: DataFrame, key: str, largest: int = 200, least: float = 0.5, task_edges: int = TASK_EDGES) -> DataFrame:
    """(key, id, community) of each interval's undirected graph (key, src, trg): Louvain, and again within communities of more than ``largest``
    vertices while that gives a modularity of at least ``least``. Communities are numbered from 0 in each interval, by their least vertex.

    Graphs of any size: see ``louvain``. Parts that are looked into again are graphs of their own in the next pass. Edges with a null end
    are left out."""
    rows = cut(edges.filter("src is not null and trg is not null").select(F.col(key).alias("_key"), F.coalesce(F.concat(F.lit("="), F.hex(F.col(key).cast("string"))), F.lit("")).alias("g"), "src", "trg"))
    keys = rows.select("g", "_key").distinct()
    now, settled = rows.select("g", "src", "trg"), []
    trial = None
    while True:
        label = louvain(now, task_edges)
        if trial is not None:  # parts whose modularity is too low stay whole
            e, v = _symmetric(now)
            good = modularities(e, v.join(label, ["g", "id"])).filter(F.col("q") >= least).select("g")
            several = label.groupBy("g").agg(F.min("com").alias("x"), F.max("com").alias("y")).filter("x <> y").select("g")
            good = cut(good.join(several, "g"))
            settled.append(cut(label.join(bounded(good), "g", "left_anti").select("g", "id")))
            label = label.join(bounded(good), "g", "left_semi")
        label = cut(label.select(F.concat_ws("/", "g", F.hex(F.col("com").cast("string"))).alias("g"), "id", F.col("g").alias("of")))
        large = cut(label.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest).select("g"))
        settled.append(cut(label.join(bounded(large), "g", "left_anti").select("g", "id")))
        if large.isEmpty():
            break
        inside = label.join(bounded(large), "g", "left_semi")
        side = lambda n: inside.select(F.col("of").alias("g"), F.col("id").alias(n), F.col("g").alias(f"part_{n}"))  # noqa: E731, B023
        trial = cut(now.join(side("src"), ["g", "src"]).join(side("trg"), ["g", "trg"]).filter("part_src = part_trg").select(F.col("part_src").alias("g"), "src", "trg"))
        now = trial
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    out = out.withColumn("part", F.col("g")).withColumn("g", F.regexp_extract("g", "^(=[0-9A-F]*|)", 1))
    named = out.groupBy("g", "part").agg(F.min("id").alias("first"))
    order = placed(named, [F.asc("g"), F.asc("first")], "number")
    base = order.groupBy("g").agg(F.min("number").alias("base"))
    number = order.join(bounded(base), "g").select("g", "part", (F.col("number") - F.col("base")).cast("int").alias("community"))
    return out.join(number, ["g", "part"]).join(bounded(keys), "g").select(F.col("_key").alias(key), "id", "community")


# -------------------------------------------------------------- G5 influencers


def _running(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Rows (g, rank, tie, ..) with running sums by name in the order of g and rank, begun anew for each g."""
    out = cut(running_sums(rows, [F.asc("g"), *order], sums))
    base = out.groupBy("g").agg(*[F.min_by(F.col(name) - F.col(weight), F.struct("rank", "tie")).alias(f"base_{name}") for name, weight in sums.items()])
    met = out.join(bounded(base), "g")
    return met.select(*rows.columns, *[(F.col(name) - F.col(f"base_{name}")).alias(name) for name in sums])


def _value(e_ab, a_a, b_b):
    """The objective over raw edge counts; 1 where its denominator is 0."""
    product = a_a.cast("double") * b_b.cast("double")
    return F.when(product == 1, F.lit(1.0)).otherwise((e_ab - product) / (1 - product))


def _counts(e: DataFrame, v: DataFrame) -> DataFrame:
    """(g, e_ab, a_a, b_b): edges from A to B, edges out of A, edges into B."""
    met = e.join(v.select("g", F.col("id").alias("src"), F.col("top").alias("s")), ["g", "src"]).join(v.select("g", F.col("id").alias("trg"), F.col("top").alias("t")), ["g", "trg"])
    return met.groupBy("g").agg(F.sum(F.when(F.col("s") & ~F.col("t"), F.col("n")).otherwise(0)).alias("e_ab"), F.sum(F.when(F.col("s"), F.col("n")).otherwise(0)).alias("a_a"), F.sum(F.when(~F.col("t"), F.col("n")).otherwise(0)).alias("b_b"))


def core_sides(edges: DataFrame, key: str, share: float = 0.5, rounds: int = 100) -> DataFrame:
    """(key, id, influential) of the vertices of each interval's directed graph (key, src, trg).

    A first cut by out-degree (most first, until the degrees before reach the share of all edges), then moves between the sides while the
    objective (e_AB - a_A * b_B) / (1 - a_A * b_B) over raw edge counts improves. Candidates are the first cut, and others whose
    out-degree is at least a tenth of its mean.

    Moves go in batches: candidates stand in the order of what each brings alone; the objective of each prefix comes from running sums
    over range partitions, as an edge changes sides only at the ranks of its ends; the best prefix moves, also beyond moves that alone bring
    nothing. The first candidate alone is a prefix, so it ends where no single move improves."""
    rows = edges.filter("src is not null and trg is not null").select(F.col(key).alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("g"), "src", "trg")
    rows = cut(rows.groupBy("_key", "g", "src", "trg").agg(F.count(F.lit(1)).alias("n")))
    e, keys = rows.select("g", "src", "trg", "n"), rows.select("g", "_key").distinct()
    ends = e.select("g", F.col("src").alias("id"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i")).unionByName(e.select("g", F.col("trg").alias("id"), F.lit(0).cast("long").alias("o"), F.col("n").alias("i")))
    degree = cut(ends.groupBy("g", "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")))
    ranked = _running(degree.withColumn("rank", -F.col("o")).withColumn("tie", F.col("id")), [F.asc("rank"), F.asc("tie")], {"sum": "o"})
    total = e.groupBy("g").agg(F.sum("n").alias("m"))
    first = ranked.join(bounded(total), "g").select("g", "id", "o", "i", ((F.col("sum") - F.col("o") < share * F.col("m")) & (F.col("o") > 0)).alias("top"))
    mean = first.filter("top").groupBy("g").agg(F.avg("o").alias("mean"))
    now = cut(first.join(bounded(mean), "g", "left").select("g", "id", "o", "i", "top", (F.col("top") | ((F.col("o") > 0) & (F.col("o") >= 0.1 * F.coalesce("mean", F.lit(0.0))))).alias("free")))
    for _ in range(rounds):
        counts = cut(_counts(e, now))
        met = e.join(now.select("g", F.col("id").alias("src"), F.col("top").alias("s")), ["g", "src"]).join(now.select("g", F.col("id").alias("trg"), F.col("top").alias("t")), ["g", "trg"])
        # edges from A into a vertex, from it into B, and its loops
        near = met.select("g", F.col("src").alias("id"), F.when((F.col("src") != F.col("trg")) & ~F.col("t"), F.col("n")).otherwise(0).alias("to_b"), F.lit(0).cast("long").alias("from_a"))
        near = near.unionByName(met.select("g", F.col("trg").alias("id"), F.lit(0).cast("long").alias("to_b"), F.when((F.col("src") != F.col("trg")) & F.col("s"), F.col("n")).otherwise(0).alias("from_a")))
        near = near.groupBy("g", "id").agg(F.sum("to_b").alias("to_b"), F.sum("from_a").alias("from_a"))
        sign = F.when(F.col("top"), -1).otherwise(1)  # out of A, or into it
        alone = _value(F.col("e_ab") + sign * (F.col("to_b") - F.col("from_a")), F.col("a_a") + sign * F.col("o"), F.col("b_b") - sign * F.col("i"))
        is_now = _value(F.col("e_ab"), F.col("a_a"), F.col("b_b"))
        tries = now.filter("free").join(near, ["g", "id"]).join(bounded(counts), "g").withColumn("gain", alone - is_now)
        tries = placed(tries.select("g", "id", "o", "i", "top", "gain"), [F.asc("g"), F.desc("gain"), F.asc("id")], "rank")
        tries = cut(tries)
        # what changes at each rank: a vertex's own edges, and, of each edge, whether it is from A to B before and after
        own = tries.select("g", "rank", F.lit(0).cast("long").alias("d_ab"), (sign * F.col("o")).alias("d_a"), (-sign * F.col("i")).alias("d_b"))
        of = lambda n: tries.select("g", F.col("id").alias(n), F.col("rank").alias(f"r_{n}"))  # noqa: E731, B023
        touched = met.join(of("src"), ["g", "src"], "left").join(of("trg"), ["g", "trg"], "left").filter("r_src is not null or r_trg is not null")
        far = F.lit(1 << 62)
        rs, rt = F.coalesce("r_src", far), F.coalesce("r_trg", far)
        s_at, t_at = lambda r: F.col("s") != (rs <= r), lambda r: F.col("t") != (rt <= r)
        counted = lambda r: (s_at(r) & ~t_at(r)).cast("long")
        low, high = F.least(rs, rt), F.greatest(rs, rt)
        was = (F.col("s") & ~F.col("t")).cast("long")
        steps = F.filter(F.array(F.struct(low.alias("rank"), ((counted(low) - was) * F.col("n")).alias("d")), F.struct(F.when((high < far) & (high > low), high).alias("rank"), ((counted(high) - counted(low)) * F.col("n")).alias("d"))), lambda x: x["rank"].isNotNull())
        changes = touched.select("g", F.explode(steps).alias("x")).select("g", "x.rank", F.col("x.d").alias("d_ab"), F.lit(0).cast("long").alias("d_a"), F.lit(0).cast("long").alias("d_b"))
        deltas = cut(own.unionByName(changes).groupBy("g", "rank").agg(*[F.sum(c).alias(c) for c in ("d_ab", "d_a", "d_b")]).withColumn("tie", F.lit(0)))
        sums = _running(deltas, [F.asc("rank")], {"s_ab": "d_ab", "s_a": "d_a", "s_b": "d_b"})
        prefix = sums.join(bounded(counts), "g").withColumn("value", _value(F.col("e_ab") + F.col("s_ab"), F.col("a_a") + F.col("s_a"), F.col("b_b") + F.col("s_b")))
        last = F.max_by(F.struct("rank", "value"), F.struct("value", -F.col("rank"))).alias("last")
        best = prefix.groupBy("g").agg(last).join(bounded(counts), "g").filter(F.col("last.value") > is_now + 1e-12)
        best = cut(best.select("g", F.col("last.rank").alias("last")))
        if best.isEmpty():
            forget(counts, tries, deltas)
            break
        moves = tries.join(bounded(best), "g").filter("rank <= last").select("g", "id", F.lit(True).alias("moves"))
        after = cut(now.join(moves, ["g", "id"], "left").select("g", "id", "o", "i", (F.col("top") != F.coalesce("moves", F.lit(False))).alias("top"), "free"))
        forget(now, counts, tries, deltas)
        now = after
    return now.join(bounded(keys), "g").select(F.col("_key").alias(key), "id", F.col("top").alias("influential"))


def influencers(edges: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """(key, id) of the influential vertices of each interval's graph (``core_sides``)."""
    return core_sides(edges, key, share).filter("influential").select(key, "id")
