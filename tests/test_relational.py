"""Joins, aggregates, intervals, vectors and graphs on literal fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import aggregates as A
from tidemark.operators import communities as C
from tidemark.operators import graphs as G
from tidemark.operators import grouped as U
from tidemark.operators import intervals as I
from tidemark.operators import joins as J
from tidemark.operators import models as L
from tidemark.sources import tables as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_profile_ties_and_nulls(spark):
    p = spark.createDataFrame([("u", "r", None, None, None, "20240101000000")] * 2 + [("u", "t", [0, 2], None, None, "20240101000010"), ("u", "t", [2], None, None, "20240101000005")], "usr_id string, tw_type string, l_nars array<int>, l_stances array<double>, l_sentiments array<double>, tw_datetime string")
    r = A.user_profile(p, 3).first()
    assert (r.top_act_type, r.top_act_ratio, r.nar_sum_vec, r.nar_miss_ratio, r.tw_dt_dur, r.stance_avg) == ("t", 0.5, [1.0, 0.0, 2.0], 0.5, 10, [None, None, None])


def test_missing_source_keeps_the_row(spark):
    p = spark.createDataFrame([("a", None), ("b", "a"), ("c", "zz"), ("a", None)], "tw_id string, tw_src_id string")
    assert rows(J.with_source(p).select("trg_tw_id", "src_tw_id")) == [("a", None), ("a", None), ("b", "a"), ("c", None)]


def test_intervals(spark):
    h = I.hopping(spark, "20240101", "20240110")
    assert rows(h.select("idx", "key"))[:2] == [(0, "20240101_20240107"), (1, "20240104_20240110")]
    p = spark.createDataFrame([("x", "2024-01-05 00:00:00"), ("y", "2024-01-07 12:00:00"), ("z", "2023-12-31 00:00:00")], "id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert rows(J.in_intervals(p, h, "at").select("id", "idx")) == [("x", 0), ("y", 1), ("z", None)]
    assert rows(J.in_intervals(p, h, "at", "all").select("id", "idx")) == [("x", 0), ("x", 1), ("y", 1), ("y", 2)]
    assert I.hopping(spark, "20240110", "20240101").count() == 0


def test_fixed_windows(spark):
    p = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00"), (3, "2024-01-03 00:00:01"), (4, "2024-01-20 00:00:00")], "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert rows(I.fixed_windows(p, "at", "2024-01-01 00:00:00", "2024-01-31 00:00:00", 2).select("id", "win_idx")) == [(2, 0), (3, 1), (4, 9)]
    assert rows(I.fixed_windows(p, "at", "2024-01-01 00:00:00", "2024-01-31 00:00:00", 2, "left").select("id", "win_idx")) == [(1, 0), (2, 1), (3, 1), (4, 9)]


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def arr(*x):
    return F.array(*[F.lit(float(i)) for i in x])


def test_divergences(spark):
    assert value(spark, V.js(arr(1, 0), arr(0, 1))) == pytest.approx(math.sqrt(math.log(2)))
    assert value(spark, V.js(arr(1, 0), arr(0, 1), 2)) == pytest.approx(1.0)
    assert value(spark, V.js(arr(2, 2), arr(1, 1))) == pytest.approx(0) and value(spark, V.js(arr(0, 0), arr(1, 1))) is None and value(spark, V.js(arr(0, 0), arr(1, 1), sentinel=-0.1)) == -0.1
    assert value(spark, V.wasserstein(arr(0, 1, 3), arr(5, 6, 8))) == pytest.approx(5.0) and value(spark, V.wasserstein(arr(1), arr(1))) == 0
    r = random.Random(0)
    for _ in range(5):
        p, q = ([r.random() for _ in range(4)] for _ in range(2))
        d = value(spark, V.js(arr(*p), arr(*q)))
        assert 0 <= d <= math.sqrt(math.log(2)) and d == pytest.approx(value(spark, V.js(arr(*q), arr(*p))))


def test_long_divergence_equals_dense(spark):
    n = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "y", 2), ("b", "z", 2), ("c", "w", 1)], "k string, t string, n long")
    got = {(i, j): d for i, j, d in rows(G.js_long(n, "k", "t"))}
    dense = {"a": (3, 1, 0, 0), "b": (0, 2, 2, 0), "c": (0, 0, 0, 1)}
    for (i, j), d in got.items():
        assert d == pytest.approx(value(spark, V.js(arr(*dense[i]), arr(*dense[j]))), abs=1e-7)
    assert len(got) == 3


def test_weights(spark):
    e = spark.createDataFrame([("a", "b", "r")] + [("a", "c", "t")] * 3 + [("b", "c", "q")] * 5 + [("x", "y", "n"), ("", "y", "r")], "src string, trg string, kind string")
    assert rows(A.interaction_counts(e).select("src", "trg", "a", "weight")) == [("a", "b", 1, 0.0), ("a", "c", 3, 0.5), ("b", "c", 5, 1.0)]
    assert {r.weight for r in A.interaction_counts(e.filter("trg = 'b'")).collect()} == {0.0}


def test_transitions(spark):
    p = spark.createDataFrame([("s1", 0, 1.0), ("t1", 1, 1.0), ("s2", 0, 0.5), ("s2", 1, 0.5), ("t2", 0, 1.0)], "tw_id string, cid int, p double")
    pairs = spark.createDataFrame([("s1", "t1"), ("s2", "t2")], "src string, trg string")
    got = {(i, j): v for i, j, v in rows(A.transitions(pairs, p))}
    assert got == pytest.approx({(0, 0): 1 / 3, (0, 1): 2 / 3, (1, 0): 1.0})


def test_components_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, trg string")
    assert rows(G.components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    ends = {r.id: (r.is_root, r.is_leaf) for r in G.roots_and_leaves(e).collect()}
    assert {k for k, v in ends.items() if v[1]} == {"c", "e"} and {k for k, v in ends.items() if v[0]} == {"a", "d"}
    assert ("a", "c", 2) in rows(G.shortest_paths(e)) and rows(G.leaf_paths(e)) == [("a", 1, 2.0, 0.0), ("d", 1, 1.0, 0.0)]
    more = e.unionByName(spark.createDataFrame([("a", "c")], "src string, trg string"))
    assert ("a", "c", 1) in rows(G.shortest_paths(more)) and ("a", "c", 2) in rows(G.longest_paths(more))
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, trg long")
    assert rows(G.expansion(spark, loop, 1)) == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(ValueError, match="cycle"):
        G.longest_paths(loop)


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, trg long")
    assert {r.component for r in G.components(e).collect()} == {0}


def test_scores(spark):
    r = random.Random(1)
    pairs = [(r.randrange(4), r.randrange(3)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a int, b int")
    s = G.label_scores(df, "a", "b").first()
    assert G.label_scores(df, "a", "a").first().nmi == pytest.approx(1.0) and G.label_scores(df, "a", "a").first().ari == pytest.approx(1.0)
    same = sum(x[0] == y[0] and x[1] == y[1] for i, x in enumerate(pairs) for y in pairs[:i])
    one, two = (sum(x[k] == y[k] for i, x in enumerate(pairs) for y in pairs[:i]) for k in (0, 1))
    assert s.fowlkes_mallows == pytest.approx(same / math.sqrt(one * two))
    v = spark.createDataFrame([(1, 3.0, 2.0), (2, 1.0, 1.0), (3, 2.0, 2.0), (4, 2.0, 9.0)], "id int, x double, y double")
    assert G.spearman(v, "x", "y").first().rho == pytest.approx(np.corrcoef([4, 1, 2.5, 2.5], [2.5, 1, 2.5, 4])[0, 1])


def test_similarity_joins(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(23, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 5)], "id int, vec array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4, 100):
        got = {(a, b): s for a, b, s in rows(J.similar_pairs(df, "id", "vec", block=block))}
        assert len(got) == 24 * 23 / 2 and all(got[a, b] == pytest.approx(unit[a] @ unit[b]) for a, b in got if b != 99) and got[0, 99] == 0
    assert len(rows(J.similar_pairs(df, "id", "vec", diagonal=True, block=5))) == 24 * 25 / 2
    c = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0, 0.0])], "cid int, cvec array<double>")
    near = {r.id: r.cid for r in J.nearest_centre(df, c).collect()}
    assert near[99] == 0 and all(near[i] == (0 if x[i, 0] >= x[i, 1] else 2) for i in range(23))


def test_pairs_in_matrix_tiles(spark, monkeypatch):
    """Tiles of several blocks: no pair is made a row for a sum, groups of one row and missing vectors count, and pairs' means need no shuffle of pairs."""
    from tidemark.operators import intervals as I

    r = np.random.default_rng(2)
    x = r.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(90, None, 0), (91, [1.0, 2.0], 1), (92, [1.0, 0.0, 0.0], 9), (93, [1.0, 0.0, 0.0], None)], "id int, vec array<double>, g int")
    monkeypatch.setattr(J, "PAIR_ROWS", 8)
    for block in (5, 1000):
        pairs = J.similar_pairs(df, "id", "vec", "g", block=block).collect()
        assert len(pairs) == (15 * 14 + 14 * 13 + 13 * 12) // 2
        sums = {s.w: (s.pairs, s.total) for s in J.similarity_sums(df, "id", "vec", "g", block=block).collect()}
        for g in range(3):
            mine = [p.similarity for p in pairs if p.g == g]
            assert sums[g] == (len(mine), pytest.approx(sum(mine)))
    t = G.affinity_totals(df, "id", "vec", "g").first()
    assert t.n == 2 * len(pairs) + 44 and t.total == pytest.approx(sum(p.similarity + 1 for p in pairs))
    mixes = {(u, d): r.integers(0, 3, 4).astype(float).tolist() for u in range(9) for d in range(5) if r.random() < 0.8}
    days = spark.createDataFrame([(f"u{u}", d, v) for (u, d), v in mixes.items()], "u string, d int, v array<double>")
    want = A.spread(I.pair_distances(days, "u", "v", "d"), ["i", "j"], "js").filter("mean <= 0.4").collect()
    for cells in (1 << 20, 0):
        monkeypatch.setattr(I, "CLASS_CELLS", cells)
        monkeypatch.setattr(I, "PAIR_ROWS", 4)
        got = {(p.i, p.j): p for p in I.pair_means(days, "u", "v", "d", 0.4).collect()}
        assert want and got.keys() == {(p.i, p.j) for p in want}
        assert all(got[p.i, p.j].mean == pytest.approx(p["mean"]) and got[p.i, p.j].support == p.support for p in want)


def test_ids(spark):
    known = spark.createDataFrame([("b", 0), ("d", 1)], "phrase string, phid long")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "phrase string")
    assert rows(J.with_ids(new, known)) == [("a", 2), ("b", 0), ("c", 3)]
    assert rows(J.numbered(spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "v int"), "v", "n")) == [(1, 0), (3, 1), (5, 2), (9, 3)]


def test_other_joins(spark):
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    assert rows(J.upserted(t, spark.createDataFrame([("2", None), ("3", "z")], "id string, v string"), "id", "v")) == [("1", "a"), ("2", "b"), ("3", "z")]
    a = spark.createDataFrame([("k", 0.5)], "key string, similarity double")
    b = spark.createDataFrame([("k", 0.1), ("m", 0.2)], "key string, distance double")
    assert rows(J.matched_pairs(a, b, "key")) == [("k", 0.5, 0.1, False), ("m", 0.0, 0.2, True)]
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "z")], "src string, trg string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "id string, vec array<double>")
    assert rows(J.graph_pair_similarity(e, v)) == [("a", "b", 1.0), ("a", "z", 0.0)]


def test_communities(spark):
    e = [(0, a, b) for c in (0, 10) for a in range(c, c + 6) for b in range(a + 1, c + 6)] + [(0, 0, 10)]
    got = {r.id: r.community for r in C.communities(spark.createDataFrame(e, "t int, src int, trg int"), "t").collect()}
    assert len(got) == 12 and len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]
    top = U.core_periphery(5, np.array([0, 0, 0, 0, 1]), np.array([1, 2, 3, 4, 2]))
    assert top[0] and top.sum() <= 2


def test_topic_clusters(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    df = spark.createDataFrame([(0, f"t{i}", [x + 0.01 * i for x in (a if i < 4 else b)]) for i in range(8)], "component int, topic string, vec array<double>")
    got = {r.topic: r.cluster for r in U.topic_clusters(df).collect()}
    assert {got[f"t{i}"] for i in range(4)} == {"t0"} and {got[f"t{i}"] for i in range(4, 8)} == {"t4"}
    again = spark.createDataFrame([(0, f"t{i}", a if i != 6 else [0.0, 0.0, 1.0], "big" if i < 5 else "small") for i in range(7)], "k int, topic string, vec array<double>, cluster string")
    got = {r.topic: r.cluster for r in U.reassigned(again, "k").collect()}
    assert got["t5"] == "big" and got["t6"] == "tc_0"


def test_leader_nodes(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(([1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [1.0, 0.05]))], "k string, n int, vec array<double>")
    nodes = U.leader_nodes(df, "k", "n")
    assert [r.node for r in nodes.orderBy("n").collect()] == [0, 0, 1, 0]
    assert rows(U.node_edges(nodes, "k", "n")) == [("k", 0, 0, 1), ("k", 0, 1, 1), ("k", 1, 0, 1)]


def test_clause_graphs(spark):
    tok = lambda i, lemma, pos, dep, head, **m: {"i": i, "text": lemma, "lemma": lemma, "pos": pos, "dep": dep, "head": head, "phrase": None, "trivial": False} | m
    tokens = [tok(0, "dog", "NOUN", "nsubj", 1, phrase="big dog"), tok(1, "chase", "VERB", "ROOT", 1), tok(2, "the", "DET", "det", 3, trivial=True), tok(3, "cat", "NOUN", "dobj", 1), tok(4, "mouse", "NOUN", "conj", 3)]
    nodes, edges = U.clause_graph("s|0", tokens)
    assert ("s|0|0", "big dog", "NOUN") in nodes and ("s|0|1", "s|0|0") in edges and ("s|0|1", "s|0|3") in edges and ("s|0|1", "s|0|4") in edges and len(nodes) == 4
    x = {"big": np.array([1.0, 0]), "dog": np.array([1.0, 0]), "chase": np.array([0, 1.0]), "cat": np.array([0, 2.0])}
    assert U.clause_vector(nodes, edges, x, 2).tolist() == [0.5, 0.75] and U.clause_vector([], [], x, 2).tolist() == [0, 0]
    assert np.isfinite(U.clause_vector(nodes, edges, x, 2, "sp_w_avg_edge")).all()
    df = spark.createDataFrame([("s", U.graph_json(nodes, edges[:1]))], "id string, g string")
    pairs, alone = U.graph_pairs(F.col("g"))
    r = df.select(pairs.alias("p"), alone.alias("a")).first()
    assert [(p.txt1, p.txt2, p.pos) for p in r.p] == [("chase", "big dog", "VERB_NOUN")] and {a.txt for a in r.a} == {"cat", "mouse"}
    g = ([(0, "dog", "N"), (1, "cat", "N")], [(0, 1)])
    assert U.edit_distance(g, g) == 0 and U.edit_distance(g, ([], [])) == pytest.approx(81 / 81)
    assert U.heat(np.array([[0, 1.0], [1.0, 0]])).sum() == pytest.approx(2 * 3)


def test_models(spark):
    t = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a"), ("d2", "c"), ("d2", "c"), ("d3", "c")], "k string, t string")
    w = L.tf_idf(t, "k", "t", 1.0)
    assert all(s == pytest.approx(1.0) for _, s in rows(w.groupBy("k").agg(F.sum(F.col("w") * F.col("w")))))
    x = np.abs(np.random.default_rng(0).normal(size=(12, 3))) @ np.abs(np.random.default_rng(1).normal(size=(3, 9)))
    a, b = L.factors(np.repeat(np.arange(12), 9), np.tile(np.arange(9), 12), x.ravel(), x.shape, 3, 500)
    assert np.abs(a @ b - x).max() < 0.2
    s = {r.k: r.compound for r in L.sentiment(spark.createDataFrame([("a", "great GOOD"), ("b", None), ("c", "bad")], "k string, t string"), "k", "t").collect()}
    assert s["a"] > 0.7 and s["b"] == 0 and s["c"] < 0
    one, two = L.split(spark.range(1000), "id")
    assert one.count() + two.count() == 1000 and 750 < one.count() < 850


def test_subsequences(spark):
    df = spark.createDataFrame([("u", f"2024010{i}_x", [float(i), 1.0]) for i in (1, 2, 3)] + [("v", "20240101_x", [0.0, 0.0]), ("v", "20240102_x", [0.0, 0.0])], "k string, step string, vec array<double>")
    ev = spark.createDataFrame([("20240102", [9.0])], "event_day string, event_vec array<double>")
    got = I.subsequences(df, "k", "step", "vec", 3, ev).collect()
    assert sorted((r.k, r.len) for r in got) == [("u", 2), ("u", 2), ("u", 3)]
    r = next(r for r in got if r.len == 3)
    assert r.truth == [3.0, 1.0] and r.inputs[-1].vec == [0.0, 0.0] and r.inputs[1].event_vec == [9.0]


def test_streams(spark, tmp_path):
    from tidemark.streaming import twins

    rows_ = [(f"2024-01-{d:02d} 00:00:00", "click" if d % 2 else "view", float(d)) for d in range(1, 29)]
    df = spark.createDataFrame(rows_, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = twins.read_stream(spark, str(tmp_path / "in"), df.schema)
    q = twins.to_parquet(twins.tumbling_counts(stream, "ts", "kind", "value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = df.groupBy(F.window("ts", "7 days").start.alias("win_start"), "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))
    assert got.count() >= 6 and got.join(batch, ["win_start", "kind", "n", "avg_value"], "left_anti").count() == 0


@pytest.mark.parametrize("parts", [2, 4, 16])
def test_numbers_and_ranks_of_many_rows(spark, parts):
    """Each number once, whatever other columns there are and however the plans that read them are pruned."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(50_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("extra"), F.md5(F.col("id").cast("string")).alias("more"))
        got = J.numbered(df, "k", "n", 10)
        assert got.select("n", "extra").agg(F.countDistinct("n"), F.min("n"), F.max("n")).first() == (50_000, 10, 50_009)
        rows = [r.n for r in got.orderBy("k").select("n").collect()]
        assert rows == list(range(10, 50_010))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spearman_of_many_rows(spark):
    df = spark.range(40_000).select((F.xxhash64("id") % 5000).alias("a"), ((F.xxhash64("id") % 5000) / 100 + F.rand(3) * 40).cast("int").alias("b"))
    df = df.unionByName(spark.createDataFrame([(None, 1), (2, None)], "a long, b int"))
    pdf = df.dropna().toPandas()
    got = G.spearman(df, "a", "b").first()
    assert got.n == len(pdf) and abs(got.rho - pdf["a"].rank().corr(pdf["b"].rank())) < 1e-9


@pytest.mark.parametrize(("text", "want"), [
    ("VADER is smart, handsome, and funny.", 0.8316), ("VADER is smart, handsome, and funny!", 0.8439), ("VADER is very smart, handsome, and funny.", 0.8545), ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342), ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469), ("VADER is not smart, handsome, nor funny.", -0.7424), ("The book was good.", 0.4404),
    ("At least it isn't a horrible book.", 0.431), ("Today only kinda sux! But I'll get by, lol", 0.5249), ("The book was kind of good.", 0.3832), ("", 0.0), (None, 0.0), ("no value here", 0.0),
])
def test_published_sentiment_examples(text, want):
    lexicon = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "sux": -1.5, "lol": 1.8}
    assert round(L.rule_valence(text, lexicon), 4) == want


def test_nmf_against_arrays(spark):
    rng = np.random.default_rng(3)
    x = rng.random((7, 2)) @ rng.random((2, 9))
    cells = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i in range(7) for j in range(9)], "key int, term string, w double")
    w, h = L.nmf(cells, "key", "term", 2, 12)
    w, h = (np.array([r.vec for r in f.orderBy(f.columns[0]).collect()]) for f in (w, h))
    assert (w >= 0).all() and np.abs(w @ h.T - x).max() < 0.15 * x.max()
    a, b = L.factors(np.repeat(np.arange(7), 9), np.tile(np.arange(9), 7), x.ravel(), (7, 9), 2, 400)
    assert np.abs(a @ b - x).max() < 0.05


def test_edit_paths_against_all_mappings():
    from itertools import permutations

    r = random.Random(2)
    for _ in range(30):
        graphs = []
        for tag in "ab":
            n = r.randrange(0, 4)
            nodes = [(f"{tag}{i}", r.choice(("red car", "red", "dog", "car")), r.choice(("NOUN", "VERB"))) for i in range(n)]
            graphs.append((nodes, [(f"{tag}{i}", f"{tag}{j}") for i in range(n) for j in range(i) if r.random() < 0.5]))
        (n1, e1), (n2, e2) = graphs
        found = []
        slots = list(range(len(n2))) + [None] * len(n1)
        for way in set(permutations(slots, len(n1))):
            cost, pos, to = 40.0 * (len(n2) - sum(j is not None for j in way)), 0, {}
            for a, j in zip(n1, way, strict=True):
                if j is None:
                    cost += 40
                    continue
                x, y = set(a[1].split()), set(n2[j][1].split())
                cost += 0 if x == y else 40 if not x & y else 40 * (1 - len(x & y) / len(x | y))
                pos, to[a[0]] = pos + (a[2] != n2[j][2]), n2[j][0]
            mapped = {frozenset(to.get(x, x) for x in e) for e in e1}
            edges = len(mapped ^ {frozenset(e) for e in e2})
            found.append((round(cost + edges, 6), pos, edges))
        size = 40 * (len(n1) + len(n2)) + len(e1) + len(e2)
        got = U.edit_paths(*graphs)
        best = min(found) if found else (0, 0, 0)
        assert round(got[0] * size, 6) == best[0] and got[1:] == best[1:]


def test_jdbc_ranges(spark):
    """A table of an in-memory database, in ranges of a column."""
    url = "jdbc:derby:memory:tidemark;create=true"
    rows_in = [(i, f"n{i}") for i in range(50)]
    spark.createDataFrame(rows_in, "id int, name string").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    back = S.read_jdbc(spark, url, "t", "id", 0, 50, 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.rdd.getNumPartitions() == 4 and rows(back) == sorted(rows_in, key=repr)


def test_a_group_beyond_the_bound_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")], "k int, x string")
    assert U.within_bound(df, "k", 5) is df
    with pytest.raises(ValueError, match="k 1 has 5 rows"):
        U.within_bound(df, "k", 4)


def test_noun_phrases_of_the_stand_in_parser():
    sentence = U.rule_parser("The big red car and a dog ran")[0]
    assert [t["phrase"] for t in sentence if t["phrase"]] == ["big red car", "dog ran"] and [t["text"] for t in sentence if not t["trivial"]] == ["car", "ran"]


def test_deep_walk_keeps_few_branches(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(5, 30), (30, 6)], "src int, trg int")
    got = {r.id: r.depth for r in G.shortest_paths(edges).collect()}
    assert got == {i: i for i in range(21)} | {30: 6} and {r.id: r.depth for r in G.expansion(spark, edges, 4).collect()} == {i: i - 4 for i in range(4, 21)} | {30: 2}


def test_tf_idf_reads_the_tokens_once(spark):
    """counts, documents' frequencies and lengths come from one pass over the tokens."""
    from tidemark.operators import models as L

    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(k, t) for k in range(6) for t in "abcd"[: k % 4 + 1] * 2]
    tokens = spark.createDataFrame(rows, "k int, t string").mapInPandas(passed, "k int, t string")
    w = L.tf_idf(tokens, "k", "t", 1.0).collect()
    assert seen.value == len(rows)
    assert len(w) == len(set(rows)) and all(abs(sum(r.w**2 for r in w if r.k == k) - 1) < 1e-9 for k in range(6))


def test_lda_rounds_read_counts(spark):
    """the vocabulary and the counts take four passes over the tokens; rounds and inference work on counts that were written."""
    from tidemark.operators import models as L

    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    words = [["sun", "moon", "star"], ["sun", "star", "star"], ["cat", "dog"], ["cat", "dog", "dog"], None, ["lone"], ["sun", "cat"]]
    tokens = spark.createDataFrame(list(enumerate(words)), "id int, words array<string>").mapInPandas(passed, "id int, words array<string>")
    terms, dist = L.lda_topics(tokens, "id", "words", k=2, rounds=3)
    got = {r.id: r.dist for r in dist.collect()}
    assert seen.value <= 4 * len(words)
    assert set(got) == set(range(7)) and got[4] == got[5] == [0.0, 0.0] and all(abs(sum(got[i]) - 1) < 1e-9 for i in (0, 1, 2, 3, 6))
    assert {r.term for r in terms.collect()} == {"sun", "star", "cat", "dog"}


def test_weighted_vectors_sum_one_row_a_key(spark):
    """no (key, element) rows; vectors of other lengths, keys without a vector and null keys as before."""
    from tidemark.operators import aggregates as A

    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 9, 5.0), (2, 9, 1.0), (3, 3, 4.0), (None, 1, 1.0), (1, 1, None)], "k int, item int, w double")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [10.0]), (3, []), (4, None)], "item int, vec array<double>")
    out = A.weighted_vectors(rows, vectors, "k", "item", "w")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.vec for r in out.collect()} == {1: [32 / 4, 4 / 4], 2: None, 3: None, None: None}


def test_semantic_units_take_pieces_of_a_batch(spark, monkeypatch):
    """what is made Python objects of at once is a piece, not a batch; keys and order stay, texts without a word go."""
    monkeypatch.setattr(U, "PIECE_ROWS", 3)
    texts = spark.createDataFrame([(i, None if i == 2 else "..." if i == 5 else f"red cars of town {i} and green hills") for i in range(11)], "id long, txt string").coalesce(1)
    out = U.semantic_units(texts, "id", "txt")
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in out.collect()] == [0, 1, 3, 4, 6, 7, 8, 9, 10]
    assert out.first().nps[0] == "red cars" and '"0|0|1"' in out.first().cls_json


def test_factors_by_blocks_against_the_join(spark, monkeypatch):
    """F8: cells packed into several blocks give the factors that a join of each cell gives; repeated cells add up, cells with a null are left out."""
    from tidemark.operators import sparse

    rng = np.random.default_rng(4)
    rows = [(int(i), f"t{j}", float(rng.random())) for i in range(40) for j in range(60) if rng.random() < 0.2] + [(1, "t1", 0.5), (1, "t1", 0.25), (2, "lonely", 1.0)]
    cells = spark.createDataFrame(rows, "i int, j string, w double")
    with_nulls = cells.unionByName(spark.createDataFrame([(None, "t1", 1.0), (1, None, 1.0), (1, "t2", None)], "i int, j string, w double"))
    monkeypatch.setattr(sparse, "BLOCK_CELLS", 80)
    monkeypatch.setattr(sparse, "LEAST_CELLS", 10)
    monkeypatch.setattr(L, "joined_factors", None)
    dense = lambda f: {r[0]: np.array(r[1]) for r in f.collect()}
    (w0, h0), (w, h) = ([dense(f) for f in L.nmf(with_nulls, "i", "j", 3, rounds, tolerance=0.0)] for rounds in (0, 3))
    keys, terms = sorted(w), sorted(h)
    assert keys == sorted({r[0] for r in rows}) and terms == sorted({r[1] for r in rows})
    x = np.zeros((len(keys), len(terms)))
    for i, j, value in rows:
        x[keys.index(i), terms.index(j)] += value
    a, b = np.array([w0[i] for i in keys]), np.array([h0[j] for j in terms])
    for _ in range(3):
        b = b * (x.T @ a) / np.maximum(b @ (a.T @ a), 1e-12)
        a = a * (x @ b) / np.maximum(a @ (b.T @ b), 1e-12)
    assert np.allclose(a, [w[i] for i in keys]) and np.allclose(b, [h[j] for j in terms])
    assert all(f.isEmpty() for f in L.nmf(cells.filter("i < 0"), "i", "j", 3))


def test_factors_of_a_key_beyond_a_block(spark, monkeypatch):
    """F8: a key with more cells than a block has is not cut: its table is factorised by the join, to the same factors."""
    from tidemark.operators import sparse

    rows = [(int(i), f"t{j}", 1.0 + (i * j) % 7) for i in range(5) for j in range(30 if i == 0 else 4)]
    cells = spark.createDataFrame(rows, "i int, j string, w double")
    by_blocks = [{r[0]: r[1] for r in f.collect()} for f in L.nmf(cells, "i", "j", 2, 2, tolerance=0.0)]
    monkeypatch.setattr(sparse, "BLOCK_CELLS", 20)
    assert sparse.factorised(cells.withColumnRenamed("w", "x"), 2, 2, 1, 0.0) is None
    joined = [{r[0]: r[1] for r in f.collect()} for f in L.nmf(cells, "i", "j", 2, 2, tolerance=0.0)]
    for a, b in zip(by_blocks, joined, strict=True):
        assert a.keys() == b.keys() and all(np.allclose(a[c], b[c]) for c in a)


def test_ids_that_take_a_partition_each(spark):
    from tidemark.operators import sparse

    ids = sparse.places(spark, 23)
    df = spark.createDataFrame([(i,) for i in ids], "id int").repartition(23, "id")
    assert ids == sorted(set(ids)) and len(ids) == 23 and df.select(F.spark_partition_id().alias("at")).distinct().count() == 23


def test_topics_of_tokens_are_those_of_their_weights(spark, monkeypatch):
    """F8: tokens that are counted and weighed in their blocks have the factors of their TF-IDF table: with terms and keys that go, a key without a known term, a null key and one beyond a block."""
    from tidemark.operators import sparse

    pick = random.Random(6)
    rows = [(i, f"t{min(pick.randrange(25), pick.randrange(25))}") for i in range(30) for _ in range(12)] + [(i, "everywhere") for i in range(30)] + [(40, "alone"), (41, "alone too"), (41, "everywhere"), (42, None)]
    tokens = spark.createDataFrame(rows, "k int, t string")
    monkeypatch.setattr(sparse, "BLOCK_CELLS", 90)
    monkeypatch.setattr(sparse, "LEAST_CELLS", 10)
    dense = lambda pair: [{r[0]: r[1] for r in f.collect()} for f in pair]
    for case in (tokens, tokens.unionByName(spark.createDataFrame([(None, "t1"), (None, "t2")], "k int, t string"))):
        want = dense(L.nmf(L.tf_idf(case, "k", "t", 0.7, 2), "k", "t", 3, 3, tolerance=0.0))
        got = dense(L.token_topics(case, "k", "t", 3, 0.7, 2, 3, tolerance=0.0))
        assert "everywhere" not in got[1] and 40 not in got[0]
        for a, b in zip(got, want, strict=True):
            assert a.keys() == b.keys() and all(np.allclose(a[c], b[c]) for c in a)
    assert sparse.factorised(tokens.select(F.col("k").alias("i"), F.col("t").alias("j")), 3, 1, 1, 0.0, (0.7, 2)) is not None
    monkeypatch.setattr(sparse, "BLOCK_CELLS", 5)
    assert sparse.factorised(tokens.select(F.col("k").alias("i"), F.col("t").alias("j")), 3, 1, 1, 0.0, (0.7, 2)) is None


def test_rows_are_sent_to_few_tiles(spark, monkeypatch):
    """a row is sent to the tiles of large blocks, and pairs are handed out by strips; close pairs of a table with itself are neither joined nor shuffled again."""
    from tidemark.operators import intervals as I

    x = np.random.default_rng(4).normal(size=(300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    monkeypatch.setattr(J, "PAIR_ROWS", 16)
    monkeypatch.setattr(I, "PAIR_ROWS", 16)
    sent, asked = J.tile_sides, []

    def sides(rows, block, *a):
        asked.append(sent(rows, block, *a))
        return asked[-1]

    monkeypatch.setattr(J, "tile_sides", sides)
    monkeypatch.setattr(I, "tile_sides", sides)
    got = {(p.a, p.b): p.similarity for p in J.similar_pairs(df, "id", "vec").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = u @ u.T
    assert len(got) == 300 * 299 // 2 and all(a < b and abs(s - want[a, b]) < 1e-9 for (a, b), s in got.items())
    days = df.select("id", F.lit("d").alias("d"), F.transform("vec", F.abs).alias("vec"))
    means = I.pair_means(days, "id", "vec", "d", 0.1)
    assert all(side.count() <= 300 * 4 for pair in asked for side in pair)
    close = A.close_pairs(means, means, 0.1, 0.1, ordered=False)
    plan = close._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Sort" not in plan
    p = np.abs(x) / np.abs(x).sum(1, keepdims=True)
    half = lambda a, b: (a * np.log(2 * a / (a + b))).sum(-1)
    js = np.sqrt((half(p[:, None], p[None]) + half(p[None], p[:, None])) / 2)
    assert {(r.i, r.j) for r in close.collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if js[i, j] <= 0.1}
