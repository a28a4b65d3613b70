"""Iterations over whole tables against their one-task versions and numpy."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import communities as C
from tidemark.operators import graphs as G
from tidemark.operators import grouped as U
from tidemark.operators import similarity as N


def planted(parts, size, inside, between, seed=1):
    pick = random.Random(seed)
    n = parts * size
    return [(i, j) for i in range(n) for j in range(i) if pick.random() < (inside if i // size == j // size else between)]


def quality(label, edges):
    ids = sorted({x for e in edges for x in e})
    place = {x: k for k, x in enumerate(ids)}
    return U.modularity(np.array([label[x] for x in ids]), np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))


def test_louvain_of_whole_tables(spark):
    """All rounds distributed: as good as the sequential one, on graphs of several keys, with loops and repeated edges."""
    graphs = {"a": planted(4, 9, 0.8, 0.04), "b": planted(3, 8, 0.7, 0.1, 2) + [(0, 0), (1, 0), (1, 0)], "c": [(1, 2)], None: [(5, 5)]}
    edges = spark.createDataFrame([(k, a, b) for k, es in graphs.items() for a, b in es], "k string, src long, trg long")
    got = C.communities(edges, "k", task_edges=0).collect()
    for k, es in graphs.items():
        label = {r.id: r.community for r in got if r.k == k}
        ids = sorted({x for e in es for x in e})
        assert sorted(label) == ids and sorted(set(label.values())) == list(range(len(set(label.values()))))
        place = {x: i for i, x in enumerate(ids)}
        one = U.louvain(len(ids), np.array([place[a] for a, _ in es]), np.array([place[b] for _, b in es]))
        assert quality(label, es) >= 0.98 * quality(dict(zip(ids, one.tolist())), es) - 1e-9


def test_large_communities_are_looked_into_again(spark):
    """Two clusters of four cliques each: the pass over parts takes them apart where that gives a modularity of at least the least."""
    es = [(16 * c + 4 * q + i, 16 * c + 4 * q + j) for c in range(3) for q in range(4) for i in range(4) for j in range(i)]
    es += [(16 * c + 4 * q, 16 * c + 4 * ((q + 1) % 4)) for c in range(3) for q in range(4)] + [(0, 16), (16, 32)]
    edges = spark.createDataFrame([(1, a, b) for a, b in es], "k int, src long, trg long")
    whole = {r.id: r.community for r in C.communities(edges, "k", largest=200).collect()}
    split = {r.id: r.community for r in C.communities(edges, "k", largest=4, least=0.3).collect()}
    assert len(set(split.values())) >= len(set(whole.values())) and sorted(split) == list(range(48))
    assert all(len({split[4 * q + i] for i in range(4)}) == 1 for q in range(12)) and len(set(split.values())) == 12
    assert {r.id: r.community for r in C.communities(edges, "k", largest=4, least=1.0).collect()} == whole


def test_keys_and_ids_with_any_characters(spark):
    rows = [(k, f"{c}/{i}", f"{c}/{j}") for k in ("a", "a/b", "", None) for c in ("x", "/y") for i in range(4) for j in range(i)]
    got = C.communities(spark.createDataFrame(rows, "k string, src string, trg string"), "k", largest=3, least=0.0).collect()
    for k in ("a", "a/b", "", None):
        label = {r.id: r.community for r in got if r.k == k}
        assert len(label) == 8 and label["x/0"] == label["x/3"] != label["/y/0"] == label["/y/2"] and set(label.values()) == {0, 1}


def test_core_and_periphery_is_no_worse_than_moves_one_by_one(spark):
    pick = random.Random(4)
    graphs = {k: [(pick.randrange(m) if pick.random() < 0.6 else pick.randrange(3), pick.randrange(m)) for _ in range(5 * m)] for k, m in ((1, 8), (2, 14), (3, 30))}
    edges = spark.createDataFrame([(k, a, b) for k, es in graphs.items() for a, b in es] + [(4, 1, 1)], "k int, src long, trg long")
    rows = C.core_sides(edges, "k").collect()
    for k, es in graphs.items():
        ids = sorted({x for e in es for x in e})
        place = {x: i for i, x in enumerate(ids)}
        src, trg = (np.array([place[e[c]] for e in es]) for c in (0, 1))

        def value(top):
            e, product = (top[src] & ~top[trg]).sum(), int(top[src].sum()) * int((~top[trg]).sum())
            return 1.0 if product == 1 else (e - product) / (1 - product)

        mine = {r.id: r.influential for r in rows if r.k == k}
        assert sorted(mine) == ids
        assert value(np.array([mine[x] for x in ids])) >= value(U.core_periphery(len(ids), src, trg)) - 1e-9


def test_chains_take_few_rounds(spark, monkeypatch):
    """A chain of thousands of vertices, trees, and what has no root."""
    n, cuts, cut = 5000, [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (cuts.append(1), cut(df))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(-(i // 2), -i) for i in range(20_002, 20_100)] + [(70_000, 70_001), (70_001, 70_000), (70_001, 70_002)], "src long, trg long")
    got = {(r.root, r.id): r.depth for r in G.shortest_paths(edges).collect()}
    assert all(got[0, i] == i for i in range(n + 1)) and len(cuts) < 40 and not any(i >= 70_000 for _, i in got)
    with pytest.raises(ValueError, match="cycle"):
        G.longest_paths(edges)
    below = {r.id: r.depth for r in G.expansion(spark, edges, 100).collect()}
    assert below == {i: i - 100 for i in range(100, n + 1)}


@pytest.mark.parametrize("within", [None, "g"])
def test_near_pairs_of_clusters(spark, monkeypatch, within):
    """Exact, with copies, zeros and nulls; few products are computed where vectors lie in clusters."""
    monkeypatch.setattr(N, "PIVOT_ROWS", 20)
    monkeypatch.setattr(N, "TILE_ROWS", 64)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(25, 12)), 24, 0) + rng.normal(size=(600, 12)) * 0.1
    x[:150] = x[0]
    rows = [(i, [float(z) for z in r], i % 2) for i, r in enumerate(x)] + [(600, [0.0] * 12, 0), (601, None, 0), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, g int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for least in (0.9, 0.3):
        hit = np.triu(unit @ unit.T >= least, 1)
        if within:
            hit &= (np.arange(600)[:, None] - np.arange(600)[None, :]) % 2 == 0
        got = [(r.a, r.b) for r in N.near_pairs(df, "id", "vec", least, within).collect()]
        assert sorted(got) == sorted(zip(*map(list, (a.tolist() for a in np.nonzero(hit)))))
    left, right = N.tiles(df, "id", "vec", 0.9)
    sizes = left.groupBy("cell", "p", "q").count().join(right.groupBy("cell", "p", "q").count().withColumnRenamed("count", "m"), ["cell", "p", "q"])
    assert sizes.selectExpr("sum(count * m)").first()[0] < 0.35 * 600 * 599 / 2
    with pytest.raises(ValueError):
        N.near_pairs(df, "id", "vec", 0.0)


def test_tiles_are_bounded_on_both_sides(spark, monkeypatch):
    """Of vectors that all stand at right angles, every row visits most cells: blocks of visitors are as small as the others."""
    monkeypatch.setattr(N, "PIVOT_ROWS", 50)
    monkeypatch.setattr(N, "TILE_ROWS", 32)
    monkeypatch.setattr(N, "_STRIP", 100)
    x = np.random.default_rng(4).normal(size=(400, 40))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    left, right = N.tiles(df, "id", "vec", 0.2)
    for side in (left, right):
        assert side.groupBy("cell", "p", "q").count().selectExpr("max(count)").first()[0] < 64
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = sorted((r.a, r.b) for r in N.near_pairs(df, "id", "vec", 0.2).collect())
    assert got == sorted(zip(*map(list, (a.tolist() for a in np.nonzero(np.triu(unit @ unit.T >= 0.2, 1))))))


def test_eigenvectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(4, 6)), 15, 0) + rng.normal(size=(60, 6)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.maximum(x @ x.T, 0) + 0.01
    np.fill_diagonal(w, 0)
    cells = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(60) for j in range(60) if w[i, j] > 0], "i long, j long, w double")
    values, rows = N.eigenvectors(cells, 4)
    d = w.sum(1)
    laplacian = np.eye(60) - w / np.sqrt(np.outer(d, d))
    assert np.abs(values - np.linalg.eigvalsh(laplacian)[:4]).max() < 1e-6
    v = np.array([r.v for r in rows.orderBy("i").collect()])
    assert np.abs(laplacian @ v - v * values).max() < 1e-3
    found = N.spectral_clusters(cells, [4]).collect()
    assert len({r.cluster for r in found}) == 4 and all(len({r.cluster for r in found if r.id // 15 == c}) == 1 for c in range(4))


def test_edit_bounds():
    """Between the bound and what is found lies the distance over all edit paths; where they are equal, it is that."""
    pick = random.Random(2)

    def graph(m):
        nodes = [(f"n{i}", " ".join(pick.sample("abcdef", pick.randrange(0, 3))), pick.choice(("NOUN", "VERB"))) for i in range(m)]
        return nodes, [(f"n{i}", f"n{j}") for i in range(m) for j in range(i) if pick.random() < 0.4]

    for _ in range(150):
        g, h = graph(pick.randrange(6)), graph(pick.randrange(6))
        distance, found = U.edit_paths(g, h)[0], U.edit_bounds(g, h)
        assert found[1] - 1e-9 <= distance <= found[0] + 1e-9
        assert found[0] - found[1] > 1e-9 or math.isclose(found[0], distance, abs_tol=1e-9)
    big = graph(40)
    assert U.edit_bounds(big, big)[:2] == (0.0, 0.0) and U.edit_bounds(big, big, steps=0)[1] == 0.0
    other = graph(33)
    distance, lower, _, _ = U.edit_bounds(big, other)
    assert 0 < lower <= distance <= 1
    cost = np.random.default_rng(1).random((7, 7))
    from itertools import permutations

    assert math.isclose(cost[np.arange(7), U.assigned(cost)].sum(), min(sum(cost[i, p[i]] for i in range(7)) for p in permutations(range(7))))


def test_factors_of_many_intervals_in_one_plan(spark):
    """The same updates as numpy's from the same start, interval by interval; it ends by itself."""
    from tidemark.operators import models as L

    rng = np.random.default_rng(5)
    tables = {g: rng.random((n, 2)) @ rng.random((2, m)) * (rng.random((n, m)) > 0.3) for g, n, m in (("a", 5, 7), ("b", 9, 4), ("c", 1, 1))}
    rows = [(g, i, f"t{j}", float(x[i, j])) for g, x in tables.items() for i in range(len(x)) for j in range(x.shape[1]) if x[i, j] > 0]
    cells = spark.createDataFrame(rows, "g string, u int, term string, w double")

    def dense(rounds):
        w, h = L.nmf_by(cells, "g", "u", "term", 2, rounds, tolerance=0.0)
        return {(r.g, r.u): np.array(r.vec) for r in w.collect()}, {(r.g, r.term): np.array(r.vec) for r in h.collect()}

    (w0, h0), (w3, h3) = dense(0), dense(3)
    for g in tables:
        us, ts = sorted({r[1] for r in rows if r[0] == g}), sorted({r[2] for r in rows if r[0] == g})
        x = np.array([[next((r[3] for r in rows if r[:3] == (g, u, t)), 0.0) for t in ts] for u in us])
        w, h = np.array([w0[g, u] for u in us]), np.array([h0[g, t] for t in ts])
        for _ in range(3):
            h = h * (x.T @ w) / np.maximum(h @ (w.T @ w), 1e-12)
            w = w * (x @ h) / np.maximum(w @ (h.T @ h), 1e-12)
        assert np.allclose(w, [w3[g, u] for u in us]) and np.allclose(h, [h3[g, t] for t in ts])
    topics = L.topics_by_interval(cells, "g", "u", 2, top=3, tolerance=0.05).collect()
    assert len(topics) == 6 and all(len(r.terms) == min(3, len({x[2] for x in rows if x[0] == r.g})) for r in topics)


def test_topics_of_intervals_run_to_their_end(spark, monkeypatch):
    """the query keeps the operator's own bounds; an interval in one task, in blocks of terms, or alone has the same factors, and ends by itself."""
    import inspect

    from tidemark.operators import models as L
    from tidemark.operators import sparse
    from tidemark.plans import catalogue

    asked = {}

    def topics(weights, *a, **kw):
        asked.update(inspect.signature(bounds).bind(weights, *a, **kw).arguments)
        return weights

    bounds = L.topics_by_interval
    monkeypatch.setattr(L, "topics_by_interval", topics)
    catalogue.interval_topics(spark, "/root/testdata/sf0.001")
    assert set(asked) == {"weights", "interval", "key"}
    rng = np.random.default_rng(9)
    rows = [(g, i, f"t{j}", float(rng.random() + 0.01)) for g, n in (("a", 4), ("b", 6), ("c", 2)) for i in range(n) for j in range(40) if rng.random() < 0.6]
    cells = spark.createDataFrame([*rows, ("a", None, "t1", 1.0), ("a", 1, None, 1.0), (None, 1, "t1", 1.0)], "g string, u int, term string, w double")

    def dense(df, rounds=60, tolerance=0.02):
        return [{tuple(r)[:2]: np.array(r.vec) for r in f.collect()} for f in L.nmf_by(df, "g", "u", "term", 3, rounds, tolerance)]

    whole = dense(cells)
    apart = [dense(cells.filter(f"g = '{g}'")) for g in "abc"]
    monkeypatch.setattr(sparse, "GROUP_CELLS", 60)
    monkeypatch.setattr(sparse, "LEAST_CELLS", 50)
    blocked = dense(cells)
    for side in (0, 1):
        assert whole[side].keys() == blocked[side].keys() == set().union(*(p[side] for p in apart))
        for c, v in whole[side].items():
            assert np.allclose(v, blocked[side][c]) and np.allclose(v, apart["abc".index(c[0])][side][c])
    monkeypatch.setattr(sparse, "KEY_NUMBERS", 5)
    assert [f.keys() for f in dense(cells, 2)] == [f.keys() for f in whole]


def test_edit_search_is_cheap_a_step():
    """of the clause graphs' kind, chains of some tens of nodes, a search of all its steps takes hundredths of a second, and is never worse than the assignment."""
    import time

    pick = random.Random(7)

    def chain(m):
        nodes = [(f"n{i}", " ".join(pick.sample("abcdefghijkl", 2)), "NOUN") for i in range(m)]
        return nodes, [(f"n{i}", f"n{i + 1}") for i in range(m - 1)]

    pairs = [(chain(pick.randrange(30, 45)), chain(pick.randrange(30, 45))) for _ in range(12)]
    began = time.process_time()
    found = [U.edit_bounds(*p) for p in pairs]
    assert time.process_time() - began < 3
    assert all(f[1] <= f[0] <= U.edit_bounds(*p, steps=0)[0] + 1e-9 for f, p in zip(found, pairs))


def test_a_block_with_itself_in_any_order():
    """a shuffle brings a tile's two sides in orders of their own; each pair comes once all the same, and no row meets itself."""
    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def side(order, within):
        return pa.table({"w": [""] * 40, "k": order.tolist(), "v": x[order].tolist(), "within": [within] * 40})

    for seed in range(3):
        rng = np.random.default_rng(seed)
        out = N._products(0.3)(None, side(rng.permutation(40), True), side(rng.permutation(40), False))
        got = sorted((min(a, b), max(a, b)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist()))
        assert got == sorted(zip(*map(list, (a.tolist() for a in np.nonzero(np.triu(x @ x.T >= 0.3, 1))))))
