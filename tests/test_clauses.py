import random

import numpy as np

from tidemark.operators import grouped as U
from tidemark.operators.clauses import clause_tables, token_table

DEPS = ["nsubj", "dobj", "conj", "ROOT", "det", "advcl", "amod", "case", "neg", "pobj"]


def sentence(pick, n):
    """A random tree of tokens: heads lead to the root, which is its own."""
    order = list(range(n))
    pick.shuffle(order)
    head = {order[0]: order[0]} | {x: pick.choice(order[:k]) for k, x in enumerate(order) if k}
    word = lambda: pick.choice(["not", "car", "Dog", "never", "run", "x"])
    return [
        {"i": i, "text": "t", "lemma": word(), "pos": pick.choice(["NOUN", "VERB"]), "dep": "ROOT" if head[i] == i else pick.choice(DEPS), "head": head[i], "phrase": pick.choice([None, None, "big car"]), "trivial": pick.random() < 0.3}
        for i in range(n)
    ]


def test_as_sentence_by_sentence(spark):
    """Against the walk of one sentence at a time: random trees, chains, and sentences without nodes."""
    pick = random.Random(8)
    texts = {k: [sentence(pick, pick.randrange(1, 14)) for _ in range(pick.randrange(4))] for k in range(40)}
    chain = [{"i": i, "text": "t", "lemma": "x", "pos": "NOUN", "dep": "ROOT" if i == 0 else "det" if i < 299 else "dobj", "head": max(i - 1, 0), "phrase": None, "trivial": False} for i in range(300)]
    texts[99] = [chain]
    df = spark.createDataFrame([(k, str(k)) for k in texts], "id long, text string")
    nodes, edges = clause_tables(token_table(df, "id", "text", lambda x: texts[int(x)]), "id")
    got_nodes = {(f"{r.id}|{r.s}|{r.i}", r.txt, r.pos) for r in nodes.collect()}
    got_edges = {(f"{r.id}|{r.s}|{r.src}", f"{r.id}|{r.s}|{r.trg}") for r in edges.collect()}
    want_nodes, want_edges = set(), set()
    for k, sentences in texts.items():
        for s, tokens in enumerate(sentences):
            n, e = U.clause_graph(f"{k}|{s}", tokens)
            want_nodes |= set(n)
            want_edges |= set(e)
    assert got_nodes == want_nodes and got_edges == want_edges and len(want_edges) > 100
    empty = spark.createDataFrame([], "id long, text string")
    assert all(x.collect() == [] for x in clause_tables(token_table(empty, "id", "text"), "id"))


def test_leaders_by_blocks(monkeypatch):
    """The nodes of the plain loop, whatever the blocks."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 8)), 6, 0)[rng.permutation(180)] + rng.normal(size=(180, 8)) * 0.4
    x[5] = 0
    nodes, want = [], []
    for v in x:
        sim = [v @ n / (max(np.linalg.norm(v), 1e-12) * max(np.linalg.norm(n), 1e-12)) for n in nodes]
        best = int(np.argmax(sim)) if sim else -1
        if best >= 0 and sim[best] >= 0.6:
            nodes[best] = (nodes[best] + v) / 2
        else:
            best = len(nodes)
            nodes.append(v)
        want.append(best)
    for block in (1, 7, 500):
        monkeypatch.setattr(U, "LEADER_BLOCK", block)
        assert U.leaders(x, 0.6).tolist() == want


def test_graphs_are_handed_out_in_pieces(spark, monkeypatch):
    """Batches that come back have few rows, and the results are those of any size of piece."""
    texts = spark.createDataFrame([(i, f"The cat {i} saw a bird of prey. Dogs bark {i}.") for i in range(50)], "id long, t string").coalesce(1)
    words = {"cat": [1.0, 0.0], "dogs": [0.0, 1.0]}
    whole = [(r.id, r.cls_json) for r in U.semantic_units(texts, "id", "t").collect()]
    vectors = [(r.id, r.vec) for r in U.clause_vectors(U.semantic_units(texts, "id", "t"), "id", words, 2, "sp_avg_node").collect()]
    monkeypatch.setattr(U, "PIECE_ROWS", 7)
    assert [(r.id, r.cls_json) for r in U.semantic_units(texts, "id", "t").collect()] == whole and len(whole) == 50
    assert [(r.id, r.vec) for r in U.clause_vectors(U.semantic_units(texts, "id", "t"), "id", words, 2, "sp_avg_node").collect()] == vectors


def test_only_what_the_graph_needs_travels(spark):
    """Texts of tokens that can't be nodes, and labels' names, are neither shuffled nor written."""
    c = spark.createDataFrame([(1, "The cat saw a bird.")], "id long, t string")
    nodes, _ = clause_tables(token_table(c, "id", "t"), "id")
    written = nodes.sparkSession.read.parquet(nodes.inputFiles()[0].rsplit("/", 1)[0])
    assert not {"text", "lemma", "dep", "phrase"} & set(written.columns) and written.filter("not kept and txt is not null").isEmpty()
