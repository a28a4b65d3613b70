import random
import re

import pytest

from tidemark.llm.common import ROW, numbered
from tidemark.llm.exact_dedup import drop_exact, exact_groups
from tidemark.llm.near_dedup import components, drop_near, near_groups


def brute(rows, k=4, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted(((i, len(sets[n]), low.get(find(n)), i == low.get(find(n))) for n, (i, _) in enumerate(rows)), key=repr)


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(r.choice((5, 30, 200)))] for _ in range(n // 4)]
    shared = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 3, 8))):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w + (shared if i % 3 == 0 else []))))
    return rows


def test_against_brute_force(frame):
    rows = corpus(240) + [(1000, ""), (1001, None), (1002, " \n"), (1003, "One Two"), (1004, "one two"), (1005, "one two three"), (None, "one two"), (1006, "x " * 9000), (1006, "x " * 9000), (1007, "É a b c"), (1008, "é a b c")]
    got = sorted((tuple(r) for r in near_groups(frame(rows)).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("middle", [None, 1, 5])
def test_links_through_rows_without_an_own_id(frame, middle):
    """a ~ b ~ c, where b has no id, or shares another row's."""
    w = [f"z{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join(w[6:] + [f"y{i}" for i in range(3)]), " ".join(w[12:] + [f"y{i}" for i in range(9)])
    rows = [(1, a), (middle, b), (5, c), (7, "else where not near any of them"), (None, "also on its own here"), (None, b + " end")]
    got = sorted((tuple(r) for r in near_groups(frame(rows)).collect()), key=repr)
    assert got == brute(rows) and sorted(x[2] for x in got if x[2] is not None) == [1, 1, 1, 1, 7]
    kept = [(r.doc_id, r.text) for r in drop_near(frame(rows)).collect()]
    assert len(kept) == 3 and {i for i, _ in kept} == {1, 7, None}


def test_same_from_files(spark, frame, tmp_path):
    """Rows of files are numbered where they are; of other plans, in a written copy."""
    rows = corpus(60) + [(None, "one two"), (3, "one two"), (3, "one two")]
    frame(rows).repartition(5).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    numbers = [r[0] for r in numbered(files).select(ROW).collect()]
    assert len(set(numbers)) == len(numbers) == len(rows)
    twice = spark.read.parquet(str(tmp_path / "d"), str(tmp_path / "d"))
    assert numbered(twice).select(ROW).distinct().count() == 2 * len(rows)
    for run in (near_groups, drop_near, exact_groups, drop_exact):
        assert sorted(map(tuple, run(files).collect()), key=repr) == sorted(map(tuple, run(frame(rows)).collect()), key=repr)


def test_chains_in_one_bucket(frame):
    """Members that differ from the bucket's first but not from each other."""
    words = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(words[: 60 + i])) for i in range(0, 60, 3)]
    got = sorted((tuple(r) for r in near_groups(frame(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_shared_passage_brings_no_pairs(frame):
    """Many texts of which three quarters are one passage: few are linked, and the rest aren't paired."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"u{r.random()}" for _ in range(r.choice((1, 2, 4, 10, 14)))] + passage)) for i in range(300)]
    got = sorted((tuple(r) for r in near_groups(frame(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_and_drop(spark, frame, docs_schema):
    assert near_groups(spark.createDataFrame([], docs_schema)).collect() == []
    assert drop_near(spark.createDataFrame([], docs_schema)).collect() == []
    text = " ".join(f"t{i}" for i in range(50))
    assert {r.doc_id for r in drop_near(frame([(3, text), (2, text + " z"), (9, "else"), (None, "other")])).collect()} == {2, 9, None}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {n: {n} for e in edges for n in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            joined = near[a] | near[b]
            for n in joined:
                near[n] = joined
    assert got == {n: min(s) for n, s in near.items()}
