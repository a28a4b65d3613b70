import random
import re

import numpy as np

from tidemark.llm.decontamination import bins_per_shingle, contaminated, drop_contaminated

ITEMS = "item_id long, text string"


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(docs, items):
    out = set()
    for i, t in docs:
        have = shingles(t)
        for j, x in items:
            s = shingles(x)
            if s and j is not None and len(s & have) >= 0.8 * len(s) - 1e-9:
                out.add((i, j, len(s), len(s & have)))
    return sorted(out, key=repr)


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(400))
    items = [(i, " ".join(word() for _ in range(r.choice((1, 3, 5, 6, 9, 14, 30, 59))))) for i in range(60)]
    docs = []
    for i in range(250):
        w = [word() for _ in range(r.choice((0, 4, 40, 400, 3000)))]
        for _ in range(r.choice((0, 0, 1, 2))):
            x = r.choice(items)[1].split()
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                x[r.randrange(len(x))] = word()
            at = r.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return docs, items


def rows(df):
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect()), key=repr)


def test_against_brute_force(spark, frame):
    docs, items = corpus()
    docs += [(None, items[3][1]), (900, None), (901, ""), (902, items[8][1]), (902, items[8][1])]
    items += [(None, "null id"), (500, None), (501, " "), (502, items[8][1])]
    for block in (2_000_000, 150):
        got = rows(contaminated(frame(docs), spark.createDataFrame(items, ITEMS), block_shingles=block))
        assert got == brute(docs, items)


def test_many_seeds_on_sketches(spark, frame):
    for seed in range(3):
        docs, items = corpus(seed + 10)
        assert rows(contaminated(frame(docs), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_bins():
    assert bins_per_shingle(1) == np.inf and bins_per_shingle(55) <= 2 and bins_per_shingle(5000) < 1 / 8


def test_empty_and_drop(spark, frame, docs_schema):
    docs, items = corpus()
    some = spark.createDataFrame(items, ITEMS)
    assert rows(contaminated(spark.createDataFrame([], docs_schema), some)) == []
    assert rows(contaminated(frame(docs), spark.createDataFrame([], ITEMS))) == []
    bad = {i for i, *_ in brute(docs, items)}
    assert {r.doc_id for r in drop_contaminated(frame(docs), some).collect()} == {i for i, _ in docs} - bad
