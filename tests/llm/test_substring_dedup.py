import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import deduplicated, op13_substring_dedup


def brute(rows, window=20):
    """rows in the table's order; (id, words, removed, kept text)."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = sorted(range(len(split)), key=lambda k: (split[k][0] is not None, split[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        i, words = split[k]
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        out.append((i, len(words), len(gone), " ".join(x for j, x in enumerate(words) if j not in gone)))
    return sorted(out, key=repr)


def rows_of(n, seed=1):
    pick = random.Random(seed)
    word = lambda: pick.choice(["ä", "the", "of", "Wort", "x", "12", "a-b", "𐀀"]) + str(pick.randrange(3000))
    passages = [[word() for _ in range(m)] for m in (19, 20, 21, 35, 130)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(pick.randrange(90))]
        for _ in range(pick.randrange(3)):
            p = pick.choice(passages)
            a = pick.randrange(len(p) // 2) if pick.random() < 0.4 else 0
            at = pick.randrange(len(words) + 1)
            words[at:at] = p[a:]
        rows.append((i, pick.choice([" ", "\n", " \t\x0b "]).join(words)))
    rows += [(n + k, " ".join(passages[4])) for k in range(n)]  # one passage in half of the rows
    rows += [(2 * n, "ha " * 500), (2 * n + 1, "ab cd " * 300), (2 * n + 2, "ha " * 19), (2 * n + 3, None), (2 * n + 4, ""), (2 * n + 5, " \t\n"), (2 * n + 6, "x" * 300_000), (2 * n + 7, " ".join(word() for _ in range(60_000)))]
    pick.shuffle(rows)
    return rows


def collected(df):
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", removed, "kept").collect()), key=repr)


@pytest.mark.parametrize("unit", [200, 20_000, 4 << 20])
def test_against_brute_force(frame, monkeypatch, unit):
    monkeypatch.setattr(substring_dedup, "UNIT_BYTES", unit)
    monkeypatch.setattr(substring_dedup, "SLICE_KEYS", 100 if unit < 1000 else 500_000)
    rows = rows_of(120)
    assert collected(deduplicated(frame(rows))) == brute(rows)


def test_null_and_repeated_ids(spark, docs_schema, monkeypatch):
    """A null id is before all others; rows of one id are taken in the table's order, repeated rows are documents of their own."""
    monkeypatch.setattr(substring_dedup, "UNIT_BYTES", 300)
    p = " ".join(f"w{k}" for k in range(30))
    rows = [(5, p + " one"), (5, p + " two"), (None, "a " + p), (5, p + " one"), (7, p), (None, p), (-3, "b " + p), (9, "short"), (9, "short")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], docs_schema).coalesce(1)
    assert collected(deduplicated(docs)) == brute(rows)


def test_windows_that_only_share_an_anchor_stay(frame):
    words = [f"w{k}" for k in range(400)]
    shared = words[:19]
    rows = [(k, " ".join(words[20 + 30 * k : 20 + 30 * k + k % 11] + shared + words[40 + 30 * k : 50 + 30 * k])) for k in range(11)]
    assert [r[2] for r in collected(deduplicated(frame(rows)))] == [0] * 11
    assert collected(deduplicated(frame(rows), window=19, anchor=9)) == brute(rows, 19)
    with pytest.raises(ValueError):
        deduplicated(frame(rows), window=18)


def test_query(spark, tmp_path):
    """More partitions than owners, files that hold no words, and the query's own columns."""
    rows = rows_of(60, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    docs.unionByName(spark.createDataFrame([(-1, None)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute([*rows, (-1, None)])), key=repr)


def test_empty_and_extra_columns(spark, frame, docs_schema):
    assert deduplicated(spark.createDataFrame([], docs_schema)).collect() == []
    docs = frame(rows_of(20))
    odd = docs.select("*", *[F.lit("x").alias(c) for c in "unit words n_words repeats kept start end id".split()])
    assert collected(deduplicated(odd)) == collected(deduplicated(docs))
