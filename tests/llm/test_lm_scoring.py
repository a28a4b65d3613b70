import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm_scoring
from tidemark.llm.lm_scoring import GRID, LAST_BUCKET, learned_weights, lm_scores

SF = "/root/testdata/sf0.001"


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def fold(i, n=7):
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


def brute(rows, order=2):
    counts, held = ([Counter() for _ in range(order)] for _ in range(2))  # of n-grams, by n - 1
    contexts, held_contexts = ([Counter() for _ in range(order)] for _ in range(2))
    grams = lambda w, n: [tuple((["<s>"] * (n - 1) + w)[i : i + n]) for i in range(len(w))]
    for i, t in rows:
        if fold(i) == 2:
            continue
        for n in range(order):
            for cs, xs in ((counts, contexts), (held, held_contexts))[: 1 + (fold(i) == 3)]:
                cs[n].update(grams(tokens(t), n + 1))
                xs[n].update(g[:-1] for g in grams(tokens(t), n + 1))
    total, v = sum(counts[0].values()), len(counts[0])
    left = total - sum(held[0].values())
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), LAST_BUCKET)
    rounded = lambda p: int(np.round(np.log10(p) * GRID)) if p > 0 else 9999
    weights = []

    def p_of(g, c, x, n):
        """Of the last token of n-gram ``g`` by all levels that have weights."""
        lam = weights[0][bucket(x(1, g[-2:-1]))]
        ratio = lambda k: c(k, g[-k - 1 :]) / x(k, g[-k - 1 : -1]) if x(k, g[-k - 1 : -1]) else 0
        p = lam[0] * ratio(1) + lam[1] * c(0, g[-1:]) / max(n, 1) + lam[2] / (v + 1)
        for k, level in enumerate(weights[1:], 2):
            lam = level[bucket(x(k, g[-k - 1 : -1]))]
            p = lam[0] * ratio(k) + lam[1] * p
        return p

    rest = lambda k, g: counts[k][g] - held[k][g]
    rest_context = lambda k, g: contexts[k][g] - held_contexts[k][g]
    for k in range(1, order):
        cells = Counter()
        for i, t in rows:
            if fold(i) == 3:
                for g in grams(tokens(t), k + 1):
                    x = rest_context(k, g[:-1])
                    below = p_of(g, rest, rest_context, left) if weights else rest(0, g[-1:]) / max(left, 1)
                    cells[bucket(x), rounded(rest(k, g) / x if x else 0), rounded(below)] += 1
        weights.append(learned_weights([(*c, n) for c, n in cells.items()], v if k == 1 else None))
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[0][x,] + 1) / (total + v + 1)) for x in w)
        score = sum(math.log10(p_of(g, lambda k, g: counts[k][g], lambda k, g: contexts[k][g], total)) for g in grams(w, order))
        out.append((i, fold(i) == 2, len(w), sum(counts[0][x,] > 0 for x in w), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


ODD = [(None, "null id"), (None, None), (3001, ""), (3002, None), (3003, " \n"), (3004, "x " * 30_000), (3005, "Same same SAME"), (3005, "Same same SAME"), (3006, "É é")]


@pytest.mark.parametrize(("block", "entries", "order"), [(8 << 20, 2_000_000, 2), (3000, 500, 2), (3000, 500, 3), (3000, 500, 4)])
def test_against_brute_force(spark, frame, monkeypatch, block, entries, order):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_scoring, "BUCKET_ENTRIES", entries)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()] + ODD
    assert got(lm_scores(frame(rows), order=order)) == brute(rows, order)


def test_file_source_and_model_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm_scores(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table(spark, docs_schema):
    assert lm_scores(spark.createDataFrame([], docs_schema)).collect() == []


def test_weights_sum_to_one():
    w = learned_weights([(3, -10, -40, 5), (3, 9999, -60, 2), (7, -2, -50, 100)], 1000)
    assert np.allclose(w.sum(1), 1) and (w > 0).all() and w[7, 0] > w[3, 0]


def test_long_texts_in_one_stretch(spark, frame, tmp_path, monkeypatch):
    """Blocks are cut by bytes where long texts stand together, in the middle of a file."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 4000)
    words = [f"w{i % 97}" for i in range(5000)]
    rows = [(i, f"short {i % 7}") for i in range(900)] + [(1000 + i, " ".join(words[i : i + 900])) for i in range(40)] + [(2000 + i, f"tail {i % 5}") for i in range(900)]
    frame(rows).coalesce(1).sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    source = docs.select("doc_id", "text", lm_scoring.F.col("_metadata.file_path").alias("f"), lm_scoring.F.col("_metadata.row_index").alias("row"))
    blocks = lm_scoring._blocked(source, 50).groupBy("f", "b").agg(lm_scoring.F.sum(lm_scoring.F.octet_length("text")).alias("n"), lm_scoring.F.max(lm_scoring.F.octet_length("text")).alias("top")).collect()
    assert all(b.n <= 4000 + b.top for b in blocks) and len(blocks) > 40
    assert got(lm_scores(docs)) == brute(rows)
