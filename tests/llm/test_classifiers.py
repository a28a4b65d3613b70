import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.quality import lines, marginals, quality_scores
from tidemark.llm.toxicity import drop_toxic, fitted, toxic_scores

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def words(r, n):
    return " ".join(("." if k % 9 == 8 else "") + " w" + r.choice("abcdefgh") * r.randrange(1, 6) for k in range(n))


@pytest.fixture(scope="module")
def toxic_rows():
    r = random.Random(1)
    rows = []
    for i in range(800):
        bad = i % 5 == 0
        t = words(r, r.choice((20, 60, 200)))
        if bad:
            parts = t.split(". ")
            k = r.randrange(len(parts))
            parts[k] += " " + r.choice(("vilething", "vilethings", "grimword"))
            t = ". ".join(parts)
        rows.append((i, t, int(bad)))
    return rows


def test_toxic_scores(spark, frame, toxic_rows):
    docs = frame([(i, t) for i, t, _ in toxic_rows] + [(5000, None), (5001, ""), (None, "null id"), (5002, "a vilething."), (5003, "ok. Then vilethingx here! ok"), (5004, "ok " * 40_000)])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows] + [(None, 1, 1), (7, 0, 1), (9999, 1, 1)], LABELS)
    got = {r.doc_id: r for r in toxic_scores(docs, labels).collect()}
    assert len(got) == len(toxic_rows) + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == held(i) for i, r in got.items() if i is not None)
    test = [(got[i].predicted, y) for i, _, y in toxic_rows if held(i)]
    assert sum(p == y for p, y in test) >= 0.98 * len(test)
    assert got[5000].score < 0.05 and got[5001].score < 0.05 and got[5004].predicted == 0 and got[5002].predicted == 1
    where = got[5003].offending
    assert len(where) == 1 and "ok. Then vilethingx here! ok"[where[0].start : where[0].end].strip() == "Then vilethingx here!"
    left = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert left == {i for i, r in got.items() if not r.predicted}


def test_labels_of_held_out_rows_are_not_read(spark, frame, toxic_rows):
    docs = frame([(i, t) for i, t, _ in toxic_rows])
    a = spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows], LABELS)
    b = spark.createDataFrame([(i, 1, 1 - y if held(i) else y) for i, _, y in toxic_rows], LABELS)
    assert sorted(toxic_scores(docs, a).select("doc_id", "score").collect()) == sorted(toxic_scores(docs, b).select("doc_id", "score").collect())


def test_no_labels(spark, frame):
    docs, none = frame([(1, "a"), (2, None)]), spark.createDataFrame([], LABELS)
    assert all(r.predicted == 0 for r in toxic_scores(docs, none).collect())
    assert len(quality_scores(docs, none).collect()) == 2
    one = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert {r.predicted for r in quality_scores(docs, one).collect()} == {1}


def test_empty_tables(spark, docs_schema):
    docs, labels = spark.createDataFrame([], docs_schema), spark.createDataFrame([], LABELS)
    assert toxic_scores(docs, labels).collect() == [] == quality_scores(docs, labels).collect()


def test_noisy_or_by_hand():
    m = fitted([b"good one. fine.", b"bad evil. fine.", b"good fine.", b"evil one."] * 10, [0, 1, 0, 1] * 10)
    (score, n, bad), (clean, _, none) = list(m.score([b"fine. evil day. good", b"good. fine"]))
    assert n == 3 and score > 0.9 and len(bad) == 1 and clean < 0.01 and none == []


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    at = np.array([0, 1, 4, 4 + 6, 12])
    e, move = r.normal(size=(12, 2)), r.normal(size=(2, 2))
    log_p, total, pairs = marginals(e, move, at)
    want_pairs = np.zeros((2, 2))
    for c in range(len(at) - 1):
        n = at[c + 1] - at[c]
        p, z, expect = np.zeros((n, 2)), 0.0, np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[at[c] + k, y[k]] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            for k in range(n):
                p[k, y[k]] += w
            for k in range(n - 1):
                expect[y[k], y[k + 1]] += w
        assert np.allclose(np.exp(log_p[at[c] : at[c + 1]]), p / z) and np.isclose(total[c], np.log(z))
        want_pairs += expect / z
    assert np.allclose(pairs, want_pairs)


def test_lines_and_neighbours():
    _, _, x, length, at = next(lines([b"one two\n\nthree", b"", None]))
    assert at.tolist() == [0, 3, 4, 5] and length.tolist() == [7, 0, 5, 0, 0]
    w = x.shape[1] // 3
    assert (x[1, w : 2 * w] == x[0, :w]).all() and (x[0, w : 2 * w] == 0).all() and (x[2, 2 * w :] == 0).all() and (x[0, 2 * w :] == x[1, :w]).all()


def test_half_good_page_is_labelled_by_halves():
    """Lines' labels are hidden in training: documents have lines of both kinds, and a page of two halves gets both labels."""
    r = random.Random(5)
    prose = lambda: " ".join(r.choice("the tide came in over flats and grey birds rose from reeds".split()) for _ in range(r.randrange(8, 16))).capitalize() + "."
    junk = lambda: " | ".join(r.choice(("HOME", "Log in", "$$ 99", "#tag", ">>", "Menu 3")) for _ in range(r.randrange(3, 7)))
    texts, labels = [], []
    for k in range(400):
        good = k % 2
        texts.append("\n".join(prose() if r.random() < (0.95 if good else 0.25) else junk() for _ in range(r.randrange(6, 20))).encode())
        labels.append(good)
    field = quality.fitted(texts, labels)
    page = "\n".join([prose() for _ in range(10)] + [junk() for _ in range(10)]).encode()
    _, good, _ = next(field.parts([page]))
    assert (good[:10] > 0.5).all() and (good[10:] < 0.5).all()
    score = field.calibrated(np.concatenate([p[2] for p in field.parts(texts)]))
    assert ((score >= 0.5) == np.array(labels)).mean() > 0.97


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.98), (quality, "quality", 0.99)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = (toxic_scores if module is toxicity else quality_scores)(docs, labels)
    rows = scores.filter("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    s, p, y = (np.array([r[i] for r in rows]) for i in range(3))
    assert auc(s, y) >= least and (p == y).mean() >= 0.97


def test_long_and_odd_texts(spark, frame):
    docs = frame([(1, "line\n" * 20_000), (2, "x" * 200_000), (3, None), (3, ""), (None, "\n\n"), (4, "é|é " * 50)])
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 1, 1)], LABELS)
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and {r.n_lines for r in rows} == {20_001, 1, 3}
