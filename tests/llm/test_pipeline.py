"""The pipeline against a brute-force version of each stage on that stage's own input."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tidemark.llm.toxicity import fitted, sample

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def exact(rows):
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", i), i)
    return [(i, t) for i, t in rows if best[t or ""] == i]


def near(rows):
    sets, root = [shingles(t, 4) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                root[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        low[find(n)] = min(low.get(find(n), i), i)
    return [(i, t) for n, (i, t) in enumerate(rows) if low[find(n)] == i]


def clean(rows, items):
    sets = [s for s in (shingles(t, 5) for t in items) if s]
    return [(i, t) for i, t in rows if not any(len(s & shingles(t, 5)) >= 0.8 * len(s) - 1e-9 for s in sets)]


def test_stages(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = [(r.doc_id, r.text) for r in docs.collect()]
    model = fitted(*sample(docs, labels, "toxic", 5000))
    scores = [s for s, _, _ in model.score([(t or "").encode() for _, t in now])]
    now = [x for x, s in zip(now, scores, strict=True) if s < 0.3]
    step = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], (lambda r: r, exact, near, lambda r: clean(r, items)), strict=True):
        step = stage(spark, step, SF)
        assert step.columns == docs.columns, name
        now = want(now)
        assert sorted((r.doc_id, r.text) for r in step.collect()) == sorted(now), name
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((r.doc_id, r.ids, r.decodes) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((i, sp.encode(t or ""), True) for i, t in now)


@pytest.mark.parametrize("seed", [1])
def test_planted(spark, frame, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    base = text(120)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, base), (2, base), (3, base + " tail"), (4, text(80) + " " + item + " " + text(80)), (5, text(100)), (6, None), (7, ""), (8, "short"), (None, text(50)), (9, text(60)), (9, text(61))]
    df = frame(rows)
    left = {name: [] for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        left[name] = sorted(r.doc_id for r in df.collect() if r.doc_id is not None)
    assert left["exact_dedup"] == [2, 3, 4, 5, 7, 8, 9, 9] and left["near_dedup"] == [2, 4, 5, 7, 8, 9, 9] and left["decontamination"] == [2, 5, 7, 8, 9, 9]


def test_rows_not_ids_are_dropped(spark, frame):
    """Repeated and null ids: a stage drops the rows that it should, and no other row of the same id."""
    r = random.Random(3)
    text = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    a, b, c, d = text(120), text(110), text(100), text(90)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: sorted(((x.doc_id, x.text) for x in stages[name](spark, frame(rows), SF).collect()), key=repr)
    same = lambda *rows: sorted(rows, key=repr)
    rows = [(1, a), (1, a), (5, b), (7, b), (5, c), (None, b), (None, d), (None, d), (8, None), (8, "")]
    got = run("exact_dedup", rows)
    assert [x for x in got if x[1]] == same((1, a), (7, b), (5, c), (None, d)) and len([x for x in got if not x[1]]) == 1
    rows = [(1, a), (1, a + " tail"), (5, b), (4, b + " tail"), (5, c), (None, b), (None, d), (None, d)]
    got = run("near_dedup", rows)
    assert [x for x in got if x[0] != 1] == same((4, b + " tail"), (5, c), (None, d)) and len([x for x in got if x[0] == 1]) == 1
    dirty = f"{text(20)} {item} {text(20)}"
    assert run("decontamination", [(1, a), (1, dirty), (None, dirty), (None, b)]) == same((1, a), (None, b))
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = [(x.doc_id, x.text) for x in docs.collect()]
    scores = [s for s, _, _ in fitted(*sample(docs, labels, "toxic", 5000)).score([(t or "").encode() for _, t in known])]
    toxic = max(zip(scores, known, strict=True), key=lambda x: x[0])[1][1]
    extra = [(None, toxic), (None, a), (900_001, toxic), (900_001, b)]
    got = run("toxicity", known + extra)
    assert (None, toxic) not in got and (900_001, toxic) not in got and (None, a) in got and (900_001, b) in got


def test_empty(spark, docs_schema):
    df = spark.createDataFrame([], docs_schema)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.collect() == []
