"""Operator 3. Toxicity by multiple-instance learning: noisy-or over sentences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _BYTE, ROW, RUN_BYTES, _power, mixed, numbered, remainder, ship, texts_of, without, written

#: Bounds on the labelled documents that the model is fitted on, on their bytes, and on its features.
MAX_DOCS, MAX_BYTES, MAX_FEATURES = 5000, 24 << 20, 4096
#: A feature must be in so many of those documents, and so many deviations from what chance gives it.
MIN_DOCS, MIN_DEVIATION = 4, 4.0
#: Of a sentence without evidence, at most.
MOST_BIAS = -10.0
#: Scores from which a document is toxic, and from which a sentence of it is reported.
TOXIC, OFFENDING = 0.3, 0.3

#: ASCII letters are lower-cased, other ASCII becomes a blank; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True
_BITS = 20


def sentences(texts: list[bytes | None], limit: int = RUN_BYTES):
    """Over runs of texts: (first, last + 1, joined bytes, where texts start, where sentences end, features, their words' starts).

    Features are hashes of a word, of its first 4, 5 and 6 bytes and of its last 5, so that stems are met in new words."""
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= limit):
            part.append(texts[j] or b"")
            size += len(part[-1]) + 1
            j += 1
        raw = b"\n".join(part) + b"\n"
        a = np.frombuffer(raw.translate(_LETTERS), np.uint8)
        edge = np.diff(np.concatenate([[0], (a != 32).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power(len(a))
        prefix = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * up, out=prefix[1:])
        found = []
        for seed, (s, e) in enumerate(((start, end), (start, start + 4), (start, start + 5), (start, start + 6), (end - 5, end)), 1):
            ok = np.ones(len(s), bool) if seed == 1 else (s >= start) & (e <= end)
            found.append(np.where(ok, mixed((prefix[np.minimum(e, len(a))] - prefix[np.maximum(s, 0)]) * down[np.maximum(s, 0)] + np.uint64(seed)), np.uint64(0)))
        at = np.cumsum([0] + [len(x) + 1 for x in part])
        yield i, j, raw, at, np.flatnonzero(_STOPS[np.frombuffer(raw, np.uint8)]), found, start
        i = j


def worded(start: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which stops end a sentence that has a word."""
    real = np.zeros(len(stops), bool)
    real[np.searchsorted(stops, start)] = True
    return real


class Model:
    """Evidence of a sentence: bias plus the weights of its distinct features."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(features >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, found: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a feature of the model begins, and which one it is."""
        at, which = [], []
        for h in found:
            some = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)] & (h != 0))
            k = np.minimum(np.searchsorted(self.features, h[some]), max(len(self.features) - 1, 0))
            real = self.features[k] == h[some] if len(self.features) else np.zeros(len(some), bool)
            at.append(start[some[real]])
            which.append(k[real])
        return np.concatenate(at), np.concatenate(which)

    def sentence_hits(self, found, start, stops) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, feature) pairs of a run, a sentence being the stop that ends it."""
        at, which = self.hits(found, start)
        pair = np.unique(np.searchsorted(stops, at) * np.int64(len(self.features) + 1) + which)
        return pair // (len(self.features) + 1), pair % (len(self.features) + 1)

    def score(self, texts: list[bytes | None], threshold: float = OFFENDING):
        """Per text: noisy-or score, sentences, and the offending ones as (start, end, score) in code points."""
        for i, j, raw, at, stops, found, start in sentences(texts):
            owner = np.searchsorted(at, stops, "right") - 1
            real = worded(start, stops)
            n = np.bincount(owner[real], minlength=j - i)
            sent, feat = self.sentence_hits(found, start, stops)
            evidence = np.bincount(sent, weights=self.weights[feat], minlength=len(stops)) + self.bias
            log_not = np.where(real, -np.logaddexp(0, evidence), 0.0)
            score = -np.expm1(np.bincount(owner, weights=log_not, minlength=j - i))
            p = -np.expm1(log_not)
            bad: dict[int, list] = {}
            for s in np.flatnonzero(p >= threshold).tolist():
                d = int(owner[s])
                first = max(int(at[d]), int(stops[s - 1]) + 1 if s else 0)
                a = len(raw[at[d] : first].decode(errors="replace"))
                bad.setdefault(d, []).append((a, a + len(raw[first : stops[s] + (stops[s] + 1 < at[d + 1])].decode(errors="replace")), float(p[s])))
            for d in range(j - i):
                yield float(min(max(score[d], 0.0), 1.0)), int(n[d]), bad.get(d, [])


def fitted(texts: list[bytes | None], labels: list[int], steps: int = 200) -> Model:
    """A model of labelled documents: features whose documents' labels differ from chance, weights by Adam on noisy-or."""
    y = np.array(labels, float)
    rate = y.mean() if len(y) else 0.0
    slices: list[list] = [[] for _ in range(16)]
    for i, _, _, at, _, found, start in sentences(texts):
        h = np.concatenate(found)
        d = np.tile(np.searchsorted(at, start, "right") - 1 + i, len(found))[h != 0]
        h = h[h != 0]
        order = np.lexsort((d, h))
        h, d = h[order], d[order].astype(np.int32)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        cut = np.searchsorted(h >> np.uint64(60), np.arange(17))
        for k in range(16):
            slices[k].append((h[cut[k] : cut[k + 1]], d[cut[k] : cut[k + 1]]))
    counted = []
    for part in slices:  # a document is in one run, so its pairs are distinct already
        u, k = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in part]]), return_inverse=True)
        n = np.bincount(k, minlength=len(u))
        d = np.concatenate([np.zeros(0, np.int32), *[d for _, d in part]])
        often = n >= MIN_DOCS
        counted.append((u[often], n[often], np.bincount(k, weights=y[d], minlength=len(u))[often]))
        part.clear()
    u, df, pos = (np.concatenate([c[i] for c in counted]) for i in range(3))
    deviation = np.abs(pos - df * rate) / np.sqrt(df * rate * (1 - rate) + 1e-9)
    top = np.argsort(-deviation, kind="stable")[:MAX_FEATURES]
    top = top[deviation[top] >= MIN_DEVIATION]
    model = Model(u[top].astype(np.uint64), np.zeros(len(top)), MOST_BIAS)
    if not len(top):
        return model
    sents, feats, docs, reals, base = [], [], [], [], 0
    for i, _, _, at, stops, found, start in sentences(texts):
        s, f = model.sentence_hits(found, start, stops)
        sents.append(s + base)
        feats.append(f)
        docs.append(np.searchsorted(at, stops, "right") - 1 + i)
        reals.append(worded(start, stops))
        base += len(stops)
    s, f, owner, real = np.concatenate(sents), np.concatenate(feats), np.concatenate(docs), np.concatenate(reals)
    w, bias = np.zeros(len(top)), MOST_BIAS
    m = v = np.zeros(len(top))
    for t in range(1, steps + 1):
        z = np.bincount(s, weights=w[f], minlength=base) + bias
        log_not = np.where(real, -np.logaddexp(0, z), 0.0)
        p = -np.expm1(np.bincount(owner, weights=log_not, minlength=len(y)))
        # d loss / d log_not of a document, then through each sentence: d log_not / dz = -sigmoid(z)
        outer = np.where(y > 0, (1 - p) / np.maximum(p, 1e-9), -1.0)
        slope = outer[owner] * -np.exp(z + log_not)
        g = np.bincount(f, weights=slope[s], minlength=len(top)) / len(y) + 0.02 / len(y) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    order = np.argsort(u[top].astype(np.uint64))
    return Model(model.features, w, bias) if len(order) else model


def _scored(model: Model):
    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            rows = list(model.score(texts_of(batch.column(1))))
            bad = [[{"start": a, "end": b, "score": p} for a, b, p in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(bad, kinds)], names=["doc_id", "score", "n_sentences", "offending"])

    return run


def sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_bytes: int = MAX_BYTES) -> tuple[list[bytes | None], list[int]]:
    """Texts and labels of at most ``max_docs`` labelled documents of at most ``max_bytes`` together, in the order of a hash of doc_id.

    Rows with crc32(doc_id as text) mod 4 = 2, null labels, and ids that are labelled both ways are left out; of
    rows of one id, the largest text is taken."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", 4) != 2)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y1")).filter("y = y1")
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    found = sizes.join(known, "doc_id").groupBy("doc_id").agg(F.max("bytes").alias("bytes"), F.first("y").alias("y")).orderBy(*order).limit(max_docs).collect()
    labels_of, total = {}, 0
    for r in found:
        if total + r["bytes"] <= max_bytes:
            labels_of[r["doc_id"]], total = int(r["y"]), total + r["bytes"]
    some = docs.sparkSession.createDataFrame([(i,) for i in labels_of], "doc_id long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max_by("text", F.struct(F.octet_length("text"), "text")).alias("text")).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in rows}
    return [texts[i] for i in labels_of], list(labels_of.values())


def toxic_scores(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, threshold: float = TOXIC, id_col: str = "doc_id") -> DataFrame:
    """Scores of all texts: doc_id, held_out, score, predicted, n_sentences, offending (sentences' start, end, score).

    A document is a bag of sentences; the chance that a document is toxic is that of at least one of its
    sentences being so. Weights are learned from labels of documents alone, on a sample of at most ``max_docs``
    and MAX_BYTES (a bound of the driver's memory and time); every row of ``docs`` is scored, each where it is read. A text
    without words (null, empty) has no sentence and scores 0; without labels of both kinds all do.
    Scores depend on the text only, so repeated rows, and rows with null or repeated ids, each get their own text's; a
    score of just the threshold is toxic. ``id_col`` is given as doc_id; labels are always met by doc_id. Other columns
    are ignored."""
    ship(docs.sparkSession)
    texts, y = sample(docs, labels, "toxic", max_docs)
    model = fitted(texts, y)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>")
    return rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic.

    Rows are told apart by a row number: of rows that share an id, or have none, just those whose own text is found go,
    and rows that are repeated as a whole go or stay together. Null and empty texts stay. Columns of any name pass."""
    rows = numbered(docs)
    toxic, _ = written(toxic_scores(rows, labels, id_col=ROW).filter("predicted = 1").select("doc_id"), "toxic")
    return without(rows, toxic)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
