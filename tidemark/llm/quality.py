"""Operator 6. Quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _SPACE, RUN_BYTES, remainder, ship, texts_of, word_hashes
from tidemark.llm.toxicity import sample

#: Bounds on the labelled documents that the field is fitted on and on their bytes, and the score from which a document is good.
MAX_DOCS, MAX_BYTES, GOOD = 4000, 16 << 20, 0.7
#: Shares of a text's length that are good, at least in a good document and at most in a bad one, and how fast a document's bias follows.
#: Chosen on rows that may be learned from: of those of sf0.1, remainders 0 and 1 to fit and 3 to choose by.
GOOD_SHARE, BAD_SHARE, RATE = 0.9, 0.2, 8.0
#: Relative change of the weights over ten steps below which the fit ends.
SETTLED = 0.02

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:", b"!?", b"|", b"#$%&*~^", b"<>{}[]()=/\\", b"@_-+\"'`"]
_CLASS = np.full(256, len(_GROUPS), np.int64)  # the last class: bytes of other characters
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
_KINDS = len(_GROUPS) + 1


def lines(texts: list[bytes | None], limit: int = RUN_BYTES):
    """Over runs of texts: (first, last + 1, features of lines, lines' lengths in bytes, offsets of texts' lines).

    A text has one line more than line feeds; an empty one has one empty line. A line has its own features and those of the lines before and after it (zeros where there is none)."""
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= limit):
            part.append(texts[j] or b"")
            size += len(part[-1]) + 1
            j += 1
        raw = b"\n".join(part) + b"\n"
        a = np.frombuffer(raw, np.uint8)
        stop = np.flatnonzero(a == 10)
        first = np.concatenate([[0], stop[:-1] + 1])
        length = stop - first
        line = np.repeat(np.arange(len(stop)), length + 1)
        count = np.bincount(line * _KINDS + _CLASS[a], minlength=len(stop) * _KINDS).reshape(-1, _KINDS).astype(float)
        count[:, -1] -= 1  # the line feed itself
        share = count / np.maximum(length, 1)[:, None]
        h, start, end = word_hashes(raw)
        of = line[start]
        words = np.bincount(of, minlength=len(stop)).astype(float)
        distinct = np.zeros(len(stop))
        if len(h):
            order = np.lexsort((h, of))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
            distinct = np.bincount(of[order][new], minlength=len(stop)).astype(float)
        mean = np.bincount(of, weights=end - start, minlength=len(stop)) / np.maximum(words, 1)
        lone = np.bincount(of, weights=end - start == 1, minlength=len(stop)) / np.maximum(words, 1)
        ends = np.isin(a[np.maximum(stop - 1, first)], np.frombuffer(b".!?", np.uint8)) & (length > 0)
        own = np.column_stack([np.ones(len(stop)), length == 0, np.log1p(length) / 5, np.sqrt(share), distinct / np.maximum(words, 1), np.minimum(mean, 30) / 10, lone, ends, words < 4])
        at = np.searchsorted(first, np.cumsum([0] + [len(x) + 1 for x in part]))
        head = np.zeros(len(stop), bool)
        head[at[:-1]] = True
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[head] = 0
        after[np.append(head[1:], True)] = 0
        yield i, j, np.hstack([own, before, after]), length, at
        i = j


def marginals(emission: np.ndarray, move: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains: emission (line, label) and transition log weights. Chains advance together.

    Returns log marginals (line, label), each chain's log partition, and expected transitions summed over all chains."""
    fore, back, total = _passes(emission, move, at)
    return fore + back - np.repeat(total, np.diff(at))[:, None], total, _transitions(emission, move, at, fore, back, total)


def _passes(emission: np.ndarray, move: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, count = len(emission), np.diff(at)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(count.max()) if len(count) else 0
    by_length = np.argsort(-count, kind="stable")
    sizes = count[by_length]
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # chains with more than t lines
    first, last = at[:-1][by_length], at[1:][by_length] - 1
    for t in range(longest):
        k = first[: live[t]] + t
        if t:
            x = fore[k - 1][:, :, None] + move
            fore[k] = np.logaddexp(x[:, 0], x[:, 1])
        fore[k] += emission[k]
    total = np.zeros(len(count))
    total[by_length] = np.logaddexp(*fore[last].T)
    for t in range(1, longest):
        k = last[: live[t]] - t
        x = move + (emission[k + 1] + back[k + 1])[:, None, :]
        back[k] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    return fore, back, total


def _transitions(emission: np.ndarray, move: np.ndarray, at: np.ndarray, fore: np.ndarray, back: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Expected transitions, summed over all chains."""
    inner = np.ones(len(emission), bool)
    inner[at[1:] - 1] = False
    k = np.flatnonzero(inner)
    x = fore[k][:, :, None] + move + (emission[k + 1] + back[k + 1])[:, None, :]
    return np.exp(x - np.repeat(total, np.diff(at))[k][:, None, None]).sum(0)


class Field:
    """Labels 0 (bad) and 1 (good): weights of features for good, transitions, and a calibration of the aggregate."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, scale: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.move, self.scale, self.shift = weights, move, scale, shift

    def emission(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack([np.zeros(len(features)), features @ self.weights])

    def parts(self, texts: list[bytes | None]):
        """Per run of texts: offsets of their lines, lines' chances to be good, and the length-weighted mean of these."""
        for i, j, features, length, at in lines(texts):
            good = np.exp(np.minimum(marginals(self.emission(features), self.move, at)[0][:, 1], 0))
            weight = length + 1.0
            yield at, good, np.add.reduceat(good * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        x = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale * np.log(x / (1 - x)) + self.shift)))


def fitted(texts: list[bytes | None], labels: list[int], steps: int = 200, first: int = 20, shares: tuple[float, float] = (GOOD_SHARE, BAD_SHARE), rate: float = RATE) -> Field:
    """A field fitted to labels of documents, its lines' labels being hidden.

    A document's label says only what share of its text is good: at least GOOD_SHARE by length in a good one, at most
    BAD_SHARE in a bad one. Each step takes the distribution over labellings that is nearest to the field's own and
    keeps to that in expectation (posterior regularisation, Ganchev et al. 2010; its multiplier for a document is a bias
    of its lines, which rises or falls while the share is missed), and moves the field towards it by Adam, by expected
    features and transitions. The first steps take a document's label for that of all its lines, as a start. Last, the
    aggregate is calibrated by a logistic curve on the same documents."""
    parts, counts, sizes = [], [], []
    for _, _, features, length, at in lines(texts):
        parts.append(features)
        sizes.append(length + 1.0)
        counts += np.diff(at).tolist()
    y = np.array(labels, int)
    width = lines_width()
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(width), np.zeros((2, 2)), 0.0, 4.0 if len(y) and y.min() else -4.0 if len(y) else 0.0)
    x, at = np.vstack(parts), np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate(sizes)
    weight /= np.repeat(np.add.reduceat(weight, at[:-1]), counts)
    whole = np.repeat(y, counts).astype(float)
    kept = np.zeros((2, 2))
    for c in (0, 1):
        kept[c, c] = sum(k - 1 for k, z in zip(counts, y, strict=True) if z == c)
    theta, bias = np.zeros(width + 4), np.zeros(len(y))
    m = v = np.zeros(width + 4)
    lines_n, before = len(x), theta
    twice = np.concatenate([at, at[1:] + at[-1]])
    for t in range(1, steps + 1):
        w, move = theta[:width], theta[width:].reshape(2, 2)
        z = x @ w
        truth, moves = whole, kept
        if t <= first:
            log_p, _, pairs = marginals(np.column_stack([np.zeros(lines_n), z]), move, at)
        else:  # the field's own distribution and that with the biases, in one walk over both
            both = np.column_stack([np.zeros(2 * lines_n), np.concatenate([z, z + np.repeat(bias, counts)])])
            fore, back, total = _passes(both, move, twice)
            parted = [(both[k], move, at, fore[k], back[k], total[c]) for k, c in ((slice(0, lines_n), slice(0, len(y))), (slice(lines_n, None), slice(len(y), None)))]
            pairs, moves = (_transitions(*half) for half in parted)
            log_p, truth = (f + b - np.repeat(u, counts)[:, None] for _, _, _, f, b, u in parted)
            truth = np.exp(truth[:, 1])
            share = np.add.reduceat(truth * weight, at[:-1])
            bias = np.where(y > 0, np.maximum(0, bias + rate * (shares[0] - share)), np.minimum(0, bias + rate * (shares[1] - share)))
        g = np.concatenate([x.T @ (np.exp(log_p[:, 1]) - truth), (pairs - moves).ravel()]) / lines_n + 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if t % 10 == 0 and t >= 2 * first:  # Adam's steps stay long; what tells is where they lead to
            if np.linalg.norm(theta - before) < SETTLED * np.linalg.norm(theta):
                break
            before = theta
    field = Field(theta[:width], theta[width:].reshape(2, 2))
    mean = np.concatenate([p[2] for p in field.parts(texts)])
    z = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1))
    scale, shift = 1.0, 0.0
    for _ in range(60):  # Newton, with a small prior on both
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        r = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * z).sum() + 0.1 * (scale - 1), (p - y).sum() + 0.1 * shift])
        hess = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        scale, shift = scale - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return Field(field.weights, field.move, float(scale), float(shift))


def lines_width() -> int:
    return next(lines([b"a"]))[2].shape[1]


def _scored(field: Field):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score, n, bad = [], [], []
            for at, good, mean in field.parts(texts_of(batch.column(1))):
                score.append(field.calibrated(mean))
                n.append(np.diff(at))
                bad.append(np.add.reduceat((good < 0.5).astype(np.int64), at[:-1]))
            cat = [np.concatenate(x) if x else np.zeros(0) for x in (score, n, bad)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cat[0], pa.float64()), pa.array(cat[1].astype(np.int32)), pa.array(cat[2].astype(np.int32))], names=["doc_id", "score", "n_lines", "n_bad_lines"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, threshold: float = GOOD) -> DataFrame:
    """Scores of all texts: doc_id, held_out, score, predicted, n_lines, n_bad_lines.

    A linear-chain conditional random field labels each line good or bad from its own and its neighbours' shape;
    a text's score is the mean of its lines' marginals weighted by length, calibrated. It is fitted on the driver
    on a sample of at most ``max_docs`` labelled documents and MAX_BYTES; scoring takes every line of
    every row, where it is read. A null or empty text is one empty line; labels of one kind only
    give every text the same score. Scores depend on the text only, so repeated rows, and rows with null or repeated
    ids, each get their own text's; a score of just the threshold is good. Other columns are ignored."""
    ship(docs.sparkSession)
    texts, y = sample(docs, labels, "quality", max_docs, MAX_BYTES)
    field = fitted(texts, y)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(field), "doc_id long, score double, n_lines int, n_bad_lines int")
    return rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


assert _SPACE[10]  # a line feed ends a word, so no word spans lines
