"""Operator 9. Language-model scores by deleted interpolation."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import hashed, mixed, remainder, ship, small, texts_of, written

#: Bytes of text of a block of rows, and entries of an owner's bucket.
BLOCK_BYTES, BUCKET_ENTRIES = 8 << 20, 2_000_000
#: Tokens of the longest n-gram.
ORDER = 2
#: Context-frequency buckets: a context seen c times is in bucket min(ceil(log2(c + 1)), last).
LAST_BUCKET = 20
#: Steps of EM, and steps of a decade that probabilities are rounded to while the weights are learned.
EM_STEPS, GRID = 60, 20

_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_REQUEST = "f string, b long, r0 long, r1 long, held int, kind int, bucket int, hashes binary, train binary, deleted binary"
_ANSWER = "f string, b long, r0 long, r1 long, held int, kind int, bucket int, train binary, deleted binary, tokens long, types long, deleted_tokens long"


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)


def _grams(texts: list[bytes | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text's tokens (words and one end): hashes of the n-grams that end there, n from 1 to ``order``, and offsets.

    Before a text stand as many starts as an n-gram needs."""
    tokens, sizes = [], []
    for _, _, h, ptr in hashed(texts):
        n = np.diff(ptr)
        at = ptr[1:] + np.arange(len(n))
        out = np.empty(len(h) + len(n), np.uint64)
        ends = np.zeros(len(out), bool)
        ends[at] = True
        out[ends], out[~ends] = _END, h
        tokens.append(out)
        sizes.append(n + 1)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    w = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    ptr = np.concatenate([[0], np.cumsum(n)])
    grams, starts = [w], _START
    for _ in range(order - 1):
        before = np.empty_like(w)
        before[1:] = grams[-1][:-1]
        before[ptr[:-1]] = starts
        grams.append(mixed(before * _STEP + w))
        starts = np.uint64((int(starts) * int(_STEP) + int(_START)) & (1 << 64) - 1)
    return grams, ptr


def _counted(h: np.ndarray, train: np.ndarray, deleted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, at = np.unique(h, return_inverse=True)
    return u, np.bincount(at[train], minlength=len(u)), np.bincount(at[deleted], minlength=len(u))


def _requests(buckets: list[int]):
    """Each block's distinct n-grams, with its own counts of them, packed by owner."""

    def run(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def part(key, r0, r1, items):
            out = []
            for held in (0, 1):
                mine = [x for x in items if x[1] == held]
                if not mine:
                    continue
                grams, ptr = _grams([x[0] for x in mine], len(buckets))
                docs = np.array([x[2] for x in mine], bool)
                train = np.repeat(docs, np.diff(ptr))
                for kind, h in enumerate(grams):
                    t = train
                    if kind == 1:  # the starts of texts are contexts too
                        h, t = np.append(h, np.full(len(mine), _START)), np.append(train, docs)
                    u, a, d = _counted(h, t, t & bool(held))
                    owner = (u >> np.uint64(32)).astype(np.uint64) * np.uint64(buckets[kind]) >> np.uint64(32)
                    cut = np.searchsorted(owner, np.arange(buckets[kind] + 1))
                    for k in np.flatnonzero(np.diff(cut)):
                        s = slice(cut[k], cut[k + 1])
                        out.append((*key, r0, r1, held, kind, int(k), u[s].astype("<u8").tobytes(), _pack(a[s]), _pack(d[s])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in _REQUEST.split(", ")])

        key, items, r0, r1, size = None, [], 0, 0, 0
        for batch in batches:
            files, index, block, held, train = (batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5))
            for text, f, r, b, d, t in zip(texts_of(batch.column(0)), files, index, block, held, train, strict=True):
                if items and (key != (f, b) or r < r1):
                    yield part(key, r0, r1, items)
                    items, size = [], 0
                if not items:
                    key, r0 = (f, b), r
                items.append((text, d, t))
                r1, size = r, size + len(text or b"")
        if items:
            yield part(key, r0, r1, items)

    return run


def _answer(table):
    """An owner's part of the counts of the corpus, sent back to each block in the order in which it asked."""
    import pyarrow as pa

    hashes = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
    cut = np.cumsum([0] + [len(x) for x in hashes])
    u, at = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([_unpack(x) for x in table[c].to_pylist()]), minlength=len(u)).astype(np.int64) for c in ("train", "deleted")]
    n, first = len(hashes), table["kind"][0].as_py() == 0
    out = {c: table[c].to_pylist() for c in ("f", "b", "r0", "r1", "held", "kind", "bucket")}
    for c, s in zip(("train", "deleted"), sums, strict=True):
        out[c] = [_pack(s[at[cut[i] : cut[i + 1]]]) for i in range(n)]
    for c, v in (("tokens", sums[0].sum()), ("types", (sums[0] > 0).sum()), ("deleted_tokens", sums[1].sum())):
        out[c] = [int(v) if first else 0] + [0] * (n - 1)
    types = [pa.string(), *[pa.int64()] * 3, *[pa.int32()] * 3, *[pa.binary()] * 2, *[pa.int64()] * 3]
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def _looked_up(docs, answers, order: int):
    """For each part of a block: its rows' places in ``docs``, offsets of their tokens, and per token the corpus counts
    (all and deleted) of the n-grams that end there, n from 1 to ``order``, and of the contexts of those from 2 on."""
    texts, index, held = texts_of(docs["text"]), np.array(docs["row"].to_pylist(), np.int64), np.array(docs["held"].to_pylist(), np.int64)
    parts: dict = {}
    for x in answers.to_pylist():
        parts.setdefault((x["r0"], x["r1"], x["held"]), {}).setdefault(x["kind"], []).append((x["bucket"], x["train"], x["deleted"]))
    for (r0, r1, part_held), kinds in parts.items():
        mine = np.flatnonzero((index >= r0) & (index <= r1) & (held == part_held))
        mine = mine[np.argsort(index[mine], kind="stable")]
        if not len(mine):
            continue
        grams, ptr = _grams([texts[i] for i in mine], order)
        counts, starts = [], (0, 0)
        for k, h in enumerate(grams):
            u, at = np.unique(np.append(h, _START) if k == 1 else h, return_inverse=True)
            found = [np.concatenate([_unpack(x[c]) for x in sorted(kinds[k])]) for c in (1, 2)]
            assert len(u) == len(found[0]), "a block's rows differ from the pass that asked"
            if k == 1:
                starts, at = [c[at[-1]] for c in found], at[:-1]
            counts.append([c[at] for c in found])
        contexts = []
        for shorter in counts[:-1]:
            contexts.append([])
            for c, texts_begun in zip(shorter, starts, strict=True):
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[ptr[:-1]] = texts_begun
                contexts[-1].append(before)
        yield mine, ptr, counts, contexts


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(c, 0) + 1.0)), LAST_BUCKET).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _estimates(weights: list[np.ndarray], counts: list, contexts: list, buckets: list, tokens: int, types: int) -> np.ndarray:
    """Probabilities of tokens by the levels that have weights: pairs with tokens and uniform, then each longer n-gram with all below."""
    lam = weights[0][buckets[0]]
    p = lam[:, 0] * _ratio(counts[1], contexts[0]) + lam[:, 1] * (counts[0] / max(tokens, 1)) + lam[:, 2] / (types + 1)
    for level, x in enumerate(weights[1:], 1):
        lam = x[buckets[level]]
        p = lam[:, 0] * _ratio(counts[level + 1], contexts[level]) + lam[:, 1] * p
    return p


def _grid(order: int, weights: list[np.ndarray], left_tokens: int, types: int):
    """Deleted tokens by context bucket and rounded probabilities from the counts that remain without them: of the shortest
    n-grams without weights as yet, and of what is below them."""

    def run(docs, answers):
        import pyarrow as pa

        sums: dict = {}
        for _, _, counts, contexts in _looked_up(docs, answers, order):
            counts, contexts = ([c[0] - c[1] for c in cs] for cs in (counts, contexts))
            level = len(weights)
            below = _estimates(weights, counts, contexts, [_bucket(c) for c in contexts], left_tokens, types) if weights else counts[0] / max(left_tokens, 1)
            q2, q1 = (np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-300)) * GRID), 9999).astype(np.int64) for p in (_ratio(counts[level + 1], contexts[level]), below))
            cells, n = np.unique(np.stack([_bucket(contexts[level]), q2, q1], 1), axis=0, return_counts=True)
            for cell, k in zip(map(tuple, cells.tolist()), n.tolist(), strict=True):
                sums[cell] = sums.get(cell, 0) + k
        rows = [(*c, k) for c, k in sums.items()]
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["bucket", "q2", "q1", "n"])

    return run


def learned_weights(cells: list[tuple[int, int, int, int]], types: int | None, steps: int = EM_STEPS) -> np.ndarray:
    """Weights for each context bucket, by EM over (bucket, q2, q1, n): of n-grams, of what is below and, if ``types`` is given, uniform.

    A bucket without deleted tokens takes the weights of all buckets together."""
    x = np.array(cells, np.int64).reshape(-1, 4)
    p = [np.where(x[:, i] == 9999, 0.0, 10.0 ** (np.where(x[:, i] == 9999, 0, x[:, i]) / GRID)) for i in (1, 2)]
    p = np.stack(p if types is None else [*p, np.full(len(x), 1.0 / (types + 1))], 1)
    out = np.zeros((LAST_BUCKET + 1, p.shape[1]))

    def em(mine: np.ndarray, weight: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            share = p[mine] * weight
            share *= (x[mine, 3] / share.sum(1))[:, None]
            weight = np.maximum(share.sum(0) / x[mine, 3].sum(), 1e-6)
            weight /= weight.sum()
        return weight

    even = np.full(p.shape[1], 1 / p.shape[1])
    common = em(np.arange(len(x)), even) if len(x) else even
    for b in range(LAST_BUCKET + 1):
        mine = np.flatnonzero(x[:, 0] == b)
        out[b] = em(mine, even) if len(mine) else common
    return out


def _scores(order: int, weights: list[np.ndarray], tokens: int, types: int):
    def run(docs, answers):
        import pyarrow as pa

        ids = docs["doc_id"]
        out = []
        for mine, ptr, counts, contexts in _looked_up(docs, answers, order):
            counts, contexts = ([c[0] for c in cs] for cs in (counts, contexts))
            p, one = _estimates(weights, counts, contexts, [_bucket(c) for c in contexts], tokens, types), counts[0]
            first = ptr[:-1]
            base = np.log10((one + 1) / (tokens + 1 * (types + 1)))
            out.append((mine, np.diff(ptr), np.add.reduceat((one > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)))
        if not out:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["doc_id", "scored", "n_tokens", "n_known", "base_score", "score"])
        at = np.concatenate([x[0] for x in out])
        return pa.table(
            [ids.combine_chunks().take(pa.array(at)), docs["scored"].combine_chunks().take(pa.array(at)), *[pa.array(np.concatenate([x[i] for x in out])) for i in range(1, 5)]],
            names=["doc_id", "scored", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def _blocked(source: DataFrame, rows: int) -> DataFrame:
    """Rows with the number of their block: so many consecutive rows of a file, cut further where their texts have more than BLOCK_BYTES.

    Most stretches are one block; where others begin is a narrow table."""
    stretch = F.floor(F.col("row") / rows)
    before = F.sum("n").over(W.partitionBy("f", "g").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    narrow = source.select("f", "row", stretch.alias("g"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    firsts = narrow.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_BYTES)).groupBy("f", "g", "piece").agg(F.min("row").alias("first"))
    several = firsts.groupBy("f", "g").agg(F.array_sort(F.collect_list("first")).alias("firsts")).filter(F.size("firsts") > 1)
    several, _ = written(several, "lm-blocks")
    begun = F.array_max(F.filter("firsts", lambda x: x <= F.col("row")))
    return source.withColumn("g", stretch).join(small(several), ["f", "g"], "left").withColumn("b", F.coalesce(begun, F.col("g") * rows)).drop("g", "firsts")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, test_fold: int = 2, deleted_fold: int = 3, order: int = ORDER) -> DataFrame:
    """Scores of all texts by an n-gram model of ``order`` 2 or more: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    P(w | h) = a * c(h, w) / c(h) + b * c(w) / N + c / (V + 1) for the token h before w, with weights (a, b, c) for each bucket of
    c(h). In a longer model, P(w | g h) = d * c(g h, w) / c(g h) + (1 - d) * P(w | h), with d for each bucket of c(g h), and so on.
    Texts of fold ``test_fold`` aren't learned from. The weights are learned by EM on the counts of fold
    ``deleted_fold`` against estimates from the other learned folds; then all learned folds give the estimates.

    Counts never visit the driver and no table of them is broadcast. A block of consecutive rows sends its
    distinct n-grams, hashed and packed, to their owners; an owner adds up the corpus and answers each block with
    the counts in the order of its question; a block then has all that its tokens need. So a frequent n-gram
    costs one entry for each block, not for each occurrence. EM needs the deleted fold only as a histogram over a
    grid of bounded size.

    Rows are blocked by file and row number, and by bytes where long texts stand together; a table that isn't read from files is written to
    the shared folder first. Null texts are empty: one token, the end. A null id counts as a text of fold 0."""
    spark = docs.sparkSession
    ship(spark)
    keep = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    try:
        source = docs.select(*keep, F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # no file source
        source = written(docs.select(*keep), "lm-docs")[0].select("doc_id", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("row"))
    fold = remainder("doc_id", folds)
    size = docs.select(F.sum(F.octet_length(text_col)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    rows = max(1, int(BLOCK_BYTES * size["rows"] / max(size["bytes"] or 0, 1)))
    words = (size["bytes"] or 0) / 6
    buckets = [1 + int(words * part / BUCKET_ENTRIES) for part in (0.25, 0.75, *[1.0] * (order - 2))]
    source = _blocked(source, rows).select("doc_id", "text", "f", "row", "b", (fold == deleted_fold).cast("int").alias("held"), (fold != test_fold).alias("train"))

    asked = source.select("text", "f", "row", "b", "held", "train").mapInArrow(_requests(buckets), _REQUEST)
    # the questions' shuffle files are of no use once the answers are written, and go then
    answers, _ = written(asked.groupBy("kind", "bucket").applyInArrow(_answer, _ANSWER), "lm-answers", sweep=True)
    total = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "deleted_tokens")]).first()
    answers = answers.drop("tokens", "types", "deleted_tokens")

    blocks = source.select("doc_id", "text", "row", "held", (~F.col("train")).alias("scored"), "f", "b")
    held = blocks.filter("held = 1").groupBy("f", "b").cogroup(answers.filter("held = 1").groupBy("f", "b"))
    weights: list[np.ndarray] = []
    for level in range(order - 1):
        cells = held.applyInArrow(_grid(order, list(weights), total["tokens"] - total["deleted_tokens"], total["types"]), "bucket long, q2 long, q1 long, n long")
        cells = [tuple(r) for r in cells.groupBy("bucket", "q2", "q1").agg(F.sum("n")).collect()]
        weights.append(learned_weights(cells, None if level else total["types"]))
    scored = blocks.groupBy("f", "b").cogroup(answers.groupBy("f", "b")).applyInArrow(_scores(order, weights, total["tokens"], total["types"]), "doc_id long, scored boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", F.col("scored").alias("held_out"), "n_tokens", "n_known", F.lit(total["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
