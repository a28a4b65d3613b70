"""Operator 5. Secret scans with multipart credential linking."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, small, texts_of, written

#: Kinds of spans, in the order of the result: three that stand alone, three that need company.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
#: Code points between parts of one credential, at most; also the width of a block of the interval join.
SCOPE = 240

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")

#: Weak on their own: a login or client id, a mixed token without a keyword, a place to connect to.
_IDENT = re.compile(r"""(?ai:\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]{3,})""")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?ai:\b(?:https?|jdbc:[a-z]+|s3|ftp|mongodb|redis|amqp|postgres(?:ql)?)://[^\s"'<>]{3,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""")

_WORD = np.zeros(256, bool)
_WORD[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]] = True
_LOW_HEX = np.zeros(256, bool)
_LOW_HEX[list(b"0123456789abcdef")] = True
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_WEAK = (b"user", b"login", b"client", b"account", b"accesskey", b"access_key")
_PLACES = (b"://", b"host", b"endpoint", b"server")


def _longest(a: np.ndarray) -> int:
    """Longest run of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], a.view(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def spans_of(data: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and weak candidates of a text: (start, kind, end) in code points, by start and kind.

    The regular expressions only run where a byte test says that they can match."""
    low, a = data.lower(), np.frombuffer(data, np.uint8)
    run = _longest(_WORD[a]) if len(a) >= 16 else 0
    keys = any(k in low for k in _KEYS)
    akia = b"AKIA" in data
    hexes = run >= 16 and _longest(_LOW_HEX[a]) >= 16
    idents, places = any(k in low for k in _WEAK), any(k in low for k in _PLACES)
    if not (keys or akia or hexes or idents or places or run >= 20):
        return [], []
    text = data.decode()
    base = []
    if keys:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if akia:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if hexes:  # a run of hexadecimal digits is one match, so runs of 16 and more are those that pass
        base += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    weak = []
    if idents:
        weak += [(m.start(), 3, m.end()) for m in _IDENT.finditer(text)]
    if run >= 20:
        weak += [(m.start(), 4, m.end()) for m in _SECRET.finditer(text)]
    if places:
        weak += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    base.sort()
    if weak and base:  # what a base span covers is reported already
        start, end = np.array([s for s, _, _ in base]), np.maximum.accumulate([e for _, _, e in base])
        weak = [w for w in weak if (k := int(np.searchsorted(start, w[2], "left"))) == 0 or end[k - 1] <= w[0]]
    return base, sorted(weak)


def _scan(batches):
    import pyarrow as pa

    kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [spans_of(x or b"") for x in texts_of(batch.column(1))]
        n = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(3)]
        lists = [pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in f[i]] for f in found], kinds) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *n, *lists], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "weak"])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Secrets of all texts: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Base spans stand alone: an assignment to a secret's name with a value of 12 characters, an access identifier
    of 18, a run of 16 hexadecimal digits. Weak candidates (a login, a mixed token without a name, an endpoint)
    are reported only where the parts that complete a credential are in their scope, that is at most ``scope``
    code points away in the same text: a login needs a secret, a token needs an identifier, an endpoint needs
    both. Parts are linked by an interval join: an equi-join on text and block of ``scope`` code points, a weak part
    being listed in all blocks from its start to its end and its partners also in the neighbouring ones, then the
    distance. It only asks whether there is a partner, so no pairs come out of it.

    Null texts are empty: no spans, the sha256 of an empty string, empty ``spans``. Rows are told apart by a row
    number of the written scan, so null and repeated ids each give their own row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start:int,kind:int,end:int>>, weak array<struct<start:int,kind:int,end:int>>"
    )
    rows, _ = written(rows.withColumn("rid", F.monotonically_increasing_id()), "secrets")
    parts = rows.filter("size(weak) > 0").select("rid", F.explode(F.concat("base", "weak")).alias("s")).select("rid", "s.*")
    weak = parts.filter("kind >= 3")
    # a weak part is listed in every block that it touches, its partners in every block that their scope touches
    own = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    blocks = F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / scope), F.floor((F.col("end") + scope) / scope))
    near = parts.select("rid", F.col("start").alias("s2"), F.col("end").alias("e2"), "kind", F.explode(blocks).alias("block"))

    def beside(some: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
        other = near.filter(F.col("kind").isin(*kinds)).drop("kind")
        gap = (F.col("x.start") - F.col("y.e2") <= scope) & (F.col("y.s2") - F.col("x.end") <= scope)
        listed = some.withColumn("block", F.explode(own)).alias("x")
        found = listed.join(other.alias("y"), (F.col("x.rid") == F.col("y.rid")) & (F.col("x.block") == F.col("y.block")) & gap, "left_semi")
        return found.drop("block").distinct()

    identifiers, secrets = (1, 3), (0, 2, 4)
    linked = (
        beside(weak.filter("kind = 3"), secrets)
        .unionByName(beside(weak.filter("kind = 4"), identifiers))
        .unionByName(beside(beside(weak.filter("kind = 5"), identifiers), secrets))
    )
    linked = linked.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    linked, _ = written(linked, "secrets-linked")
    whole = rows.join(small(linked), "rid", "left")
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "linked")))
    return whole.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"), F.coalesce(F.size("linked"), F.lit(0)).alias("n_linked"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

