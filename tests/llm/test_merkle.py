import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.merkle import folded, merkle_proofs, op11_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root of the nodes, and of each the steps (left, right) of its path."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = nodes[a // 3 * 3 : a // 3 * 3 + 3]
            paths[k].append(("".join(run[: a % 3]), "".join(run[a % 3 + 1 :])))
            at[k] = a // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    first = {k: (x := sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), *tree([leaf(r) for r in x])) for k in keys}
    root, tops = tree([first[k][1] for k in keys])
    out = []
    for k, top in zip(keys, tops):
        for r, path in zip(first[k][0], first[k][2]):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for a, b in path + top:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), first[k][1], root, sha("".join(a + b for a, b in path + top)), h, h == root))
    return sorted(out, key=repr)


def rows_of(n):
    rows = [(i * 7 % 1009 if i % 11 else None, None if i % 13 == 0 else f"s{min(i % 17, 3)}", "en" if i % 5 else None, i if i % 3 else None, None if i % 19 == 0 else "long " * (3000 * (i == 5)) + f"ä\n{i % 23}") for i in range(n)]
    rows += [(5, "hot", "de", 1, "same\ntext")] * (n // 2)  # repeated rows
    return rows + [(1, "lone", "", 0, ""), (2, "ﬀ", "x", 1, "1:2"), (3, "𐀀", "x", 1, "\n"), (4, "", None, None, None)]


@pytest.mark.parametrize("n,least", [(0, 1000), (9, 1), (260, 1000), (260, 20)])
def test_against_brute_force(spark, tmp_path, monkeypatch, n, least):
    """Groups of one row, groups that several partitions share, ties, nulls, repeated rows and names beyond ASCII."""
    monkeypatch.setattr(merkle, "LEAST_ROWS", least)
    rows = rows_of(n)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)


def test_groups_over_many_partitions(spark, monkeypatch):
    """More partitions than the setting, so that every level has ragged nodes; and groups so many that their roots are cut too."""
    monkeypatch.setattr(merkle, "PARTITION_ROWS", 7)
    monkeypatch.setattr(merkle, "LEAST_ROWS", 1)
    rows = [(i, f"s{i % 40}" if i < 80 else "hot", "en", i, f"t{i}") for i in range(230)]
    out = merkle_proofs(spark.createDataFrame(rows, SCHEMA))
    got = out.select("doc_id", "leaf", "subroot", "root", folded(F.col("leaf"), F.col("proof")).alias("f"))
    want = {r[0]: r[1:4] for r in brute(rows)}
    for r in got.collect():
        assert (r.leaf, r.subroot, r.root) == want[r.doc_id] and r.f == r.root


def test_empty_and_extra_columns(spark):
    assert merkle_proofs(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = rows_of(30)
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.select("*", *[F.lit("x").alias(c) for c in "grp node kept place_by salt level place path root leaf proof by id".split()])
    cut = lambda d: sorted(((r.doc_id, r.leaf, r.root, repr(r.proof)) for r in merkle_proofs(d).collect()), key=repr)
    assert cut(odd) == cut(docs)
