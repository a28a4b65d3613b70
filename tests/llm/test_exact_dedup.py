import hashlib
from collections import defaultdict

from tidemark.llm.exact_dedup import drop_exact, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)  # just one row of a group stays, also where several share the id
        out += [(i, keep, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


LONG = "ä" * 5000
ROWS = [
    (1, "same"), (2, "same"), (3, "same "), (4, None), (5, ""), (6, LONG), (7, LONG), (8, LONG + "x"), (9, LONG + "y"), (10, "a" * 128), (11, "a" * 128), (12, "a" * 129),
    (13, "a" * 1024), (14, "a" * 1152), (15, "a" * 1152), (None, "same"), (None, "lonely"), (16, "twice"), (16, "twice"), (17, "\x00"), (18, "\x00\x00"), (19, "z" * 90_000), (20, "z" * 90_000),
]


def test_against_brute_force(frame):
    for first, growth in ((128, 8), (1, 2), (3, 1)):
        rows = ROWS if growth > 1 else [r for r in ROWS if len(r[1] or "") < 20]
        got = sorted((tuple(r) for r in exact_groups(frame(rows), first=first, growth=growth).collect()), key=repr)
        assert got == brute(rows)


def test_hot_group(frame):
    rows = [(i, "hot " * 400) for i in range(3000)] + [(9000 + i, f"cold {i}") for i in range(100)]
    got = sorted((tuple(r) for r in exact_groups(frame(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_and_extra_columns(spark, docs_schema):
    assert exact_groups(spark.createDataFrame([], docs_schema)).collect() == []
    odd = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, keep_id int, grp string")
    assert {(r.doc_id, r.keep_id) for r in exact_groups(odd).collect()} == {(1, 2), (2, 2)}


def test_drop(frame):
    left = {r.doc_id for r in drop_exact(frame(ROWS)).collect()}
    assert {2, 5, 7, 8, 9, 11, 15, 16, 20} <= left and not {1, 4, 6, 10, 14, 19} & left
