import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair
from tidemark.llm.conversation_repair import damaged, op12_conversation_repair, repair_report, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.rstrip(SPACE)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Every way to edit the rows, roles chosen freely, that can still be at most as dear as deleting all; the cheapest with the least audit."""
    best = [4 * len(rows), "D" * len(rows), []]
    begins = re.compile("s?(ua)*u?")

    def go(k, cost, audit, out, inserted):
        if cost > best[0] or not begins.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) and (cost, audit) < (best[0], best[1]):
                best[:] = [cost, audit, out]
        else:
            role, text = rows[k][2:]
            late = 3 * (kinds[k] == "t")
            go(k + 1, cost + 4, audit + "D", out, 0)
            if kinds[k] not in ("b", "d"):
                go(k + 1, cost + late, audit + "K", [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    go(k + 1, cost + 3 + late, audit + "R", [*out, (r, text)], 0)
        if inserted < 3:
            for r in ("user", "assistant"):
                go(k, cost + 3, audit + "I", [*out, (r, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best


def brute(rows, ids):
    out = []
    for c in ids:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds, turns = faults(own), {r[1] for r in own} - {None}
        cost, audit, said = cheapest(own, kinds)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *[kinds.count(k) for k in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=repr)


def rows_of(n, seed=3):
    pick = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(pick.randrange(6)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, pick.choice([t, t, t + 1, 9 * t, None]), role, pick.choice(["Yes.", "No", "ä! \n", "", " \t", None, "Why?", "long " * 2000 + "."])))
    return rows


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment,joined", [(256, 64), (1, 2), (2, 2)])
def test_against_brute_force(spark, tmp_path, monkeypatch, segment, joined):
    """Nulls, ties, repeated rows, foreign and empty roles; segments so short that every conversation has several."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    monkeypatch.setattr(conversation_repair, "JOINED", joined)
    rows = rows_of(60)
    rows += rows[:20]  # repeated rows
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = collected(op12_conversation_repair(spark, str(tmp_path)))
    assert got == brute(hurt(rows), {r[0] for r in rows})


def test_dropped_conversations_and_empty(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi."), (gone, 0, "user", "Ho.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert collected(op12_conversation_repair(spark, str(tmp_path))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """A conversation of many segments: joined pieces give what one segment gives."""
    pick = random.Random(5)
    rows = [(1, t, pick.choice(["user", "assistant"]), pick.choice([f"a{t}.", f"b{t}", "same.", ""])) for t in range(900)] + [(c, 0, "user", "Hi.") for c in range(2, 40)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(conversation_repair, "SEGMENT", 1000)
    whole = collected(repair_report(turns))
    monkeypatch.setattr(conversation_repair, "SEGMENT", 7)
    monkeypatch.setattr(conversation_repair, "JOINED", 5)
    assert collected(repair_report(turns)) == whole
    # the repaired turns are those of the hash, alternate, and cost what is said
    report = next(r for r in whole if r[0] == 1)
    said = sorted(r for r in collected(repaired_turns(turns)) if r[0] == 1)
    said.sort(key=lambda r: r[1])
    assert hashlib.sha256("\n".join(f"{r[3]}:{r[4]}" for r in said).encode()).hexdigest() == report[8]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[3][0] for r in said))
    assert len(report[7].replace("I", "")) == 900 and "".join(r[2] for r in said) == report[7].replace("D", "")


def test_extra_columns(spark):
    turns = spark.createDataFrame(rows_of(20), SCHEMA)
    odd = turns.select("*", *[F.lit("x").alias(c) for c in "grp block pos ini fault begins bucket cost audit said seg k at copy salt part shift".split()])
    assert collected(repair_report(odd)) == collected(repair_report(turns))
    assert collected(repair_report(damaged(odd))) == collected(repair_report(damaged(turns)))
