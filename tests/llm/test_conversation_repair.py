import hashlib
import itertools
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from telltale.llm import conversation_repair as R
from telltale.sources.tables import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    spaced = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_report(rows):
    """By definition, with whole audits: the least (cost, audit) over all edits, for rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, last, inserts):
        """Least (cost, audit, lines) from row i on, after the initial ``last``."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserts:
            for initial in "ua":
                if initial in NEXT[last]:
                    cost, audit, lines = best(i, initial, inserts - 1)
                    ways.append((cost + 3, "I" + audit, (R._ROLES[initial] + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, last, 3)
            ways.append((cost + 4, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for letter, own, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if own[:1] and own[:1] in NEXT[last]:
                        cost, audit, lines = best(i + 1, own[:1], 3)
                        ways.append((cost + price + more, letter + audit, (f"{own}:{text}", *lines)))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, lines = best(0, "", 3)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def plain(rows, every):
    return {c: plain_report([r[1:] for r in rows if r[0] == c]) for c in every}


def random_rows(rng, conversations, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", " "]
    texts = ["a.", "b!", "c?", "c", " ", "", "d. \n", "é", "a."]
    return [
        (c, rng.choice([None, i, i, i, i // 2, i + 3]), rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(i) + "."]))
        for c in range(conversations)
        for i in range(rng.randint(0, most))
    ]


@pytest.mark.parametrize("in_memory", [1, 3, 1 << 20])
def test_against_all_edits(spark, in_memory):
    rows = random_rows(random.Random(in_memory), 300, 9)
    got = {r[0]: tuple(r)[1:] for r in R.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), in_memory).collect()}
    assert got == plain(rows, {r[0] for r in rows})


def test_query_against_all_edits(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in R.op12(spark, SF).collect()}
    assert got == plain(plain_damage(rows), {r[0] for r in rows})


def test_damage_and_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(r[0] if r[0] else None, *r[1:]) for r in random_rows(rng, 200, 4)]
    rows += [(900 + i, None, None, None) for i in range(40)] + [(1000 + i, 5, None, "x.") for i in range(40)]
    rows += [(2000, -(1 << 63), "user", "a."), (2000, (1 << 63) - 1, "assistant", "b.")] + [(2001, 1, "user", "a. " * 300_000)] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, key long")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    damaged = plain_damage(rows)
    got = sorted(map(tuple, R.damage(df).collect()), key=repr)
    assert got == sorted(damaged, key=repr)
    report = R.op12(spark, str(tmp_path)).collect()
    every = {r[0] for r in rows}
    want = plain(damaged, every)
    if len([r for r in damaged if r[0] == 2000]) == 2:
        want[2000] = (R._MAX_LONG, *want[2000][1:])
    assert len(report) == len(every)
    assert {r[0]: tuple(r)[1:] for r in report} == want
    assert any(c not in {r[0] for r in damaged} for c in every)  # a conversation that lost all its rows


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert R.op12(spark, str(tmp_path)).collect() == []


def test_repaired_rows_have_the_digest(spark):
    rows = random_rows(random.Random(5), 200, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = R.repaired_turns(df, in_memory=2).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("t"))
    made = {r["conv_id"]: hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in r["t"]).encode()).hexdigest() for r in turns.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    for r in R.repair(df).collect():
        assert made.get(r["conv_id"], nothing) == r["repaired_sha256"]


def test_a_giant_conversation_keeps_little(spark):
    """A million turns of one conversation: its steps go to a file, and the profiles stay few."""
    steps = R.Steps()
    conversation = R.Conversation(1, steps, 1 << 12)
    for i in range(1_000_000):
        conversation.add(i, "user" if i % 2 == 0 else "assistant" if i % 7 else "user", "t.", 2 * (i % 11 == 0), i % 13 == 0)
    assert len(conversation.log._now) < 1 << 12 and len(steps.made) < 2_000
    audit = conversation.report()[7]
    assert sum(c in "KRD" for c in audit) == 1_000_000
