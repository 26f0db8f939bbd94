"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from driftgate.llm import repair
from driftgate.llm.queries import all_queries
from driftgate.session import WorkArea

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CONV = "conv_id bigint, turn bigint, role string, text string"
WORD, NAMES = r"[^\x20\x09-\x0D]", {"u": "user", "a": "assistant"}


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        talk = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        talk += [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    return {c: [(t if known else None, r, x) for known, t, r, x in sorted(talk)] for c, talk in out.items()}


def faults(talk):
    seen, out = set(), []
    for _, role, text in talk:
        words = re.findall(WORD, text)
        out.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def legal(state, initial):
    """Role initials so far end in ``state``: nothing, s, u or a."""
    if state == "":
        return initial in ("s", "u")
    return initial == {"s": "u", "u": "a", "a": "u"}[state]


def cheapest(talk):
    """Least (cost, audit, repaired turns), from the end; two insertions in a row are tried as well."""
    marks = faults(talk)

    @cache
    def rest(i, state, inserted):
        found = []
        if i == len(talk) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 2:
            for x in "ua":
                if legal(state, x):
                    cost, audit, turns = rest(i, x, inserted + 1)
                    found.append((cost + 2, "I" + audit, ((NAMES[x], ""), *turns)))
        if i < len(talk):
            _, role, text = talk[i]
            cost, audit, turns = rest(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, turns))
            if marks[i] in "t-":
                more = marks[i] == "t"
                options = [("K", 0, role, role[:1])] + [("R", 2, NAMES[x], x) for x in "ua"]
                for letter, price, name, initial in options:
                    if initial and legal(state, initial):
                        cost, audit, turns = rest(i + 1, initial, 0)
                        found.append((cost + price + more, letter + audit, ((name, text), *turns)))
        return min(found) if found else (10**9, "", ())

    return rest(0, "", 0)


def plain(rows):
    out = {}
    for conv, talk in damaged(rows).items():
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        marks, roles = faults(talk), [r[:1] for _, r, _ in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, repaired = cheapest(talk)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, sha)
    return out


def reported(spark, df, **limits):
    out = repair.report_all(df, repair.repair(repair.damage(df), WorkArea(spark, "t"), **limits)).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def rows_of(seed, talks, most, odd=True):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant"] + ["tool", "", None, "u", "as"] * odd
    texts = ["Hi.", "What?", "no end", "", " \t", "Yes!", "a b. ", None, "Hi.\n", "done"]
    out = []
    for conv in range(talks):
        for turn in range(rng.randrange(1, most)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}."
            out.append((conv or None, None if rng.random() < 0.1 else turn - rng.randrange(2), rng.choice(roles), text))
    return out


def test_random_conversations(spark):
    rows = rows_of(1, 300, 9)
    got = reported(spark, spark.createDataFrame(rows, CONV).repartition(5))
    assert got == plain(rows)


@pytest.mark.parametrize("chunk, fan", [(3, 2), (7, 4), (repair.CHUNK_ROWS, repair.FAN)])
def test_long_conversations(spark, apart, chunk, fan):
    """Many chunks, partitions and levels of the tree."""
    rows = rows_of(2, 12, 90, odd=False) + [(7, t, "user", "Hi.") for t in range(200, 400)] + [(8, 5, "user", "Same.")] * 150
    got = reported(spark, spark.createDataFrame(rows, CONV).repartition(6), chunk_rows=chunk, fan=fan)
    assert got == plain(rows)


def test_weights_follow_cost_and_audit():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 9)
        marks = "".join(rng.choice("suax") + rng.choice("bdt--") for _ in range(n))
        whole = repair._path(marks, 0)
        for cut in range(0, n + 1):
            parts = [(cut, repair.effect(marks[: 2 * cut])), (n - cut, repair.effect(marks[2 * cut :]))]
            assert repair.compose(parts, 0)[0] == whole


def test_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Who?"), (1, 2, "assistant", "Me."), (2, 0, "system", "Be."), (3, 0, "tool", "x.")]
    repaired = repair.repair(spark.createDataFrame(rows, CONV), WorkArea(spark, "t"))
    got = {}
    for r in sorted(repair.turns_of(repaired).collect(), key=lambda r: (r.conv_id, r.seg, r.no, r.place)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "Hi."), ("assistant", ""), ("user", "Who?"), ("assistant", "Me.")]}
    assert {r.conv_id: (r.audit, r.cost) for r in repaired.collect()} == {1: ("KIKK", 2), 2: ("D", 3), 3: ("D", 3)}


def test_one_conversation_with_a_third_of_all_rows(spark, apart):
    """No chunk holds more than its limit, whatever the conversation's size, and several tasks share it."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Text {t}.") for t in range(4_000)] + rows_of(6, 900, 12)
    repaired = repair.repair(spark.createDataFrame(rows, CONV), WorkArea(spark, "t"))
    chunks = repaired.filter("conv_id = 1").collect()
    assert len(chunks) >= 4_000 // repair.CHUNK_ROWS and max(len(r.marks) // 2 for r in chunks) <= repair.CHUNK_ROWS
    assert len({r.seg for r in chunks}) > 1


def test_cases(spark):
    df = spark.createDataFrame([], CONV)
    assert reported(spark, df) == {}
    rows = [(None, None, None, None), (5, None, "user", "Long " * 300_000 + "."), (5, 3, "assistant", "Ok."), (5, 3, "assistant", "Ok.")]
    wide = spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], f"{CONV}, copies int, marks string, seg int, audit string, m int")
    assert reported(spark, wide) == plain(rows)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_query_on_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in all_queries()["op11_conversation_repair"](spark, folder).collect()}
    assert got == plain(rows)
