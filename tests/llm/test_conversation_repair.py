"""Conversation repair against a table filled from the end, on the given rows and on odd ones in many blocks."""

import hashlib
import random
import zlib

import pytest

from fathomline.llm.conversation_repair import ASSISTANT, GOAL, START, STATES, USER, Search, apply, as_rows, damaged, faults, repair, repeats

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
NEVER = (10**9, "~", ())


def brute(rows):
    """{conv: contract's columns after the identifier} of rows (conv, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        if case == 2:
            text = "".join(c for c in text if c not in ".!?")
        group += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return {conv: mend(sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, g in groups.items()}


def mend(rows):
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    fault, seen = [], set()
    for _, role, text in rows:
        end = text.strip(WHITE)
        fault.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def inserted(best):
        for _ in range(4):
            for q, role in NEXT.items():
                cost, audit, out = best[role]
                best[q] = min(best[q], (cost + 5, "I" + audit, ((NAMES[role], ""), *out)), key=lambda x: x[:2])
        return best

    best = inserted({q: (0, "", ()) if q in ("", "a") else NEVER for q in NEXT})
    for (_, role, text), bad in zip(reversed(rows), reversed(fault)):
        here = {}
        for q in NEXT:
            ways = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            more = 5 if bad == "t" else 0
            if bad not in ("b", "d"):
                if role[:1] == NEXT[q] or (q == "" and role[:1] == "s"):
                    cost, audit, out = best[role[0]]
                    ways.append((cost + more, "K" + audit, ((role, text), *out)))
                cost, audit, out = best[NEXT[q]]
                ways.append((cost + more + 1, "R" + audit, ((NAMES[NEXT[q]], text), *out)))
            here[q] = min(ways, key=lambda x: x[:2])
        best = inserted(here)
    cost, audit, out = best[""]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(fault.count(k) for k in "bdt"), illegal, cost, audit, sha


def odd_rows(seed, conversations=120):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for t in range(rng.choice([1, 2, 5, 40, 130])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"])
            rows.append((None if conv == 7 else conv, rng.choice([t, t, t, None, t // 2]), role, rng.choice(["a.", "b", "", "c!", " \t", None, f"x{rng.random()}."])))
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = repair(damaged(df)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(map(tuple, df.collect())) and len(got) == df.select("conv_id").distinct().count()


def test_odd_and_long_conversations(spark):
    """Nulls anywhere, unknown and empty roles, ties, repeats, conversations that cross blocks and partitions."""
    rows = odd_rows(5)
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    want = brute(rows)
    got = repair(damaged(df)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    lines = {}
    for r in repair(damaged(df), turns=True).orderBy("conv_id", "k").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())


def test_one_conversation_over_all_partitions(spark):
    """A hot conversation, of which every partition holds a part, with a row that a third of all repeat."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["same.", f"x{t}.", f"y{t}"])) for t in range(700)] + [(c, 0, "user", "hello.") for c in range(2, 30)]
    got = repair(damaged(spark.createDataFrame(rows, COLUMNS).repartition(9))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows)


def test_empty_and_clashing(spark):
    rows = odd_rows(9, 20)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS + ", conv string, copies int, part int")
    assert {r[0]: tuple(r[1:]) for r in repair(damaged(df)).collect()} == brute(rows)
    empty = repair(damaged(df.filter("conv_id < 0")))
    assert empty.collect() == [] and empty.columns[0] == "conv_id"


def test_undamaged(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Well."), (3, 0, "user", "")]
    got = {r.conv_id: (r.cost, r.audit) for r in repair(as_rows(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert got == {1: (2, "KDK"), 2: (2, "D"), 3: (2, "D")}


@pytest.mark.parametrize("seed", range(4))
def test_search_between_all_states(seed):
    """Every way from state to state is the cheapest: no sequence of edits up to one insert a gap does better."""
    rng = random.Random(seed)
    for _ in range(25):
        rows = [(rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", "", "a."])) for _ in range(rng.randint(0, 4))]
        fault = faults(rows, repeats(rows))
        ways = {}

        def walk(i, state, cost, audit, entry, inserts):
            if i == len(rows):
                key = (entry, state)
                ways[key] = min(ways.get(key, (99, "")), (cost, audit))
            if i < len(rows):
                walk(i + 1, state, cost + 2, audit + "D", entry, 0)
                if fault[i] not in ("b", "d"):
                    more = 5 if fault[i] == "t" else 0
                    role, due = rows[i][0], {START: USER, 1: USER, USER: ASSISTANT, ASSISTANT: USER}[state]
                    kind = {"user": USER, "assistant": ASSISTANT, "system": 1}[role]
                    if kind == due or (kind == 1 and state == START):
                        walk(i + 1, kind, cost + more, audit + "K", entry, 0)
                    walk(i + 1, due, cost + more + 1, audit + "R", entry, 0)
            if inserts < 2:
                walk(i, {START: USER, 1: USER, USER: ASSISTANT, ASSISTANT: USER}[state], cost + 5, audit + "I", entry, inserts + 1)

        for entry in STATES:
            walk(0, entry, 0, "", entry, 0)
        for goal in STATES:
            search = Search(rows, fault, frozenset((goal,)))
            for entry in STATES:
                assert search.best(entry) == ways.get((entry, goal)), (rows, entry, goal)
        cost, audit = Search(rows, fault, GOAL).best(START)
        assert (cost, audit) == min(ways[k] for k in ((START, START), (START, ASSISTANT)) if k in ways)
        out = list(apply(rows, START, audit))
        assert "".join(r[0][0] for r in out).lstrip("s").replace("ua", "") == ""
