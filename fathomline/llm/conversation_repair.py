"""Repair of conversations by iterative-deepening A*: the cheapest edits that make the roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomline.llm.common import Scratch

#: Rows that one search looks at; longer conversations are searched in blocks whose results compose.
BLOCK = 32
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
# States of the role automaton: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {"user": USER, "assistant": ASSISTANT}
LEGAL = {"su", "ua", "au"}
GOAL = frozenset((START, ASSISTANT))

Row = tuple[str, str]  # role, text


def kept_state(state: int, role: str) -> int | None:
    """The state after a row of this role is kept; None where its initial doesn't fit."""
    initial = role[:1]
    if state == START and initial == "s":
        return SYSTEM
    return AFTER[NEXT_ROLE[state]] if initial == NEXT_ROLE[state][0] else None


def faults(rows: list[Row], repeated: list[bool]) -> list[str]:
    """Each row's first fault: b(lank), d(uplicate), t(runcated) or none."""
    out = []
    for (_, text), again in zip(rows, repeated, strict=True):
        end = text.rstrip(SPACE)[-1:]
        out.append("b" if not end else "d" if again else "" if end in ".!?" else "t")
    return out


def repeats(rows: list[Row]) -> list[bool]:
    seen: set[Row] = set()
    return [row in seen or seen.add(row) is not None for row in rows]


class Search:
    """Depth-first searches in ASCII edit order (D, I, K, R) under a bound that grows by one.

    ``failed`` remembers, for a place and state, the largest remaining budget
    from which the goal was out of reach; that stays true under later bounds,
    so it is kept for all searches towards the same goal. A faulty row costs at
    least its deletion, which gives the lower bound for what is left.
    """

    def __init__(self, rows: list[Row], fault: list[str], goal: frozenset[int]):
        self.rows, self.fault, self.goal = rows, fault, goal
        self.least = [0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            self.least[i] = self.least[i + 1] + (DELETE if fault[i] else 0)
        self.failed: dict[tuple[int, int], int] = {}
        self.path: list[str] = []

    def best(self, state: int) -> tuple[int, str] | None:
        """Cost and edits of the cheapest way, the ASCII-least of several; None without any."""
        for bound in range(self.least[0], DELETE * len(self.rows) + 2 * INSERT + TRUNCATED + 1):
            self.path = []
            if self._reach(0, state, bound):
                return bound, "".join(self.path)
        return None

    def _reach(self, i: int, state: int, left: int) -> bool:
        if i == len(self.rows) and state in self.goal:
            return True
        if self.failed.get((i, state), -1) >= left:
            return False
        for letter, cost, j, after in self._edits(i, state):
            if cost + self.least[j] <= left:
                self.path.append(letter)
                if self._reach(j, after, left - cost):
                    return True
                self.path.pop()
        self.failed[i, state] = left
        return False

    def _edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        here = i < len(self.rows)
        following = AFTER[NEXT_ROLE[state]]
        if here:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, following
        if here and self.fault[i] not in ("b", "d"):
            more = TRUNCATED if self.fault[i] else 0
            after = kept_state(state, self.rows[i][0])
            if after is not None:
                yield "K", more, i + 1, after
            yield "R", REROLE + more, i + 1, following


def apply(rows: list[Row], state: int, audit: str) -> Iterator[Row]:
    """The rows after the edits; rerole and insert give the only role that fits there."""
    i = 0
    for letter in audit:
        role = NEXT_ROLE[state]
        if letter == "D":
            i += 1
            continue
        if letter == "I":
            row = (role, "")
        else:
            row = rows[i] if letter == "K" else (role, rows[i][1])
            i += 1
        state = kept_state(state, row[0])
        yield row


def hashed(rows: Iterable[Row], sha, empty: bool = True) -> bool:
    """Adds ``role:text`` lines to a running hash; whether it is still empty."""
    for role, text in rows:
        sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        empty = False
    return empty


def span(rows: list[tuple], fault: list[str]) -> dict:
    """What a stretch of rows (turn, role, text) says for the counts of its conversation; stretches join."""
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    return {
        "rows": len(rows), "low": min(turns, default=None), "high": max(turns, default=None), "distinct": len(set(turns)),
        "blank": fault.count("b"), "duplicate": fault.count("d"), "truncated": fault.count("t"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "head": initials[0] if rows else None, "tail": initials[-1] if rows else None,
    }


def joined(a: dict, b: dict) -> dict:
    """The stretch a followed by b; turns ascend, so they share one turn at most."""
    if not a["rows"] or not b["rows"]:
        return b if not a["rows"] else a
    shared = a["high"] is not None and a["high"] == b["low"]
    lows, highs = [x["low"] for x in (a, b) if x["low"] is not None], [x["high"] for x in (a, b) if x["high"] is not None]
    sums = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated")}
    return sums | {
        "low": min(lows, default=None), "high": max(highs, default=None), "distinct": a["distinct"] + b["distinct"] - shared,
        "illegal": a["illegal"] + b["illegal"] + (a["tail"] + b["head"] not in LEGAL), "head": a["head"], "tail": b["tail"],
    }


def counts(stretch: dict) -> dict:
    gaps = 0 if stretch["low"] is None else stretch["high"] - stretch["low"] + 1 - stretch["distinct"]
    return {"gaps": gaps} | {k: stretch[k] for k in ("blank", "duplicate", "truncated", "illegal")}


class Tail:
    """Edits from a block to the end: this block's and then those of another tail. Compared letter by letter, built only once."""

    __slots__ = ("after", "cost", "entry", "exit", "piece")

    def __init__(self, cost: int, piece: str, entry: int, exit_: int, after: Tail | None):
        self.cost, self.piece, self.entry, self.exit, self.after = cost, piece, entry, exit_, after

    def chain(self) -> Iterator[Tail]:
        at = self
        while at is not None:
            yield at
            at = at.after

    def letters(self) -> Iterator[str]:
        for t in self.chain():
            yield from t.piece

    def before(self, other: Tail) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        if self.piece == other.piece and self.after is other.after:
            return False
        for a, b in zip(self.letters(), other.letters()):
            if a != b:
                return a < b
        return False


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies``: the rows as a test damages them, by crc32 of ``conv:turn``.

    Of 20 remainders, 0 drops the row (copies 0), 1 empties its text, 2 removes
    ``. ! ?``, 3 repeats it (copies 2), 4 makes its role user. A null counts as
    one space in role, text and the hashed string; turn and identifier stay null.
    """
    space = F.lit(" ")
    case = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % 20
    body = F.coalesce(F.col(text), space)
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.when(case == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(case == 1, F.lit("")).when(case == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def as_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, for ``repair``."""
    space = F.lit(" ")
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), F.lit(1).alias("copies"))


TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FIRST = f"part long, block long, {', '.join(f'{s} long' for s in STATS)}, audit string, sha string, repaired array<struct<role: string, text: string>>, turns array<struct<turn: long, role: string, text: string>>"


def _first_pass(kind: pa.DataType, with_turns: bool):
    """Over sorted rows: conversations that lie whole in a partition and are short are decided; others leave as blocks."""
    schema = pa.schema([("conv", kind), ("part", pa.int64()), ("block", pa.int64()), *[(s, pa.int64()) for s in STATS], ("audit", pa.string()), ("sha", pa.string()), ("repaired", REPAIRED), ("turns", TURNS)])
    nothing = object()

    def decided(conv, rows: list[tuple]) -> dict:
        plain = [(role, text) for _, role, text in rows]
        fault = faults(plain, repeats(plain))
        cost, audit = Search(plain, fault, GOAL).best(START)
        after, sha = list(apply(plain, START, audit)), hashlib.sha256()
        hashed(after, sha)
        shown = [{"role": r, "text": t} for r, t in after] if with_turns else None
        return counts(span(rows, fault)) | {"conv": conv, "cost": cost, "audit": audit, "sha": sha.hexdigest(), "repaired": shown}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, rows, block, open_ = nothing, [], 0, True
        for batch in batches:
            out = []

            def flush() -> None:
                nonlocal rows, block
                out.append({"conv": now, "part": part, "block": block, "turns": [dict(zip(("turn", "role", "text"), r, strict=True)) for r in rows]})
                rows, block = [], block + 1

            for conv, turn, role, text, copies in zip(*[batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "copies")], strict=True):
                if now is nothing:
                    now = conv
                elif conv != now:
                    # The first conversation may have begun in another partition.
                    flush() if open_ else out.append(decided(now, rows))
                    now, rows, open_ = conv, [], False
                for _ in range(copies):
                    if len(rows) == BLOCK:
                        flush()
                        open_ = True
                    rows.append((turn, role, text))
            yield from pa.Table.from_pylist(out, schema).to_batches()
        if now is not nothing:
            out = []
            flush()
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return work


def _block_maps(kind: pa.DataType):
    """For each block the cheapest edits from every state to every state, and its counts."""
    keys = ("rows", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")
    way = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("piece", pa.string())])
    schema = pa.schema([("conv", kind), ("part", pa.int64()), ("block", pa.int64()), ("ways", pa.list_(way)), *[(k, pa.int64()) for k in keys], ("head", pa.string()), ("tail", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = [(t["turn"], t["role"], t["text"]) for t in r["turns"]]
                plain, first = [x[1:] for x in rows], set(r["firsts"] or ())
                fault = faults(plain, [i not in first for i in range(len(rows))])
                ways = []
                for goal in STATES:
                    search = Search(plain, fault, frozenset((goal,)))
                    found = ((entry, search.best(entry)) for entry in STATES)
                    ways += [{"entry": entry, "exit": goal, "cost": way[0], "piece": way[1]} for entry, way in found if way]
                out.append(span(rows, fault) | {"conv": r["conv"], "part": r["part"], "block": r["block"], "ways": ways})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    schema_text = "part long, block long, ways array<struct<entry: int, exit: int, cost: long, piece: string>>, " + ", ".join(f"{k} long" for k in keys) + ", head string, tail string"
    return work, schema_text


def _compose(kind: pa.DataType):
    """Over blocks from last to first: the best way from each state to the end; then one row a block and one a conversation."""
    schema = pa.schema([("conv", kind), ("part", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("piece", pa.string()), *[(s, pa.int64()) for s in STATS], ("audit", pa.string())])

    def finish(conv, tails: dict[int, Tail], stretch: dict, places: list) -> Iterator[dict]:
        best = tails[START]
        for (part, block), t in zip(reversed(places), best.chain()):
            yield {"conv": conv, "part": part, "block": block, "entry": t.entry, "piece": t.piece}
        yield counts(stretch) | {"conv": conv, "cost": best.cost, "audit": "".join(t.piece for t in best.chain())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, tails, stretch, places = None, None, None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if stretch is not None and r["conv"] != conv:
                    out += finish(conv, tails, stretch, places)
                    stretch = None
                if stretch is None:
                    conv, places = r["conv"], []
                    tails, stretch = {s: None for s in GOAL}, span([], [])
                nearer: dict[int, Tail] = {}
                for w in r["ways"]:
                    if w["exit"] in tails:
                        after = tails[w["exit"]]
                        t = Tail(w["cost"] + (after.cost if after else 0), w["piece"], w["entry"], w["exit"], after)
                        if w["entry"] not in nearer or t.before(nearer[w["entry"]]):
                            nearer[w["entry"]] = t
                tails, stretch = nearer, joined(r, stretch)
                places.append((r["part"], r["block"]))
            yield from pa.Table.from_pylist(out, schema).to_batches()
        if stretch is not None:
            yield from pa.Table.from_pylist(list(finish(conv, tails, stretch, places)), schema).to_batches()

    return work, f"part long, block long, entry int, piece string, {', '.join(f'{s} long' for s in STATS)}, audit string"


def _digests(kind: pa.DataType):
    """Over blocks in order: the hash of each conversation's repaired rows, one block at a time."""
    schema = pa.schema([("conv", kind), ("sha", pa.string())])
    nothing = object()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, empty = nothing, None, True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["conv"] != conv or conv is nothing:
                    if conv is not nothing:
                        out.append({"conv": conv, "sha": sha.hexdigest()})
                    conv, sha, empty = r["conv"], hashlib.sha256(), True
                empty = hashed(apply([(t["role"], t["text"]) for t in r["turns"]], r["entry"], r["piece"]), sha, empty)
            yield from pa.Table.from_pylist(out, schema).to_batches()
        if conv is not nothing:
            yield from pa.Table.from_pylist([{"conv": conv, "sha": sha.hexdigest()}], schema).to_batches()

    return work


def _repaired_blocks(kind: pa.DataType):
    schema = pa.schema([("conv", kind), ("part", pa.int64()), ("block", pa.int64()), ("repaired", REPAIRED)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{k: r[k] for k in ("conv", "part", "block")} | {"repaired": [{"role": a, "text": b} for a, b in apply([(t["role"], t["text"]) for t in r["turns"]], r["entry"], r["piece"])]} for r in batch.to_pylist()]
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return work


def repair(rows: DataFrame, conv_col: str = "conv_id", turns: bool = False) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies): ``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows come in the order of turn (nulls first), then role and text, so ties
    have one order. A row's first fault counts: blank, duplicate (role and text
    met before in the conversation), truncated (the last character that is no
    white space is not . ! ?). Keep costs 0, Rerole to user or assistant 1,
    Delete 2 (the only edit of blank and duplicate rows), Insert of an empty
    row 5; a truncated row that stays adds 5. ``audit`` has the initials of the
    cheapest edits that give role initials ``(s?(ua)+)?``, the ASCII-least of
    several; an empty role has no initial and can't be kept. A conversation of
    which no row is left has zeros, an empty audit and the hash of nothing;
    one without identifier is a conversation like others. An empty table gives
    an empty result; other columns don't matter.

    Rows are dealt by ranges of conversation and order. A conversation of at
    most 32 rows that lies in one partition is searched at once. Any other is
    searched in blocks of 32 rows from every state of the role automaton to
    every other, and the blocks' results are composed from the last to the
    first, so a conversation of any length costs as much a row as a short one.
    Only hash and audit of one conversation, which are one value each, are
    written by one task, block by block.

    With ``turns`` the repaired rows themselves come instead: ``conv_col, k,
    role, text``, ``k`` ascending inside a conversation, not gapless.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    kind, arrow = rows.schema["conv"].dataType.simpleString(), to_arrow_type(rows.schema["conv"].dataType)
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]
    ranged = rows.select("conv", "turn", "role", "text", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    first = scratch.table(ranged.mapInArrow(_first_pass(arrow, turns), f"conv {kind}, {FIRST}"))
    blocks = first.filter("part is not null").select("conv", "part", "block", "turns")

    # A row of a block is no duplicate if it is the first of its role and text in its conversation.
    each = blocks.select("conv", "part", "block", F.posexplode("turns").alias("at", "row"))
    same = F.sha2(F.concat(F.octet_length("row.role").cast("string"), F.lit(":"), F.col("row.role"), F.col("row.text")), 256)
    least = each.groupBy("conv", same.alias("same")).agg(F.min(F.struct("part", "block", "at")).alias("first"))
    firsts = least.groupBy(F.col("first.part").alias("part"), F.col("first.block").alias("block")).agg(F.collect_list("first.at").alias("firsts"))
    work, schema = _block_maps(arrow)
    maps = blocks.join(firsts, ["part", "block"], "left").mapInArrow(work, f"conv {kind}, {schema}")
    work, schema = _compose(arrow)
    composed = scratch.table(maps.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block")).mapInArrow(work, f"conv {kind}, {schema}"))
    ways = blocks.join(composed.filter("part is not null").select("part", "block", "entry", "piece"), ["part", "block"]).select("conv", "part", "block", "turns", "entry", "piece")
    whole = first.filter("part is null")
    if turns:
        rest = ways.mapInArrow(_repaired_blocks(arrow), f"conv {kind}, part long, block long, repaired array<struct<role: string, text: string>>")
        out = whole.select("conv", F.lit(0).alias("part"), F.lit(0).alias("block"), "repaired").unionByName(rest)
        return out.select("conv", "part", "block", F.posexplode("repaired").alias("at", "row")).select(F.col("conv").alias(conv_col), F.struct("part", "block", "at").alias("k"), "row.role", "row.text")
    shas = ways.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(_digests(arrow), f"conv {kind}, sha string")
    ends = composed.filter("part is null").drop("part", "block", "entry", "piece")
    named = shas.select(F.col("conv").alias("of"), "sha")
    long_ones = ends.join(named, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    columns = ["conv", *STATS, "audit", "sha"]
    return whole.select(columns).unionByName(long_ones.select(columns)).select(F.col("conv").alias(conv_col), *STATS[:5], "cost", "audit", F.col("sha").alias("repaired_sha256"))
