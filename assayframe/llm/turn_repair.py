"""Cheapest repair of a conversation's structure by depth-first branch-and-bound.

A repaired conversation is empty, or one optional system turn and then user and
assistant turns in alternation, the assistant last.  Turns can be kept, given
another role, deleted or inserted; blank and repeated turns must go.  Wanted are
the cheapest edits and, among equals, the least string of their initials.

The search keeps an explicit stack of edit prefixes.  A branch ends where its
cost and the lower bound of the remaining turns exceed the incumbent (cost,
audit), or where the table of its node (turn, state) holds a prefix at least as
good: cheaper, or as cheap with a smaller audit.  The bounds come from a relaxed
problem in which a system turn may be all of a conversation.

Rows are sorted by ranges of (conversation, turn), so a conversation with a third
of all rows lies in many tasks.  One that fits a block is repaired where it lies.
The others are cut into blocks, each is searched between every pair of states,
and the blocks are joined by their costs and by the ranks of their audits, which
takes a few numbers a block; the texts are then hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.batches import texts_of
from assayframe.sources.storage import write_shared

# States: nothing yet, after the system turn, after a user turn, after an assistant turn; ``FINAL`` is the goal of a whole conversation.
START, SYSTEM, USER, ASSISTANT, FINAL = range(5)
STATES = (START, SYSTEM, USER, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: b"user", ASSISTANT: b"assistant"}
# Costs of another role, of deleting and of inserting, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# A turn for the search is one byte: its role in the low bits, then what is wrong with it.
OTHER = 0
IS_TRUNCATED, MUST_GO = 8, 16
# Turns and bytes of text of a block, and solved sequences a task remembers.
BLOCK_TURNS, BLOCK_BYTES, REMEMBERED = 2048, 8 << 20, 50_000
LEGAL_PAIRS = {b"su", b"ua", b"au"}


def lower_bounds(turns: bytes, goal: int) -> list[tuple[float, ...]]:
    """Per position and state a lower bound of the cost of the rest; in the relaxed problem a system turn may be all of a conversation."""
    infinite = float("inf")
    start, system, user, assistant = (0, 0, INSERT, 0) if goal == FINAL else tuple(0 if state == goal else infinite for state in STATES)
    bounds = [(start, system, user, assistant)]
    for turn in reversed(turns):
        role, extra = turn & 7, TRUNCATED if turn & IS_TRUNCATED else 0
        options = [start + DELETE, system + DELETE, user + DELETE, assistant + DELETE]
        if not turn & MUST_GO:
            to_user, to_assistant = user + extra + (role != USER) * REROLE, assistant + extra + (role != ASSISTANT) * REROLE
            options = [min(options[START], to_user, system + extra if role == SYSTEM else infinite), *(min(a, b) for a, b in zip(options[1:], (to_user, to_assistant, to_user), strict=True))]
        # An inserted user turn leads on from all states but its own, an inserted assistant turn from there.
        user = min(options[USER], min(options[ASSISTANT], options[USER] + INSERT) + INSERT)
        assistant = min(options[ASSISTANT], user + INSERT)
        start, system = min(options[START], user + INSERT), min(options[SYSTEM], user + INSERT)
        bounds.append((start, system, user, assistant))
    return bounds[::-1]


def search(turns: bytes, entry: int = START, goal: int = FINAL) -> tuple[int, str] | None:
    """The least (cost, audit) from ``entry`` to ``goal``, or None where there is no way.

    Towards ``FINAL`` turns may also be inserted after the last one; towards a
    state the last edit is that of the last turn.
    """
    bounds, length = lower_bounds(turns, goal), len(turns)
    # The tree of prefixes: parent, last edit and depth of each.
    parents, letters, depths = [-1], [""], [0]
    best_cost: float = float("inf")
    best_path: list[int] = []
    table: dict[int, tuple[int, int]] = {}  # per node (turn, state) the best prefix so far

    def less(one: int, other: int) -> bool:
        """Whether prefix ``one`` comes before ``other``: the first edit in which they differ decides."""
        one_first = depths[one] <= depths[other]
        while depths[one] > depths[other]:
            one = parents[one]
        while depths[other] > depths[one]:
            other = parents[other]
        while one != other:
            last_one, last_other = one, other
            one, other = parents[one], parents[other]
            one_first = letters[last_one] < letters[last_other]
        return one_first

    def beats_incumbent(prefix: int) -> bool:
        return not best_path or less(prefix, best_path[min(depths[prefix], len(best_path) - 1)])

    stack = [(0, 0, entry, 0)]  # prefix, turn, state, cost
    while stack:
        prefix, at, state, cost = stack.pop()
        bound = cost + bounds[at][state]
        if bound > best_cost or (bound == best_cost and not beats_incumbent(prefix)):
            continue
        node = at * 4 + state
        held = table.get(node)
        if held is not None and (held[0] < cost or (held[0] == cost and not less(prefix, held[1]))):
            continue
        table[node] = (cost, prefix)
        if at == length and (state == goal or (goal == FINAL and state in (START, ASSISTANT))):
            best_cost, best_path = cost, []
            while prefix >= 0:
                best_path.append(prefix)
                prefix = parents[prefix]
            best_path.reverse()
            continue
        following = NEXT[state]
        steps = []
        if at < length or goal == FINAL:
            steps.append(("I", at, following, cost + INSERT))
        if at < length:
            turn = turns[at]
            steps.append(("D", at + 1, state, cost + DELETE))
            if not turn & MUST_GO:
                role, extra = turn & 7, TRUNCATED if turn & IS_TRUNCATED else 0
                if role == following or (role == SYSTEM and state == START):
                    steps.append(("K", at + 1, role, cost + extra))
                steps.append(("R", at + 1, following, cost + REROLE + extra))
        ordered = sorted(((total + bounds[to][next_state], letter, to, next_state, total) for letter, to, next_state, total in steps), reverse=True)
        for promise, letter, to, next_state, total in ordered:  # the most promising on top of the stack
            if promise <= best_cost and promise != float("inf"):
                parents.append(prefix)
                letters.append(letter)
                depths.append(depths[prefix] + 1)
                stack.append((len(parents) - 1, to, next_state, total))
    return None if not best_path else (int(best_cost), "".join(letters[prefix] for prefix in best_path))


search_whole = lru_cache(maxsize=REMEMBERED)(search)


def block_table(turns: bytes, last: bool) -> list[int]:
    """Costs and audit ranks from each state to each goal of a block: -1 where there is no way; ranks compare audits of one entry state."""
    goals = (FINAL,) if last else STATES
    costs, ranks = [], []
    for entry in STATES:
        found = [search(turns, entry, goal) for goal in goals]
        audits = sorted(result[1] for result in found if result)
        costs += [result[0] if result else -1 for result in found]
        ranks += [audits.index(result[1]) if result else -1 for result in found]
    return costs + ranks


def join_blocks(tables: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of the best way through all blocks, and its (entry state, goal) in each.

    Two different prefixes over the same turns differ in some edit, so the order
    of their audits does not depend on what follows: ranks decide ties.
    """
    reached: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost, rank of its audit
    came_from: list[dict[int, int]] = []
    for number, table in enumerate(tables):
        goals = (FINAL,) if number == len(tables) - 1 else STATES
        half = len(table) // 2
        options: dict[int, tuple[int, int, int, int]] = {}
        for entry, (cost, rank) in reached.items():
            for place, goal in enumerate(goals):
                step = table[entry * len(goals) + place]
                if step >= 0:
                    option = (cost + step, rank, table[half + entry * len(goals) + place], entry)
                    options[goal] = min(options.get(goal, option), option)
        order = sorted({option[1:3] for option in options.values()})
        reached = {goal: (option[0], order.index(option[1:3])) for goal, option in options.items()}
        came_from.append({goal: option[3] for goal, option in options.items()})
    ways, goal = [], FINAL
    for sources in reversed(came_from):
        ways.append((sources[goal], goal))
        goal = sources[goal]
    return reached[FINAL][0], ways[::-1]


def repaired_lines(audit: str, entry: int, roles: list[bytes], texts: list[bytes]) -> Iterator[bytes]:
    """The ``role:text`` lines that the edits leave."""
    state, at = entry, 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            state = NEXT[state]
            yield ROLE_OF[state] + b":"
            continue
        if edit == "K":
            state = SYSTEM if roles[at][:1] == b"s" else NEXT[state]
            yield roles[at] + b":" + texts[at]
        else:
            state = NEXT[state]
            yield ROLE_OF[state] + b":" + texts[at]
        at += 1


def damaged(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, live) after the planned damage; a dropped row stays with ``live`` false, so that its conversation is known."""
    some = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    fate = (F.crc32(name.cast("binary")) % 20).cast("int")
    rows = some.withColumn("fate", fate).withColumn("live", F.col("fate") != 0)
    return rows.select(
        "conv_id", "turn", "live",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def coded(rows: DataFrame) -> DataFrame:
    """Adds ``seen``, the number of the row among equals of its conversation, and ``fault``: blank, duplicate, truncated or none (1, 2, 3, 0)."""
    equals = Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(F.col("seen") > 1, 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3)
    return rows.withColumn("seen", F.row_number().over(equals)).withColumn("fault", fault.otherwise(0))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
BLOCK = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("whole", pa.bool_())]
    + [(name, pa.int64()) for name in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    + [("least_turn", pa.int64()), ("most_turn", pa.int64()), ("turns", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]
    + [("codes", pa.binary()), ("roles", pa.list_(pa.binary())), ("texts", pa.list_(pa.binary()))]
)
BLOCK_SPEC = (
    "conv_id long, part int, number int, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, least_turn long, most_turn long, turns long, first binary, last binary, codes binary, roles array<binary>, texts array<binary>"
)
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def code_of(initial: bytes, fault: int) -> int:
    role = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}.get(initial, OTHER)
    return role | (MUST_GO if fault in (1, 2) else IS_TRUNCATED if fault == 3 else 0)


class Held:
    """The rows of the current conversation, or of its current block."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.size = conv_id, 0
        self.turns: list[int | None] = []
        self.roles: list[bytes] = []
        self.texts: list[bytes] = []
        self.faults: list[int] = []

    def add(self, turn, role, text, fault) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.size += len(role) + len(text)

    def row(self, part: int, number: int, whole: bool) -> dict:
        """What is known of these rows; a whole conversation is repaired, a block keeps its rows for later."""
        initials = [role[:1] for role in self.roles]
        turns = [turn for turn in self.turns if turn is not None]
        known = {
            "conv_id": self.conv_id, "part": part, "number": number, "whole": whole, "blank": self.faults.count(1), "duplicate": self.faults.count(2),
            "truncated": self.faults.count(3), "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False)),
            "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "turns": len(set(turns)),
        }
        codes = bytes(map(code_of, initials, self.faults))
        if not whole:
            first, last = (initials[0], initials[-1]) if initials else (None, None)
            return known | {"first": first, "last": last, "codes": codes, "roles": self.roles, "texts": self.texts}
        cost, audit = search_whole(codes)
        digest = hashlib.sha256(b"\n".join(repaired_lines(audit, START, self.roles, self.texts))).hexdigest()
        gaps = min(known["most_turn"] - known["least_turn"] + 1 - known["turns"], 2**63 - 1) if turns else 0
        return known | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest}


def blocks_of(rows: DataFrame, block_turns: int) -> DataFrame:
    """Whole conversations, repaired, and the blocks of those that are long or lie at the edge of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ready = TaskContext.get().partitionId(), 0, []
        held, cut = None, True  # the first conversation may have begun in the task before

        def put() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(ready, schema=BLOCK)
            ready.clear()
            return batch

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "turn", "live")]
            columns += [texts_of(batch.column(name)) for name in ("role", "text")] + [batch.column("fault").to_pylist()]
            for conv_id, turn, live, role, text, fault in zip(*columns, strict=True):
                if held is not None and conv_id != held.conv_id:
                    ready.append(held.row(part, number, not cut))
                    held, cut, number = None, False, number + 1
                elif held is not None and held.turns and (len(held.turns) >= block_turns or held.size >= BLOCK_BYTES):
                    ready.append(held.row(part, number, False))
                    held, cut, number = None, True, number + 1
                if held is None:
                    held = Held(conv_id)
                if live:
                    held.add(turn, role, text, fault)
                if len(ready) >= 500 or (ready and not ready[-1]["whole"]):
                    yield put()
        if held is not None:  # may go on in the next task
            ready.append(held.row(part, number, False))
        if ready:
            yield put()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranges.select("conv_id", "turn", "live", "role", "text", "fault").mapInArrow(run, BLOCK_SPEC)


def joined(blocks: DataFrame) -> DataFrame:
    """Repairs the conversations that lie in blocks."""
    spark = blocks.sparkSession
    in_order = Window.partitionBy("conv_id").orderBy("part", "number")
    ends = blocks.select("conv_id", "part", "number").withColumn("final", F.lead("number").over(in_order).isNull()).drop("conv_id")
    cut = blocks.join(ends, ["part", "number"])

    @F.pandas_udf("array<long>")
    def table_of(codes: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([block_table(bytes(some), bool(end)) for some, end in zip(codes, last, strict=True)])

    small = ["conv_id", "part", "number", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last"]
    # Turns travel as text: pandas would make missing numbers NaN and round the others.
    ends_of_turns = [F.col(name).cast("string").alias(name) for name in ("least_turn", "most_turn")]
    tables = cut.select(*small, *ends_of_turns, table_of("codes", "final").alias("table"))
    joint = "part int, number int, entry int, goal int, head boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "number"])
        cost, ways = join_blocks([list(map(int, table)) for table in group["table"]])
        illegal, turns, least, most, before = int(group["illegal"].sum()), 0, None, None, None
        for first, last, low, high, count in zip(group["first"], group["last"], group["least_turn"], group["most_turn"], group["turns"], strict=True):
            if first is not None:
                illegal += before is not None and bytes(before) + bytes(first) not in LEGAL_PAIRS
                before = last
            if count:  # turns ascend, so two blocks share one turn at most
                turns += int(count) - (most is not None and int(low) == most)
                least, most = int(low) if least is None else least, int(high)
        gaps = min(most - least + 1 - turns, 2**63 - 1) if turns else 0
        out = group[["part", "number"]].copy()
        out["entry"], out["goal"] = zip(*ways, strict=True)
        out["head"] = np.arange(len(out)) == 0
        out["gaps"], out["illegal"], out["cost"] = gaps, illegal, cost
        for name in ("blank", "duplicate", "truncated"):
            out[name] = int(group[name].sum())
        return out[[field.split()[0] for field in joint.split(", ")]]

    ways = write_shared(tables.groupBy("conv_id").applyInPandas(stitch, joint), "repair-ways")
    texts = blocks.select("conv_id", "part", "number", "codes", "roles", "texts").join(ways, ["part", "number"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(field.name, field.type) for field in BLOCK if field.name in ("conv_id", *COUNTS, "audit", "repaired_sha256")])
        known: dict | None = None
        audit: list[str] = []
        digest, started = hashlib.sha256(), False

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([known | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=schema)

        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                if row["head"]:
                    if known is not None:
                        yield put()
                    known = {name: row[name] for name in ("conv_id", *COUNTS)}
                    audit, digest, started = [], hashlib.sha256(), False
                _, edits = search(row["codes"], row["entry"], row["goal"])
                audit.append(edits)
                for line in repaired_lines(edits, row["entry"], row["roles"], row["texts"]):
                    digest.update(b"\n" + line if started else line)
                    started = True
        if known is not None:
            yield put()

    streams = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return streams.mapInArrow(finish, RESULT)


def repair(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Faults and cheapest repair per conversation of (conv_id, turn, role, text, live); rows that are not ``live`` only name their conversation."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    blocks = write_shared(blocks_of(coded(rows), block_turns), "repair-blocks")
    return blocks.where("whole").select(*names).unionByName(joined(blocks.where("NOT whole")).select(*names))


def repair_damaged(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after the planned damage.

    A missing value counts as one blank in roles, texts and the names that decide
    about damage; rows without a turn come first, and rows without a conversation
    are one.  Rows of one turn are taken by role and text, so repeated rows are
    adjacent.  A role without a first letter has no place in a repaired
    conversation.  A conversation of which nothing is left has zeros, an empty
    audit and the digest of nothing; an empty table gives no rows.
    """
    typed = conversations.withColumn(conv_id, F.col(conv_id).cast("long"))
    return repair(damaged(typed, conv_id, turn, role, text), block_turns)


def repair_sql() -> str:
    """The same over ``conversations``: turn by turn, the least (cost, audit) per state, each kept as one text that sorts like the pair."""

    def edited(state: str, cost: str, letter: str, line: str = "''") -> str:
        key = f"lpad(CAST(CAST({state}.k[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {state}.k[10:] || '{letter}'"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'k': {key}, 't': {state}.t || {line}}} END"

    def least(*options: str) -> str:
        return f"list_aggregate(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL), 'min')"

    inserted_user = "chr(10) || 'user:'"
    inserted_assistant = "chr(10) || 'assistant:'"
    kept, rerole_user, rerole_assistant = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    before_user = least("s2", *(edited(state, str(INSERT), "I", inserted_user) for state in ("s0", "s1", "s3")))
    before_assistant = least("s3", edited("b2", str(INSERT), "I", inserted_assistant))

    def stays(letter: str, option: str) -> str:
        return f"CASE WHEN NOT must_go AND initial = '{letter}' THEN {option} END"

    def free(option: str) -> str:
        return f"CASE WHEN NOT must_go THEN {option} END"

    deleted = [edited(state, str(DELETE), "D") for state in ("s0", "s1", "b2", "b3")]
    to_user = [x for state in ("s0", "s1", "b3") for x in (stays("u", edited(state, "extra", "K", kept)), free(edited(state, f"{REROLE} + extra", "R", rerole_user)))]
    to_assistant = [stays("a", edited("b2", "extra", "K", kept)), free(edited("b2", f"{REROLE} + extra", "R", rerole_assistant))]
    return f"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
fated AS (
    SELECT n.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM named n, steps),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM fated, range(2) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
rows AS (
    SELECT *, role[1:1] AS initial, bare = '' AS blank, bare <> '' AND copy > 1 AS duplicate, bare <> '' AND copy = 1 AND bare[-1:] NOT IN ('.', '!', '?') AS truncated,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM seen),
turns AS (
    SELECT *, blank OR duplicate AS must_go, CAST(truncated AS INTEGER) AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
           count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM turns GROUP BY conv_id),
ways AS (
    SELECT conv_id, n, CAST(0 AS BIGINT) AS i, {{'k': '000000000', 't': ''}} AS s0, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s1,
           CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s2, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s3 FROM counts
    UNION ALL
    SELECT conv_id, n, i, {deleted[0]}, {least(deleted[1], stays("s", edited("s0", "extra", "K", kept)))}, {least(deleted[2], *to_user)}, {least(deleted[3], *to_assistant)}
    FROM (SELECT *, {before_assistant} AS b3 FROM (
        SELECT w.conv_id, w.n, r.i, w.s0, w.s1, w.s3, r.role, r.text, r.initial, r.must_go, r.extra, {before_user} AS b2
        FROM ways w JOIN turns r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
ends AS (SELECT *, {before_assistant} AS b3 FROM (SELECT *, {before_user} AS b2 FROM ways WHERE i = n)),
best AS (SELECT conv_id, {least("s0", "b3")} AS found FROM ends)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(found.k[1:9], '0') AS BIGINT) AS cost, coalesce(found.k[10:], '') AS audit, sha256(coalesce(found.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
