"""Repair of damaged conversations by branch-and-bound (operator 13).

The repaired roles of a conversation are nothing, or an optional system turn and then user and assistant turns by pairs.
Every row is kept, given the role that comes next, or deleted, and empty turns may be inserted anywhere; the cheapest
edits count, ties by the ASCII-least list of their initials.

A search node is (row, state), the state being what the last turn was.  Depth-first with an explicit stack, the most
promising child on top; a node is dropped if its cost and the suffix's lower bound exceed the incumbent's cost, or if
its (cost, audit) is no better than what the node's entry of the dominance table has.  Equally dear audits of one node
are never a prefix of each other (each insertion costs), so the order of prefixes is that of whole audits.

Conversations stream through a task by blocks of BLOCK rows: a block's search starts from the best prefixes that end in
each state and yields the best ones at its end, each with its running digest.  A conversation of any length thus needs
memory for one block of its texts, its audit, and 16 bytes for each distinct row (to know copies).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BLOCK_BYTES = 32, 8 << 20  # rows, and characters, that close a block
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last turn was
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of an inserted or re-roled turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # insertions that end a conversation
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string, edit string"


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of a conversation table after the damage that crc32(`conv:turn`) % 20 deals; nulls are one space.

    Columns: conv, turn (of their types), role, text, gone.  Rows of a conversation that were dropped stay as markers
    (gone), so that no conversation is lost."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"),
                     code.alias("code"))
    what = F.col("code")
    return rows.select(
        "conv", "turn", F.when(what == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(what <= 1, F.lit("")).when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (what == 0).alias("gone"), F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def weights(initials: list[str], forced: list[bool], cut: list[bool]) -> list[int]:
    """Lower bound of what rows i.. cost, for each i.

    A forced deletion costs 3, an undeleted truncated row 1, a row of an unknown role 2 more (or 3 as a deletion).  Two
    neighbours, deletions apart, that cannot stand together need an edit at one of them or between them; an edit costs
    2 at least and settles two such places at most, so each of them counts 1."""
    out, behind = [0], ""
    for initial, must, short in zip(reversed(initials), reversed(forced), reversed(cut)):
        cost = out[-1]
        if must:
            cost += DELETE
        elif initial not in ("s", "u", "a"):
            cost += min(DELETE, REROLE + CUT_OFF * short)
            behind = ""
        else:
            cost += CUT_OFF * short + (behind != "" and initial + behind not in ("su", "ua", "au"))
            behind = initial
        out.append(cost)
    return out[::-1]


def search(initials: list[str], forced: list[bool], cut: list[bool], entry: dict[int, tuple[int, str]], last: bool
           ) -> dict[int, tuple[int, str, int, str]]:
    """Best ways through a block: end state -> (cost, audit, entry state, audit within the block).

    `entry`: the best (cost, audit) that ends before the block in each state.  In the `last` block the closing
    insertions are added and only the cheapest way over all states is kept."""
    n, bound = len(initials), weights(initials, forced, cut)
    table: dict[tuple[int, int], tuple[int, str]] = {}
    best: dict[int, tuple[int, str, int, str]] = {}
    stack = [(cost, audit, 0, state, state, len(audit)) for state, (cost, audit) in entry.items()]
    stack.sort(key=lambda x: (x[0], x[1]), reverse=True)
    for cost, audit, i, state, _, _ in stack:
        table[i, state] = (cost, audit)
    while stack:
        cost, audit, i, state, came, skip = stack.pop()
        if table[i, state] < (cost, audit):
            continue  # a better prefix has reached this node meanwhile
        if i == n:
            if last:
                whole = (cost + INSERT * len(CLOSING[state]), audit + CLOSING[state])
                if START not in best or whole < best[START][:2]:
                    best[START] = (*whole, came, whole[1][skip:])
                continue
            if state not in best or (cost, audit) < best[state][:2]:
                best[state] = (cost, audit, came, audit[skip:])
        limit = best[START][0] if last and best else max(b[0] for b in best.values()) if len(best) == 4 else None
        children = [(cost + INSERT, audit + "I", i, DUE[state])]
        if i < n:
            children.append((cost + DELETE, audit + "D", i + 1, state))
            if not forced[i]:
                extra = cost + CUT_OFF * cut[i]
                to = NEXT[state].get(initials[i])
                if to is not None:
                    children.append((extra, audit + "K", i + 1, to))
                if to != DUE[state]:
                    children.append((extra + REROLE, audit + "R", i + 1, DUE[state]))
        children = [c for c in children if (limit is None or c[0] + bound[c[2]] <= limit)
                    and ((c[2], c[3]) not in table or c[:2] < table[c[2], c[3]])]
        children.sort(key=lambda c: (c[0] + bound[c[2]], c[1]), reverse=True)
        for c in children:
            table[c[2], c[3]] = c[:2]
            stack.append((*c, came, skip))
    return best


class Seen:
    """Digests of a conversation's rows: a recent set, and sorted runs that merge geometrically."""

    def __init__(self):
        self.recent: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def add(self, row: bytes) -> bool:
        """Whether the row is new."""
        key = np.bytes_(row.rstrip(b"\0"))  # as fixed-width arrays give their entries back
        if row in self.recent or any((p := int(np.searchsorted(r, key))) < len(r) and r[p] == key for r in self.runs):
            return False
        self.recent.add(row)
        if len(self.recent) >= 1 << 16:
            run = np.sort(np.array(list(self.recent), "S16"))
            while self.runs and len(self.runs[-1]) <= 2 * len(run):
                run = np.sort(np.concatenate([self.runs.pop(), run]))
            self.runs.append(run)
            self.recent = set()
        return True


class Way:
    """The best prefix that ends in a state: its cost, what of its audit is not shared by all ways, its turns so far."""

    __slots__ = ("cost", "audit", "sha", "turns")

    def __init__(self, cost: int, audit: str, sha, turns: int):
        self.cost, self.audit, self.sha, self.turns = cost, audit, sha, turns


class Conversation:
    """One conversation as it streams by: faults, gaps, and the ways through its blocks."""

    def __init__(self):
        self.rows: list[tuple[str, str, bool, bool]] = []  # role, text, forced, cut off
        self.held = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.turns = 0  # distinct non-null turns; rows come by turn
        self.before: str | None = None
        self.seen = Seen()
        self.ways = {START: Way(0, "", hashlib.sha256(), 0)}
        self.settled: list[str] = []

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        body = text.strip(SPACE)
        new = self.seen.add(hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest())
        forced, cut = not body or not new, False
        if not body:
            self.blank += 1
        elif not new:
            self.duplicate += 1
        elif body[-1] not in ".!?":
            cut = True
            self.truncated += 1
        if len(self.rows) >= BLOCK or self.held > BLOCK_BYTES:
            self.through(False)
        self.rows.append((role, text, forced, cut))
        self.held += len(text)

    def through(self, last: bool) -> None:
        """The ways go on through the rows held."""
        found = search([r[0][:1] for r in self.rows], [r[2] for r in self.rows], [r[3] for r in self.rows],
                       {s: (w.cost, w.audit) for s, w in self.ways.items()}, last)
        ways = {}
        for state, (cost, audit, came, edits) in found.items():
            old = self.ways[came]
            sha, turns = old.sha.copy(), old.turns
            for role, text, _ in edited(edits, ((r[0], r[1]) for r in self.rows), came):
                sha.update(f"{'' if not turns else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                turns += 1
            ways[state] = Way(cost, audit, sha, turns)
        shared = min(len(w.audit) for w in ways.values())
        first = next(iter(ways.values())).audit
        while not all(w.audit.startswith(first[:shared]) for w in ways.values()):
            shared -= 1
        self.settled.append(first[:shared])
        for w in ways.values():
            w.audit = w.audit[shared:]
        self.ways, self.rows, self.held = ways, [], 0

    def summary(self) -> tuple:
        self.through(True)
        (end,) = self.ways.values()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, end.cost, "".join(self.settled) + end.audit,
                end.sha.hexdigest())


def edited(edits: Iterator[str] | str, rows: Iterator[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """Repaired (role, text, edit) turns: the edits' initials applied to rows, from a state on."""
    for edit in edits:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state][role[:1]]
        else:
            state = DUE[state]
            role = ROLE[state]
        yield role, text, edit


def ordered(rows: DataFrame) -> DataFrame:
    """The rows of a conversation together, by turn (nulls first), ties by kind, role and text."""
    by = [F.col("conv").asc_nulls_first(), F.col("first").desc(), F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv").sortWithinPartitions(*by)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Each row with whether its conversation differs from the row's before it."""
    before: object = _groups  # no conversation's id
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[0] != before or type(row[0]) is not type(before), row
            before = row[0]


def repair(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of `rows(conv, turn, role, text, gone)`: its faults, the edits' cost and audit, and the
    digest of the repaired turns.

    Null roles and texts are one space.  A null conversation id is a conversation of its own; rows of one turn stand by role and text; a repeated row is a
    duplicate.  A conversation without rows (all gone) has zeros, an empty audit and the digest of nothing; an empty
    table gives an empty result.  Turns of any length are held one block at a time."""
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, now = [], [], None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array(ids, batch_type), *(pa.array(c, t) for c, t in zip(cols, types))],
                                               names=["conv", *(x.split()[0] for x in SUMMARY.split(", "))])
            ids.clear()
            out.clear()
            return batch

        batch_type = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal batch_type
            for b in batches:
                batch_type = b.schema.field("conv").type
                yield b

        for new, (key, turn, role, text, gone, _) in _groups(typed()):
            if new:
                if now is not None:
                    out.append(now.summary())
                    if len(out) >= 1000:
                        yield flush()
                now = Conversation()
                ids.append(key)
            if not gone:
                now.add(turn, role, text)
        if now is not None:
            out.append(now.summary())
            yield flush()

    got = ordered(_plain(rows)).mapInArrow(run, f"conv {kind.simpleString()}, {SUMMARY}")
    return got.withColumnRenamed("conv", conv)


def _plain(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select("conv", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"),
                       F.coalesce("gone", F.lit(False)).alias("gone"), F.lit(False).alias("first"))


def repaired_turns(rows: DataFrame, audits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The repaired conversations themselves: (conv, place, role, text, edit), places from 0.

    `audits` is what `repair` returned for `rows`.  Each conversation's audit goes before its rows, which then stream by."""
    kind = rows.schema["conv"].dataType
    head = audits.select(F.col(conv).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.col("audit").alias("text"), F.lit(False).alias("gone"), F.lit(True).alias("first"))
    src = ordered(_plain(rows).where(~F.col("gone")).unionByName(head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", *(x.split()[0] for x in TURNS.split(", "))]
        held: list[tuple] = []
        key_type = pa.null()

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for b in batches:
                key_type = b.schema.field("conv").type
                yield b

        def flush() -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held.clear()
            return out

        stream = _groups(typed())
        ahead = next(stream, None)
        while ahead is not None:
            key, audit = ahead[1][0], ahead[1][3]

            def own() -> Iterator[tuple[str, str]]:
                nonlocal ahead
                ahead = next(stream, None)
                while ahead is not None and not ahead[0]:
                    row = ahead[1]
                    yield row[2], row[3]
                    ahead = next(stream, None)

            turns = own()
            size = 0
            for place, (role, text, edit) in enumerate(edited(audit, turns, START)):
                held.append((key, place, role, text, edit))
                size += len(text)
                if len(held) >= 1000 or size > BLOCK_BYTES:
                    yield flush()
                    size = 0
            for _ in turns:  # to the next conversation
                pass
        if held:
            yield flush()

    return src.mapInArrow(run, f"conv {kind.simpleString()}, {TURNS}").withColumnRenamed("conv", conv)
