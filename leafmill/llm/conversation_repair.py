"""Cheapest repair of conversation structure: a dynamic program over secondary-sorted rows."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space of the contract: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE = 3, 2, 2
TRUNCATED_COST = 1
# Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
# States of the role initials written so far: none, a leading s, the last one u, the last one a.
NONE, SYSTEM, USER, ASSISTANT = range(4)
WANTED = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
# Where a kept row of each initial may stand, and the state behind it.
KEEPS = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# Costs of closing a conversation from each state: nothing, or the inserts still missing.
CLOSING = (0, 2 * INSERT, INSERT, 0)
# Edit initials in ASCII order: a smaller number wins among equally cheap edits.
EDITS = "DIKR"
ADJACENT = frozenset(("su", "ua", "au"))
# Bytes of backpointers a conversation holds in memory before blocks of them are spilled.
SPILL_BYTES = 1 << 20


def step(costs: tuple, initial: str, fault: int) -> tuple[tuple, int]:
    """(cheapest costs from each state with this row still ahead, backpointers), from those behind the row.

    The backpointers are one byte: two bits per state, the number in ``EDITS`` of the first edit on the
    cheapest way whose initials are ASCII-least.
    """
    options: list[list[tuple[int, int]]] = []
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for state in range(4):
        found = [(costs[state] + DELETE, 0)]
        if fault not in (BLANK, DUPLICATE):
            kept = KEEPS.get(initial, {}).get(state)
            if kept is not None:
                found.append((costs[kept] + extra, 2))
            found.append((costs[WANTED[state]] + REROLE + extra, 3))
        options.append(found)
    bare = [min(c for c, _ in found) for found in options]
    # two inserts in a row would lead back to the same state, but from none and s
    user = min(bare[USER], bare[ASSISTANT] + INSERT)
    assistant = min(bare[ASSISTANT], bare[USER] + INSERT)
    ahead = {NONE: user, SYSTEM: user, USER: assistant, ASSISTANT: user}
    best, pointers = [], 0
    for state in range(4):
        found = sorted([*options[state], (ahead[state] + INSERT, 1)])
        best.append(found[0][0])
        pointers |= found[0][1] << (2 * state)
    return tuple(best), pointers


class Backpointers:
    """A stack of bytes. Beyond ``limit`` its older blocks are in an unnamed scratch file of the task's own,
    like those of Spark's sorts: nothing else reads it, and it goes with the task."""

    def __init__(self, limit: int = SPILL_BYTES):
        self.limit, self.top, self.file, self.spilled = limit, bytearray(), None, 0

    def push(self, byte: int) -> None:
        if len(self.top) >= self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(self.spilled)
            self.file.write(self.top)
            self.spilled += len(self.top)
            self.top = bytearray()
        self.top.append(byte)

    def pop(self) -> int:
        if not self.top:
            self.spilled -= self.limit
            self.file.seek(self.spilled)
            self.top = bytearray(self.file.read(self.limit))
        return self.top.pop()

    def close(self) -> None:
        if self.file:
            self.file.close()


class Conversation:
    """State of one conversation while its rows stream by: first backwards without their texts, which
    fills the costs and backpointers, then forwards with them, which follows the backpointers."""

    def __init__(self, key: str | None, memo: dict, limit: int):
        self.key, self.memo = key, memo
        self.costs, self.base = CLOSING, 0
        self.pointers = Backpointers(limit)
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.after: str | None = None
        self.last = self.first = None
        self.distinct = self.rows = 0
        self.state = NONE
        self.audit = bytearray()

    def back(self, turn: int | None, initial: str, fault: int) -> None:
        self.rows += 1
        self.faults[fault] += 1
        if self.after is not None:
            self.illegal += initial + self.after not in ADJACENT
        self.after = initial
        if turn is not None:
            if self.first != turn:
                self.distinct += 1
            self.last = turn if self.last is None else self.last
            self.first = turn
        key = (self.costs, initial, fault)
        known = self.memo.get(key)
        if known is None:
            costs, pointers = step(*key)
            low = min(costs)
            # costs differ between states by a few edits at most, so there are few such keys
            known = self.memo[key] = (tuple(c - low for c in costs), low, pointers)
        self.costs, low, pointers = known
        self.base += low
        self.pointers.push(pointers)

    def edits(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the edits up to and with this row."""
        pointers = self.pointers.pop()
        while True:
            edit = EDITS[(pointers >> (2 * self.state)) & 3]
            self.audit.append(ord(edit))
            if edit == "D":
                yield edit, role, text
                return
            if edit == "K":
                self.state = KEEPS[role[0]][self.state]
                yield edit, role, text
                return
            self.state = WANTED[self.state]
            yield edit, ROLES[self.state], "" if edit == "I" else text
            if edit == "R":
                return

    def closing(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (SYSTEM, USER):
            self.state = WANTED[self.state]
            self.audit.append(ord("I"))
            yield "I", ROLES[self.state], ""
        self.pointers.close()

    def report(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return gaps, *self.faults[BLANK:], self.illegal, self.base + self.costs[NONE], self.audit.decode()


def streamed(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The rows of each conversation in one partition and in two passes: backwards without role and text,
    then forwards with them. Order: turn (nulls first), then role and text.

    Everything is planned on one exchange by conversation; sorts and windows spill.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    plain = rows.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"),
        (F.lit(True) if present is None else present).alias("present"),
    ).repartition("conv")
    same = Window.partitionBy("conv", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv").orderBy(F.desc("present"), F.asc_nulls_first("turn"), "role", "text", "seen")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    judged = plain.withColumn("seen", F.row_number().over(same)).withColumn("at", F.row_number().over(order).cast("long"))
    judged = judged.select("conv", "present", "turn", "role", "text", "at", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    both = judged.withColumn("forward", F.explode(F.array(F.lit(False), F.lit(True))))
    forward = F.col("forward")
    return (
        both.select(
            "conv",
            "forward",
            F.when(forward, F.col("at")).otherwise(-F.col("at")).alias("at"),
            "present",
            F.when(~forward, F.col("turn").cast("string")).alias("turn"),
            "initial",
            "fault",
            F.when(forward, F.col("role")).alias("role"),
            F.when(forward, F.col("text")).alias("text"),
        )
        .sortWithinPartitions("conv", "forward", "at")
        .select(F.col("conv").cast("string").alias("conv"), "forward", "present", "turn", "initial", "fault", "role", "text")
    )


def follow(frames: Iterator[pd.DataFrame], limit: int, edited: Callable, ended: Callable) -> Iterator[list]:
    """Drives the conversations through the batches; a conversation may span any number of them.

    ``edited`` gets each conversation and its edits of one row, ``ended`` the conversation at its end;
    what they return is the output of the batch.
    """
    now: Conversation | None = None
    memo: dict = {}
    for frame in frames:
        out: list = []
        columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in ("conv", "forward", "present", "turn", "initial", "fault", "role", "text")]
        for conv, forward, present, turn, initial, fault, role, text in zip(*columns, strict=True):
            if now is None or now.key != conv:
                if now is not None:
                    out += edited(now, now.closing()) + ended(now)
                now = Conversation(conv, memo, limit)
            if present and not forward:
                now.back(None if turn is None else int(turn), initial, fault)
            elif present:
                out += edited(now, now.edits(role, text))
        yield out
    if now is not None:
        yield edited(now, now.closing()) + ended(now)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audit_conversations(rows: DataFrame, present: Column | None = None, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role and text; rows where ``present`` is false only say that the
    conversation exists. A row's first fault counts: blank, duplicate (role and text stand earlier in the
    conversation) or truncated (its last character but white space is not . ! or ?). The cheapest edits
    are found that make the role initials ``(s?(ua)+)?``, and of those the ASCII-least. The digest is
    that of the lines ``role:text`` left, and is fed row by row.

    A null role or text is one space, null turns come first and stand in no gap, null conv_ids are one
    conversation. Rows alike are interchangeable; rows of one turn are ordered by role and text. A
    conversation without rows has zeros, an empty audit and the digest of an empty text. An empty table
    gives no rows; other columns are not read. A conversation streams through one task, which holds one
    byte per row, spilled beyond ``spill_bytes``, and the audit.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests: dict = {}

        def edited(conversation: Conversation, edits: Iterator) -> list:
            for edit, role, text in edits:
                if edit != "D":
                    digest = digests.get("now")
                    if digest is None:
                        digest = digests["now"] = hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            return []

        def ended(conversation: Conversation) -> list:
            digest = digests.pop("now", None) or hashlib.sha256()
            return [(conversation.key, *conversation.report(), digest.hexdigest())]

        names = ["conv", *[field.split()[0] for field in REPORT.split(", ")]]
        for out in follow(frames, spill_bytes, edited, ended):
            yield pd.DataFrame(out, columns=names)

    kind = rows.schema["conv_id"].dataType
    found = streamed(rows, present).mapInPandas(run, f"conv string, {REPORT}")
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *[field.split()[0] for field in REPORT.split(", ")])


def repaired_rows(rows: DataFrame, present: Column | None = None, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The edits themselves: (conv_id, nth, edit, role, text), nth from 0 in the order of the edits.

    ``edit`` is D, I, K or R. A deleted row has its old role and text, all others those of the repaired
    conversation. The same rules hold as for ``audit_conversations``; conversations without edits give
    no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edited(conversation: Conversation, edits: Iterator) -> list:
            first = len(conversation.audit)
            return [(conversation.key, first + i, *edit) for i, edit in enumerate(edits)]

        for out in follow(frames, spill_bytes, edited, lambda conversation: []):
            yield pd.DataFrame(out, columns=["conv", "nth", "edit", "role", "text"])

    kind = rows.schema["conv_id"].dataType
    found = streamed(rows, present).mapInPandas(run, "conv string, nth long, edit string, role string, text string")
    return found.select(F.col("conv").cast(kind).alias("conv_id"), "nth", "edit", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows with one of five kinds of damage, by crc32 of
    ``conv_id:turn`` modulo 20 (0 dropped, 1 text emptied, 2 without . ! ?, 3 twice, 4 role user).
    Nulls are one space; dropped rows stay with ``present`` false."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            (F.col("kind") != 0).alias("present"),
        )
    )


def audit_sql() -> str:
    """``audit_conversations(damaged(conversations))``: the cheapest way from every state, with its edits and
    its lines as text, row by row from the last."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    way = lambda state, cost, edit, line: f"{{'c': n.{state}.c + {cost}, 'e': '{edit}' || n.{state}.e, 'r': {line} || n.{state}.r}}"
    own = "[d.role || ':' || d.text]"
    user, assistant = "['user:' || d.text]", "['assistant:' || d.text]"
    may = "d.fault NOT IN (1, 2)"
    extra = "(CASE WHEN d.fault = 3 THEN 1 ELSE 0 END)"

    def bare(state: str, keeps: dict[str, str], wanted: str, line: str) -> str:
        kept = "".join(f", CASE WHEN {may} AND d.initial = '{i}' THEN {way(to, extra, 'K', own)} END" for i, to in keeps.items())
        return f"list_min(list_filter([{way(state, 3, 'D', '[]')}{kept}, CASE WHEN {may} THEN {way(wanted, f'{extra} + 2', 'R', line)} END], lambda w: w IS NOT NULL))"

    put = lambda state, role: f"{{'c': {state}.c + 2, 'e': 'I' || {state}.e, 'r': ['{role}:'] || {state}.r}}"
    end = lambda roles: f"{{'c': {2 * len(roles)}, 'e': '{'I' * len(roles)}', 'r': CAST([{', '.join(repr(r + ':') for r in roles)}] AS VARCHAR[])}}"
    return f"""
WITH RECURSIVE byte_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps
),
spelled AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS bytes
    FROM conversations
),
hit AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || substr(bytes, i, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind
    FROM spelled, byte_table
),
damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit) WHERE kind <> 0
),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, rtrim(text, {blanks}) AS bare FROM damaged),
ordered AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS place, left(role, 1) || lead(left(role, 1)) OVER w AS pair,
           CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
    FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
           count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
           count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
    FROM ordered GROUP BY conv_id
),
ways AS (
    SELECT conv_id, n AS left_over, {end([])} AS none, {end(["user", "assistant"])} AS s, {end(["assistant"])} AS u, {end([])} AS a FROM counted
    UNION ALL
    SELECT conv_id, left_over, list_min([b_none, {put("b_u2", "user")}]), list_min([b_s, {put("b_u2", "user")}]), b_u2, b_a2
    FROM (
        SELECT *, list_min([b_u, {put("b_a", "assistant")}]) AS b_u2, list_min([b_a, {put("b_u", "user")}]) AS b_a2
        FROM (
            SELECT n.conv_id, n.left_over - 1 AS left_over,
                   {bare("none", {"s": "s", "u": "u"}, "u", user)} AS b_none, {bare("s", {"u": "u"}, "u", user)} AS b_s,
                   {bare("u", {"a": "a"}, "a", assistant)} AS b_u, {bare("a", {"u": "u"}, "u", user)} AS b_a
            FROM ways n JOIN ordered d ON d.conv_id IS NOT DISTINCT FROM n.conv_id AND d.place = n.left_over
        )
    )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(none.c, 0) AS cost, coalesce(none.e, '') AS audit,
       sha256(coalesce(array_to_string(none.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ways ON ways.conv_id IS NOT DISTINCT FROM c.conv_id AND left_over = 0
"""
