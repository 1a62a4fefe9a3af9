"""Operator 12, conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Costs go up in layers, as Wu and Manber count errors: a layer holds, for each turn, the set of grammar states (four bits) from which the rest of
the conversation can be finished at exactly that cost.  The first layer whose first set holds the start state gives the cost, and
following the bits from there, least letter first, gives the least audit.

Rows are dealt by ranges of conversation and turn.  A conversation that lies within a range is solved there.  Those that touch a range's
ends, and those over PIECE rows, go on as pieces: costs between grammar states over a piece are a small matrix, and matrices are put
together from the end, so that pieces are traced apart and no task holds a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.shared import stored

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Grammar states of `(s?(ua)+)?` as bits: nothing yet, after s, after u, after a; a conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
STATES, FINAL = (START, SYSTEM, USER, ASSISTANT), START | ASSISTANT
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The turn that can follow in each state without s.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows and bytes of a piece.
PIECE, PIECE_BYTES = 64, 1 << 22
#: No way at any cost.
NEVER = 1 << 60
#: Fixed value: white space.
BLANKS = " \t\n\x0b\f\r"


def _before(letters: str) -> list[int]:
    """For each set of states, those from which one of the letters leads into it."""
    return [sum({p for p in STATES for x in letters if STEPS.get((p, x), 0) & held}) for held in range(16)]


BEFORE = {x: _before(x) for x in "sua"}
BEFORE_ANY = _before("ua")
NO_WAY = [0] * 16


class Piece:
    """Consecutive rows of a conversation: initials of roles, whether a row must go, and what keeping it costs."""

    def __init__(self, initials: list[str], gone: list[bool], cut: list[bool]) -> None:
        self.rows = list(zip(initials, gone, map(int, cut), strict=True))
        self.layers: list[list[int]] = []

    def climb(self, ends: list[int], last: bool, wanted: int) -> list[int]:
        """Least cost from each state, where ends has the cost of finishing from each state after the piece; NEVER where there is no way.

        Layers are made until all wanted states (a set) that have a way at all have their cost.  Turns are inserted before rows, and after the
        last only where the piece ends its conversation.
        """
        n, found = len(self.rows), dict.fromkeys(STATES, NEVER)
        able = sum(q for q, e in zip(STATES, ends, strict=True) if e < NEVER)
        for i in range(n, -1, -1):
            if i < n:
                x, must, _ = self.rows[i]
                able |= 0 if must else BEFORE.get(x, NO_WAY)[able] | BEFORE_ANY[able]
            if i < n or last:
                able |= BEFORE_ANY[able]
                able |= BEFORE_ANY[able]
        wanted &= able
        self.layers, none = [], [0] * (n + 1)
        layer = lambda c: self.layers[c] if c >= 0 else none
        while wanted:
            c = len(self.layers)
            here = [0] * (n + 1)
            self.layers.append(here)
            inserted, deleted = layer(c - INSERT), layer(c - DELETE)
            held = sum(q for q, e in zip(STATES, ends, strict=True) if e == c)
            here[n] = held | (BEFORE_ANY[inserted[n]] if last else 0)
            for i in range(n - 1, -1, -1):
                x, must, cut = self.rows[i]
                held = deleted[i + 1] | BEFORE_ANY[inserted[i]]
                if not must:
                    held |= BEFORE.get(x, NO_WAY)[layer(c - cut)[i + 1]] | BEFORE_ANY[layer(c - REROLE - cut)[i + 1]]
                here[i] = held
            for q in STATES:
                if wanted & here[0] & q:
                    found[q] = c
            wanted &= ~here[0]
        return [found[q] for q in STATES]

    def trace(self, state: int, cost: int, ends: list[int], last: bool) -> tuple[str, int]:
        """Initials of the ASCII-least cheapest edits from a state after climb(), and the state that they lead to."""
        out, i, n, has = [], 0, len(self.rows), lambda q, c, k: c >= 0 and bool(self.layers[c][k] & q)
        while not (i == n and ends[STATES.index(state)] == cost):
            step = STEPS[state, NEXT[state]]
            x, must, cut = self.rows[i] if i < n else ("", True, 0)
            kept = 0 if must else STEPS.get((state, x), 0)
            if i < n and has(state, cost - DELETE, i + 1):
                edit, cost, i = "D", cost - DELETE, i + 1
            elif (i < n or last) and has(step, cost - INSERT, i):
                edit, cost, state = "I", cost - INSERT, step
            elif kept and has(kept, cost - cut, i + 1):
                edit, cost, state, i = "K", cost - cut, kept, i + 1
            else:
                edit, cost, state, i = "R", cost - REROLE - cut, step, i + 1
            out.append(edit)
        return "".join(out), state


def apply_edits(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The turns that the edits of a piece leave, from a state on."""
    i = 0
    for edit in audit:
        if edit in "IR":
            x = NEXT[state]
            yield NAMES[x], "" if edit == "I" else texts[i]
            state = STEPS[state, x]
        elif edit == "K":
            yield roles[i], texts[i]
            state = STEPS[state, roles[i][0]]
        i += edit != "I"


class Report:
    """What is told of a conversation, gathered piece by piece."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.cut = self.illegal = 0
        self.initial, self.audit, self.state, self.sha, self.turns = None, [], START, hashlib.sha256(), 0

    def add(self, turns: list, roles: list[str], texts: list[str], blank: list[bool], again: list[bool], cut: list[bool], audit: str, leads: int) -> list[tuple[str, str]]:
        """Take in a piece and its edits; returns the turns that stay."""
        for t in turns:
            if t is not None:
                self.distinct += t != self.high
                self.low, self.high = t if self.low is None else self.low, t
        self.blank += sum(blank)
        self.duplicate += sum(a and not b for a, b in zip(again, blank, strict=True))
        self.cut += sum(c and not a and not b for a, b, c in zip(again, blank, cut, strict=True))
        for r in roles:
            self.illegal += self.initial is not None and self.initial + r[:1] not in LEGAL
            self.initial = r[:1]
        stay = list(apply_edits(audit, self.state, roles, texts))
        for role, text in stay:
            self.sha.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
            self.turns += 1
        self.audit.append(audit)
        self.state = leads
        return stay

    def row(self, cost: int) -> dict:
        gaps = self.high - self.low + 1 - self.distinct if self.high is not None else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.cut, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _piece(roles: list[str], blank: list[bool], again: list[bool], cut: list[bool]) -> Piece:
    return Piece([r[:1] for r in roles], [a or b for a, b in zip(again, blank, strict=True)], cut)


ENDS = [0 if q & FINAL else NEVER for q in STATES]
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "turns array<long>, roles array<string>, texts array<string>, digests array<string>, blanks array<boolean>, cuts array<boolean>"
STAY = "stay array<struct<role: string, text: string>>"
#: Columns of dealt rows, without conv.
COLUMNS = ["turns", "roles", "texts", "digests", "blanks", "cuts"]


def _schema(df: DataFrame, ddl: str):
    out = df.sparkSession.createDataFrame([], ddl).schema
    return out, to_arrow_schema(out)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _dealt(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, absent: Column) -> DataFrame:
    """Rows dealt by ranges of conversation, turn, role and text, a last tie-break among equal rows, and in that order."""
    slim = rows.select(F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.coalesce(absent, F.lit(False)).alias("absent"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    flags = {"digest": F.sha2("text", 256), "blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "tie": F.monotonically_increasing_id()}
    keys = ["conv", "turn", "role", "digest", "tie"]
    return slim.withColumns(flags).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")


def _solved_or_cut(dealt: DataFrame, stay: bool) -> DataFrame:
    """A report for each conversation that surely lies in one range, pieces of the others."""
    out, schema = _schema(dealt, f"conv string, number long, open boolean, {REPORT}, {STAY}, {ROWS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        conv, held, size, pieces, first = None, [], 0, 0, True

        def whole() -> dict:
            turns, roles, texts, digests, blank, cut = map(list, zip(*held, strict=True)) if held else ([], [], [], [], [], [])
            return {"turns": turns, "roles": roles, "texts": texts, "digests": digests, "blanks": blank, "cuts": cut}

        def close(last: bool) -> dict:
            """The rows held, as a report or a piece."""
            nonlocal held, size, made, pieces
            r, row = whole(), {"conv": conv, "number": base + made}
            made += 1
            if first or last or pieces or size > PIECE_BYTES or len(held) > PIECE:
                row |= {"open": True} | r
                pieces += 1
            else:
                again, seen = [], set()
                for key in zip(r["roles"], r["digests"], strict=True):
                    again.append(key in seen)
                    seen.add(key)
                piece = _piece(r["roles"], r["blanks"], again, r["cuts"])
                cost = piece.climb(ENDS, True, START)[0]
                report = Report()
                kept = report.add(r["turns"], r["roles"], r["texts"], r["blanks"], again, r["cuts"], *piece.trace(START, cost, ENDS, True))
                row |= {"open": False} | report.row(cost) | ({"stay": [{"role": a, "text": b} for a, b in kept]} if stay else {})
            held, size = [], 0
            return row

        for batch in batches:
            rows, ready = batch.to_pydict(), []
            for name, absent, *row in zip(*[rows[c] for c in ("conv", "absent", "turn", "role", "text", "digest", "blank", "cut")], strict=True):
                if name != conv:
                    if conv is not None:
                        ready.append(close(False))
                        first = False
                    conv, pieces = name, 0
                if absent:
                    continue
                if held and (len(held) >= PIECE or size + len(row[2]) > PIECE_BYTES):
                    pieces += 1  # longer than a piece: all of it goes on as pieces
                    ready.append(close(False))
                held.append(row)
                size += len(row[2])
            if ready:
                yield _batch(ready, schema)
        if conv is not None:
            yield _batch([close(True)], schema)

    return dealt.mapInArrow(run, out)


def _with_again(pieces: DataFrame) -> DataFrame:
    """pieces with again: whether a row's role and text stand earlier in its conversation.

    A pair's first place is an aggregate over its conversation's pieces, so a text that is repeated ever so often sends one row from each task.
    """
    keys = ["conv", "role", "digest"]
    rows = pieces.select("conv", "number", F.posexplode(F.arrays_zip("roles", "digests")).alias("k", "r")).select("conv", "number", "k", F.col("r.roles").alias("role"), F.col("r.digests").alias("digest"))
    places = rows.groupBy(*keys, "number").agg(F.min("k").alias("k"))
    first = places.groupBy(*keys).agg(F.min("number").alias("first")).withColumnsRenamed({c: f"{c}_" for c in keys})
    same = (F.col("conv") == F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    late = places.join(first, same).where("number > first").groupBy("conv", "number").agg(F.collect_list("k").alias("late"))
    found = pieces.join(late, ["conv", "number"], "left").withColumn("keys", F.transform(F.arrays_zip("roles", "digests"), lambda r: F.concat_ws("\0", r["roles"], r["digests"])))
    local = F.transform("keys", lambda key, k: (F.array_position("keys", key) <= k) | F.coalesce(F.array_contains("late", k), F.lit(False)))
    return found.withColumn("again", local).drop("keys", "late")


def _streamed(pieces: DataFrame, downwards: bool) -> DataFrame:
    """Pieces of a conversation one after the other in one task, which needs to hold only one."""
    return pieces.repartition("conv").sortWithinPartitions("conv", F.desc("number") if downwards else F.asc("number"))


def _joined(pieces: DataFrame, stay: bool) -> DataFrame:
    """Reports of conversations in pieces."""
    held = stored(_with_again(pieces), "conversation-pieces")
    slim = held.select("conv", "number", "roles", "blanks", "again", "cuts")
    out, schema = _schema(held, "conv string, number long, through array<array<long>>, finish array<long>")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                piece = _piece(r["roles"], r["blanks"], r["again"], r["cuts"])
                through = [piece.climb([0 if q == p else NEVER for p in STATES], False, 15) for q in STATES]
                rows.append({"conv": r["conv"], "number": r["number"], "through": through, "finish": piece.climb(ENDS, True, 15)})
            yield _batch(rows, schema)

    out_ends, schema_ends = _schema(held, "conv string, number long, ends array<long>, last boolean, cost long")

    def from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ahead = None, ENDS
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                last = r["conv"] != conv
                ends = ENDS if last else ahead
                conv = r["conv"]
                ahead = r["finish"] if last else [min(c + e for c, e in zip(ways, ends, strict=True)) for ways in zip(*r["through"], strict=True)]
                rows.append({"conv": conv, "number": r["number"], "ends": ends, "last": last, "cost": ahead[0]})
            yield _batch(rows, schema_ends)

    out_traced, schema_traced = _schema(held, "conv string, number long, audits array<string>, leads array<long>")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                piece, least = _piece(r["roles"], r["blanks"], r["again"], r["cuts"]), min(r["ends"])
                ends = [e - least if e < NEVER else NEVER for e in r["ends"]]
                costs = piece.climb(ends, r["last"], 15)
                ways = [piece.trace(q, c, ends, r["last"]) if c < NEVER else ("", 0) for q, c in zip(STATES, costs, strict=True)]
                rows.append({"conv": r["conv"], "number": r["number"], "audits": [a for a, _ in ways], "leads": [q for _, q in ways]})
            yield _batch(rows, schema_traced)

    out_final, schema_final = _schema(held, f"conv string, number long, {REPORT}, {STAY}")

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, report = None, Report()
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                if r["conv"] != conv:
                    conv, report, cost = r["conv"], Report(), r["cost"]
                way = STATES.index(report.state)
                kept = report.add(r["turns"], r["roles"], r["texts"], r["blanks"], r["again"], r["cuts"], r["audits"][way], r["leads"][way])
                row = {"conv": conv, "number": r["number"], "stay": [{"role": a, "text": b} for a, b in kept] if stay else None}
                if r["last"] or stay:
                    yield _batch([row | (report.row(cost) if r["last"] else {})], schema_final)

    matrix = stored(slim.mapInArrow(matrices, out), "conversation-costs")
    ends = stored(_streamed(matrix, True).mapInArrow(from_the_end, out_ends), "conversation-ends")
    traced = slim.join(ends, ["conv", "number"]).mapInArrow(traces, out_traced)
    parts = held.join(ends, ["conv", "number"]).join(stored(traced, "conversation-traces"), ["conv", "number"]).drop("digests")
    return _streamed(parts, False).mapInArrow(forwards, out_final)


def _reports(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent: Column, stay: bool) -> DataFrame:
    dealt = _dealt(rows, F.col(conv_col), F.col(turn_col), F.col(role_col), F.col(text_col), absent)
    first = stored(_solved_or_cut(dealt, stay), "conversations")
    names = [c for c in first.columns if c not in ("open", *COLUMNS)]
    done = first.where("not open").select(*names)
    return done.unionByName(_joined(first.where("open").drop(*[c for c in names if c not in ("conv", "number")], "open"), stay).select(*names))


def _named(rows: DataFrame, conv_col: str) -> Column:
    return F.when(F.col("conv") != "", F.expr("substr(conv, 2)")).cast(rows.schema[conv_col].dataType).alias(conv_col)


def repair_reports(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, least cost of repair, the least audit of its edits and the digest of the repaired turns.

    Turns are in the order of turn (null first), then role, then the digest of the text.  A null role or text counts as one space, a null
    conversation as one of its own.  Faults are blank, duplicate (role and text stand earlier) and truncated (no `.`, `!` or `?` at the end), the first that
    holds; illegal counts neighbours whose role initials are not su, ua or au.  Edits: keep (0), rerole to user or assistant (2), delete (3,
    a must for blank and duplicate turns), insert an empty turn (2); a truncated turn that stays adds 1.  The result's initials match
    `(s?(ua)+)?`.  Rows where absent holds are not there, but their conversation is: without other rows it has zeros, an empty audit and the
    digest of nothing.  Repeated rows are duplicates, however many; texts are used whole, a very long one makes a piece of its own; an empty table
    gives an empty result; other columns, whatever their names, are not read.
    """
    found = _reports(rows, conv_col, turn_col, role_col, text_col, F.lit(False) if absent is None else absent, False).where("audit is not null")
    return found.select(_named(rows, conv_col), *[c for c in found.columns if c not in ("conv", "number", "stay")])


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """The repaired conversations: conversation, piece and place (together the order), role and text of each turn; see repair_reports."""
    found = _reports(rows, conv_col, turn_col, role_col, text_col, F.lit(False) if absent is None else absent, True)
    turns = found.select(_named(rows, conv_col), F.col("number").alias("piece"), F.posexplode("stay").alias("place", "turn"))
    return turns.select(conv_col, "piece", "place", "turn.role", "turn.text")
