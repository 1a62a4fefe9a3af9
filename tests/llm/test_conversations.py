"""Operator 12 against a search over all edits by dynamic programming on whole strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, queries

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for c, t, role, text in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(c, t, "user" if n == 4 else role, text)] * {0: 0, 3: 2}.get(n, 1)
    return out


def cheapest(rows):
    """(cost, audit, turns): the least by cost, then audit."""
    never = (1 << 40, "", ())

    def inserted(best):
        for _ in range(4):
            for q in best:
                x = "a" if q == "u" else "u"
                cost, audit, turns = best[NEXT[q, x]]
                best[q] = min(best[q], (cost + 2, "I" + audit, (f"{NAMES[x]}:", *turns)), key=lambda b: b[:2])
        return best

    best = inserted({"": (0, "", ()), "s": never, "u": never, "a": (0, "", ())})
    for role, text, must, cut in reversed(rows):
        now = {}
        for q in best:
            ways = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            for x in {role[:1], "u", "a"} if not must else ():
                if (q, x) in NEXT:
                    cost, audit, turns = best[NEXT[q, x]]
                    ways += [(cost + cut, "K" + audit, (f"{role}:{text}", *turns))] if x == role[:1] else []
                    ways += [(cost + 2 + cut, "R" + audit, (f"{NAMES[x]}:{text}", *turns))] if x in NAMES else []
            now[q] = min(ways, key=lambda b: b[:2])
        best = inserted(now)
    return best[""]


def by_hand(raw):
    out, rows = [], damage(raw)
    for conv in {r[0] for r in raw}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        seen, blank, again, cut, judged = set(), 0, 0, 0, []
        for _, _, role, text in own:
            some = re.sub("[ \t-\r]", "", text)
            empty, twice, open_end = not some, (role, text) in seen, bool(some) and some[-1] not in ".!?"
            seen.add((role, text))
            blank, again, cut = blank + empty, again + (twice and not empty), cut + (open_end and not twice)
            judged.append((role, text, empty or twice, int(open_end)))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, left = cheapest(judged)
        out.append((conv, gaps, blank, again, cut, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def reports(df):
    return sorted(map(tuple, conversations.repair_reports(queries.damaged_conversations(df), absent=F.col("absent")).select(*OUT).collect()), key=repr)


def test_query(spark, tiny):
    raw = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, tiny).select(*OUT).collect()), key=repr) == by_hand(raw)


@pytest.fixture(scope="module")
def table(spark):
    """Nulls everywhere, odd roles, repeated rows and turns, one conversation of 700 rows, and columns with clashing names."""
    rng = random.Random(5)
    texts = ["Hi.", "No", "Yes!", " ", "", "what?\n", "ok. ", "ok.", "é", None, "A ", "x" * 20_000, "long. " * 3_000]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "umpire"]
    rows = [(rng.choice([c, None]) if c < 3 else c, rng.choice([i, i, i, None, 3]), rng.choice(roles), rng.choice(texts)) for c in range(150) for i in range(rng.randint(1, 14))]
    rows += [(7777, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Go.", "Go", f"Say {i}.", f"Say {i}!", f"x{i % 200}."])) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "c", True) for r in rows], "conv_id long, turn long, role string, text string, number int, conv string, open boolean")
    return df, rows


@pytest.mark.parametrize("parts", [1, 13])
def test_odd_rows(table, parts):
    df, rows = table
    assert reports(df.repartition(parts)) == by_hand(rows)


def test_empty(table):
    assert reports(table[0].limit(0)) == []


def test_repaired_turns(table):
    df, rows = table
    got = conversations.repaired_turns(queries.damaged_conversations(df), absent=F.col("absent")).orderBy("piece", "place").collect()
    want = {r[0]: r[8] for r in by_hand(rows)}
    found = {}
    for r in got:
        found.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(found.get(c, [])).encode()).hexdigest() for c in want} == want


def test_pieces_agree_with_a_whole():
    """Costs and audits of a conversation do not depend on where it is cut."""
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(0, 12)
        initials, gone, cut = [rng.choice("suaax") for _ in range(n)], [rng.random() < 0.2 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        whole = conversations.Piece(initials, gone, cut)
        cost = whole.climb(conversations.ENDS, True, conversations.START)[0]
        audit, _ = whole.trace(conversations.START, cost, conversations.ENDS, True)
        k = rng.randint(0, n)
        first, last = (conversations.Piece(initials[s], gone[s], cut[s]) for s in (slice(0, k), slice(k, n)))
        ends = last.climb(conversations.ENDS, True, 15)
        through = first.climb(ends, False, conversations.START)[0]
        head, state = first.trace(conversations.START, through, ends, False)
        tail, _ = last.trace(state, ends[conversations.STATES.index(state)], conversations.ENDS, True)
        assert (through, head + tail) == (cost, audit)
