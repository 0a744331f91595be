"""Conversation repair against a plain search: all edit strings in order of cost, no automata composed, no Spark."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from brindle.llm import conversation_repair as cr

COLUMNS = "conv_id long, turn long, role string, text string, conv string, mid int, fault string"
SOUND = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        draw = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
        role = "user" if draw == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def search(rows, fault):
    """Cheapest edits, ties the least string: a heap of partial strings, dearest never reached."""
    heap = [(0, "", 0, "", [])]  # cost, labels, rows read, initials, lines
    while heap:
        cost, labels, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and SOUND.fullmatch(initials):
            return cost, labels, lines
        steps = [("I", 2, at, w) for w in ("user:", "assistant:")]
        if at < len(rows):
            _, _, role, text = rows[at]
            steps.append(("D", 3, at + 1, None))
            if fault[at] not in "bd":
                more = int(fault[at] == "t")
                steps.append(("K", more, at + 1, f"{role}:{text}"))
                steps += [("R", 2 + more, at + 1, f"{w}:{text}") for w in ("user", "assistant")]
        for label, more, to, line in steps:
            then = initials if line is None else initials + (line.split(":", 1)[0][:1] if label != "K" else rows[at][2][:1] or "-")
            if re.fullmatch("s?(ua)*u?", then):
                heapq.heappush(heap, (cost + more, labels + label, to, then, lines if line is None else [*lines, line]))


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = damage([r[:4] for r in table if r[0] == conv])
        fault = faults(rows)
        turns = {r[1] for r in rows} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, labels, lines = search(rows, fault)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(fault.count(k) for k in "bdt"), illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t", None, "é.　", "A long one. " * 50, "three"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "User", ""]
    rows = []
    for conv in [*range(60), None, -4]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(texts)))
    rows += rows[3:9]  # whole rows repeated
    rows += [(7, None, "user", None), (61, None, None, None), (9, 10**12, "assistant", "Late.")]
    return [(*r, "c", 1, "f") for r in rows]


@pytest.mark.parametrize("most", [1024, 1, 2])
def test_equals_a_plain_search(spark, table, most):
    df = spark.createDataFrame(table, COLUMNS).repartition(3)
    got = plain(cr.conversation_repair(df, chunk_rows=most))
    want = brute(table)
    assert got == want
    assert any("D" in w[6] for w in want.values()) and any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def test_empty_table_and_dropped_rows(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert cr.conversation_repair(empty).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "c", 1, "f")], COLUMNS)
    assert plain(cr.conversation_repair(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_of_most_rows_is_spread(spark):
    """A conversation over many partitions and chunks, with one text repeated: as a single chunk would repair it."""
    rows = [(1, t, ("user", "assistant")[t % 2], "Same." if t % 3 else f"Line {t}.") for t in range(3000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Say {c} {t}.") for c in range(2, 200) for t in range(2)]
    df = spark.createDataFrame([(*r, "c", 1, "f") for r in rows], COLUMNS)
    got = plain(cr.conversation_repair(df, chunk_rows=100))
    hot = damage([r for r in rows if r[0] == 1])
    symbols = tuple(r[2][0] + f for r, f in zip(hot, faults(hot)))
    cost, labels = min((c + cr.closed(q)[0], s + cr.closed(q)[1]) for q, (c, s) in cr.paths(symbols, 0).items())
    lines = cr.rewritten([(r[2], r[3]) for r in hot], labels, 0)
    assert got[1][5:] == (cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert len(got) == 199
    placed = cr.faulted(cr.damaged(df)).repartitionByRange(4, *cr.order_of_rows())
    sizes = [r["count"] for r in placed.groupBy(cr.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.45 * sum(sizes)
