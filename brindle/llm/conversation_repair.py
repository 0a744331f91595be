"""Conversation structure repair: rows, edits and role order as automata, composed lazily; cheapest path by (cost, labels)."""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, ship

SPACES = " \t\n\x0b\x0c\r"
#: Rows (a default), and characters of them, that one chunk of a conversation holds; longer conversations are chains of chunks.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 20

#: Acceptor of the role initials (s?(ua)+)?: arcs of each state, state 0 first, 0 and 3 final.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Roles that an edit may write, by initial.
WRITTEN = {"u": "user", "a": "assistant"}
#: Edit transducer, arcs without input: (label, initial written, cost).
INSERTS = tuple(("I", out, 2) for out in WRITTEN)
#: Adjacent initials that are in order.
LEGAL = ("su", "ua", "au")
FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated"}


@functools.cache
def edits(symbol: str) -> tuple[tuple[str, str | None, int], ...]:
    """Edit transducer, arcs that read one row: (label, initial written or None, cost). A symbol is the row's initial and its fault, '-' for none."""
    initial, fault = symbol
    if fault in "bd":
        return (("D", None, 3),)
    more = int(fault == "t")
    return (("D", None, 3), ("K", initial, more), *(("R", out, 2 + more) for out in WRITTEN))


def _relax(to: dict, state: int, weight: tuple[int, str]) -> None:
    if state not in to or weight < to[state]:
        to[state] = weight


def _layers(now: dict) -> list[dict]:
    """States reached by 0, 1, 2, ... inserts. No more of them than grammar states: a longer run meets a state again at a higher cost."""
    layers = [now]
    for _ in range(len(GRAMMAR) - 1):
        after: dict[int, tuple[int, str]] = {}
        for q, (cost, labels) in layers[-1].items():
            for label, out, more in INSERTS:
                if out in GRAMMAR[q]:
                    _relax(after, GRAMMAR[q][out], (cost + more, labels + label))
        layers.append(after)
    return layers


@functools.lru_cache(1 << 14)
def paths(symbols: tuple[str, ...], entry: int) -> dict[int, tuple[int, str]]:
    """For each grammar state reached after all rows, the least (cost, labels) from ``entry``.

    States of the composition are (rows read, inserts since the last row, grammar state), made as they are
    reached and met in that order. The least of two label strings stays the least whatever follows: labels of one
    cost that end with the same row's label are never the beginning of one another.
    """
    now = {entry: (0, "")}
    for symbol in symbols:
        after: dict[int, tuple[int, str]] = {}
        for layer in _layers(now):
            for q, (cost, labels) in layer.items():
                for label, out, more in edits(symbol):
                    if out is None:
                        _relax(after, q, (cost + more, labels + label))
                    elif out in GRAMMAR[q]:
                        _relax(after, GRAMMAR[q][out], (cost + more, labels + label))
        now = after
    return now


def closed(state: int) -> tuple[int, str]:
    """The least (cost, labels) of inserts that end a conversation in ``state``."""
    return min(layer[q] for layer in _layers({state: (0, "")}) for q in layer if q in FINAL)


def rewritten(rows: list[tuple[str, str]], labels: str, entry: int) -> list[str]:
    """The lines ``role:text`` that the labels make of rows (role, text)."""
    at, state, out = 0, entry, []
    for label in labels:
        role, text = rows[at] if label != "I" else ("", "")
        at += label != "I"
        if label == "D":
            continue
        if label in "IR":
            role = next(r for i, r in WRITTEN.items() if i in GRAMMAR[state])
        state = GRAMMAR[state][role[:1]]
        out.append(f"{role}:{text}")
    return out


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, mid, copy, role, text, gone): rows after the damage drawn by crc32(conv:turn) % 20; a dropped row stays, marked gone."""
    rows = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("mid"),
    )
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("draw", F.crc32(F.concat(part("conv"), F.lit(":"), part("turn"))) % 20)
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", "mid", F.explode(copies).alias("copy"), F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"), (F.col("draw") == 0).alias("gone"),
    )


def faulted(rows: DataFrame) -> DataFrame:
    """rows with ``fault``: b, d, t, '-' for none, or x for a dropped row.

    Only (conversation, role, text) met at several rows are joined back, by digest, so that a text repeated
    without end is one row on the other side and Spark may split it.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = bare == ""
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")))
    rows = rows.withColumns({"key": key, "blank": blank})
    met = rows.where("not gone and not blank and copy = 0").groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("turn", "mid")).alias("first"))
    met = keep(met.where("many > 1").select("key", F.col("first.mid").alias("first")))
    seen = (F.col("copy") == 1) | (F.col("mid") != F.col("first"))
    fault = F.when(F.col("gone"), "x").when(F.col("blank"), "b").when(seen, "d").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    return rows.join(met, "key", "left").select("conv", "turn", "mid", "copy", "role", "text", fault.alias("fault"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Chunk:
    """Rows of one conversation in order, as many as a chunk holds."""

    def __init__(self, most: int):
        self.most, self.rows, self.symbols, self.chars = most, [], [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns = [None, None, 0]  # first, last, distinct
        self.ends = ["", ""]  # initials of the first and last row

    def add(self, turn, role, text, fault) -> None:
        if fault == "x":
            return
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        initial = role[:1]
        if self.rows:
            self.counts["illegal"] += self.ends[1] + initial not in LEGAL
        else:
            self.ends[0] = initial
        self.ends[1] = initial
        if fault in FAULTS:
            self.counts[FAULTS[fault]] += 1
        self.rows.append((role, text))
        self.symbols.append((initial if initial in "sua" and initial else "o") + fault)
        self.chars += len(role) + len(text)

    def full(self) -> bool:
        return len(self.rows) >= self.most or self.chars >= CHUNK_CHARS


def _gaps(first, last, distinct) -> int:
    return 0 if first is None else last - first + 1 - distinct


def _digest(lines) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PART = "seg int, idx int, n long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, weights array<long>, ranks array<int>, roles array<string>, texts array<string>, symbols array<string>"


def _whole(c: _Chunk) -> dict:
    (cost, labels), _ = min((((w + closed(q)[0]), s + closed(q)[1]), q) for q, (w, s) in paths(tuple(c.symbols), 0).items())
    return {**c.counts, "gaps": _gaps(*c.turns), "cost": cost, "audit": labels, "repaired_sha256": _digest(rewritten(c.rows, labels, 0))}


def _part(c: _Chunk, seg: int, idx: int) -> dict:
    """A chunk as a four by four matrix of weights; labels only by their rank, as the rows are there to make them again."""
    found = {(p, q): w for p in range(len(GRAMMAR)) for q, w in paths(tuple(c.symbols), p).items()}
    order = {s: k for k, s in enumerate(sorted({s for _, s in found.values()}))}
    cells = [(p, q) for p in range(len(GRAMMAR)) for q in range(len(GRAMMAR))]
    return {
        **c.counts, "seg": seg, "idx": idx, "n": len(c.rows), "first_turn": c.turns[0], "last_turn": c.turns[1], "turns": c.turns[2], "first_initial": c.ends[0], "last_initial": c.ends[1],
        "weights": [found[x][0] if x in found else -1 for x in cells], "ranks": [order[found[x][1]] if x in found else -1 for x in cells],
        "roles": [r for r, _ in c.rows], "texts": [t for _, t in c.rows], "symbols": c.symbols,
    }


def _folder(schema: pa.Schema, most: int):
    """Sorted rows to results of conversations that are whole in one chunk here, and chunks of the others.

    The first and the last conversation of a partition may go on in another one, so they are chunks.
    """

    def fold(batches):
        seg, idx, out = TaskContext.get().partitionId(), 0, []
        conv, chunk, first, split = None, None, True, False

        def put(row):
            out.append({"conv": conv, "whole": "cost" in row} | row)

        for batch in batches:
            names = ("conv", "turn", "role", "text", "fault")
            for c, *row in zip(*(batch.column(n).to_pylist() for n in names)):
                if chunk is None or c != conv:
                    if chunk is not None:
                        if first or split:
                            put(_part(chunk, seg, idx))
                            idx += 1
                        else:
                            put(_whole(chunk))
                        first = False
                    conv, chunk, split = c, _Chunk(most), False
                elif chunk.full():
                    put(_part(chunk, seg, idx))
                    idx, chunk, split = idx + 1, _Chunk(most), True
                chunk.add(*row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if chunk is not None:
            put(_part(chunk, seg, idx))
            yield pa.RecordBatch.from_pylist(out, schema)

    return fold


def _chain(table: pa.Table) -> pa.Table:
    """All chunks of one conversation, without their rows: the path's state before and after each, and the totals beside the last.

    Sixteen weights stand for the rows of a chunk, so that a conversation of a billion rows is a million rows here.
    """
    table = table.sort_by([("seg", "ascending"), ("idx", "ascending")])
    rows = table.to_pylist()
    k = len(GRAMMAR)
    ahead = [(closed(q)[0], ()) for q in range(k)]
    picks = []
    for r in reversed(rows):  # the least from each state to the end; equal costs are told apart by the labels of this chunk
        best = [min((r["weights"][p * k + q] + ahead[q][0], r["ranks"][p * k + q], q) for q in range(k) if r["weights"][p * k + q] >= 0) for p in range(k)]
        picks.append([b[2] for b in best])
        ahead = [(b[0], ()) for b in best]
    cost, state, entry, left = ahead[0][0], 0, [], []
    for pick in reversed(picks):
        entry.append(state)
        state = pick[state]
        left.append(state)
    sums = {c: sum(r[c] for r in rows) for c in COUNTS}
    low = high = ends = None
    distinct = 0
    for r in rows:
        if r["first_turn"] is not None:
            distinct += r["turns"] - (r["first_turn"] == high)
            low, high = (r["first_turn"] if low is None else low), r["last_turn"]
        if r["n"]:
            sums["illegal"] += ends is not None and ends + r["first_initial"] not in LEGAL
            ends = r["last_initial"]
    last = len(rows) - 1
    totals = {**sums, "gaps": _gaps(low, high, distinct), "cost": cost}
    cols = {"seg": table["seg"], "idx": table["idx"], "entry": pa.array(entry, pa.int32()), "exit": pa.array(left, pa.int32()), "last": pa.array([i == last for i in range(len(rows))])}
    return pa.table(cols | {c: pa.array([v if i == last else None for i in range(len(rows))], pa.int64()) for c, v in totals.items()})


_LINE = "seg int, idx int, at int, line string, labels string, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _liner(schema: pa.Schema):
    """Chunks with their states to repaired lines; labels and totals beside the chunk's row number -1, its first."""

    def lines(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                labels = paths(tuple(r["symbols"]), r["entry"])[r["exit"]][1] + (closed(r["exit"])[1] if r["last"] else "")
                head = {n: r[n] for n in schema.names if n in r} | {"at": -1, "labels": labels}
                made = [{"conv": r["conv"], "seg": r["seg"], "idx": r["idx"], "at": k, "line": x} for k, x in enumerate(rewritten(list(zip(r["roles"], r["texts"])), labels, r["entry"]))]
                yield pa.RecordBatch.from_pylist([head, *made], schema)

    return lines


def _hasher(schema: pa.Schema):
    """Lines in order to one row for each conversation; a conversation goes by line for line, never whole."""

    def hash_(batches):
        conv, state, out = None, None, []

        def done():
            sha, audit, totals = state[0], state[1], state[3]
            return {"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest(), **totals}

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv"] != conv:
                    if state is not None:
                        out.append(done())
                    conv, state = r["conv"], [hashlib.sha256(), [], False, {}]
                if r["at"] < 0:
                    state[1].append(r["labels"])
                    if r["last"]:
                        state[3] = {n: r[n] for n in ("gaps", *COUNTS, "cost")}
                    continue
                state[0].update((("\n" if state[2] else "") + r["line"]).encode())
                state[2] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if state is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    return hash_


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def order_of_rows() -> list[Column]:
    """By conversation and turn, nulls first; ties by role, the text's first 256 characters, its MD5. Equal rows come in any order."""
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 256), F.md5("text"), F.col("mid"), F.col("copy")]


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv, turn, mid, copy, role, text, fault).

    One range shuffle puts all rows in order. A conversation within one partition is repaired there; of one that
    runs over partitions or chunks, the chunks' weight matrices are chained, and its lines then stream through one
    task, as SHA-256 reads them in order.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema["conv"].dataType.simpleString()
    out = f"conv {kind}, whole boolean, {_RESULT}, {_PART}"
    ordered = rows.repartitionByRange(*order_of_rows()).sortWithinPartitions(*order_of_rows()).select("conv", "turn", "role", "text", "fault")
    folded = keep(ordered.mapInArrow(_folder(_arrow(spark, out), chunk_rows), out))
    result = ["conv", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    whole = folded.where("whole").select(*result)
    parts = folded.where("not whole")
    light = parts.select("conv", "seg", "idx", "n", *COUNTS, "first_turn", "last_turn", "turns", "first_initial", "last_initial", "weights", "ranks")
    chained = light.groupBy("conv").applyInArrow(_chain, "seg int, idx int, entry int, exit int, last boolean, blank long, duplicate long, truncated long, illegal long, gaps long, cost long")
    states = parts.select("conv", "seg", "idx", "roles", "texts", "symbols").join(keep(chained), ["seg", "idx"])
    line, last = f"conv {kind}, {_LINE}", f"conv {kind}, {_RESULT}"
    lines = states.mapInArrow(_liner(_arrow(spark, line)), line).repartition("conv").sortWithinPartitions("conv", "seg", "idx", "at")
    return whole.unionAll(lines.mapInArrow(_hasher(_arrow(spark, last)), last).select(*result))


def conversation_repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    Null role or text: one space, so such a text is blank and such a role has to be rewritten or deleted. Null
    turn: first, in no gap. Null conv_id: a conversation of its own. Roles go by their first character, letter
    case kept. Rows of one turn: by role, then text (see order_of_rows); repeated rows are duplicates after
    the first. All rows dropped: zeros, an empty audit, the hash of nothing. Very long texts and conversations:
    whole, in chunks. Empty table: no rows. Other columns are not read, whatever their names.
    """
    rows = keep(damaged(conversations, conv_id, turn, role, text))
    return repair(faulted(rows), chunk_rows).withColumnRenamed("conv", "conv_id")
