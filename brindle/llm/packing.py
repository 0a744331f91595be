"""Best-fit packing by exact complements: gaps are filled by one, two or three lengths that sum to them."""

from __future__ import annotations

import sys
import zlib
from array import array
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ship, sliced

_PIECES = "doc_id long, rid long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a Python worker keeps between tasks, at most.
_MOST_KEPT = 400_000


def pack_ids(ids) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Ids:
    """Token ids of texts as packed 32-bit numbers, word by word.

    The tokenizer drops white space and never joins what it parts, so that a text's ids are
    those of its words in turn; ids of words seen before are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        """Look up the words' ids. Letters before final points and commas are a token run of their own, whatever their case."""
        if len(self.kept) + len(words) > _MOST_KEPT:
            self.kept.clear()
        kept, parts, need, odd, model = self.kept, [], set(), [], self.tokenizer.model.tokenize
        for w in words.difference(kept):
            core = w.rstrip(b".,")
            if core.isalpha() or core and not core.isascii() and normalize("NFC", core.decode()).lower().isalpha():
                low = core.lower()
                if low != w:
                    parts.append((w, low, w[len(core) :]))
                if low not in kept:
                    if low.isascii():
                        kept[low] = pack_ids(t.id for t in model(low.decode()))
                    else:
                        need.add(low)
            else:
                odd.append(w)
        self._encode_runs(list(need))
        for w in odd:
            kept[w] = pack_ids(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids)
        for w, low, tail in parts:
            if tail and tail not in kept:
                kept[tail] = pack_ids(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids)
            kept[w] = kept[low] + kept[tail] if tail else kept[low]

    def _encode_runs(self, new: list[bytes], at_once: int = 1024) -> None:
        """Encode runs of letters beyond ASCII, joined by spaces: each is one run of the tokenizer too, and its last token ends a word."""
        for i in range(0, len(new), at_once):
            part = new[i : i + at_once]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                self.kept[w] = raw[at:end]
                at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        self.learn(set().union(*split))
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(1)
def ids_by(path: str) -> Ids:
    """One for a Python worker, so that tasks neither load the file again nor hold it twice."""
    return Ids(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, rid, piece, start, length, ids_crc32): each row's ids and an end id, cut where longer than ``room``."""
    tail = int(end).to_bytes(4, "little")

    def work(batches):
        ids = ids_by(tokenizer)
        for batch in sliced(batches, 100):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids.encode(batch.column(2).to_pylist())):
                raw += tail
                for k, at in enumerate(range(0, len(raw), 4 * room)):
                    part = raw[at : at + 4 * room]
                    for x, v in zip(out, (doc_id, rid, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, _PIECES)


def plan(counts: dict[int, int], room: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, how many sequences are filled so) that use up all counts.

    The longest length left opens sequences. Their gap is filled by an exact complement: one length
    of it, else a pair, else a triple that sums to it, looked up in the index of lengths available; as
    many sequences at once as the counts allow. Where no complement exists, the longest length that
    fits goes in and the smaller gap is looked up again. Every step empties a length or ends a gap, so
    that steps grow with the number of different lengths, at most ``room``, not with the documents.
    """
    left = np.zeros(room + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    made: list[tuple[tuple[int, ...], int]] = []

    def complement(gap: int) -> tuple[int, ...]:
        have = left[: gap + 1] > 0
        if have[gap]:
            return (gap,)
        pair = have[1:gap] & have[1:gap][::-1]
        if gap % 2 == 0 and left[gap // 2] < 2:
            pair[gap // 2 - 1 :][:1] = False
        if pair.any():
            a = int(np.flatnonzero(pair)[-1]) + 1
            return (a, gap - a)
        some = np.flatnonzero(have)
        for a in some[some < gap][::-1].tolist():
            rest = gap - a
            if 3 * a < gap:
                break
            both = have[1:rest] & have[1:rest][::-1]
            both[a:] = False  # the first is the longest
            both[: max(0, rest - a - 1)] = False
            for b in (np.flatnonzero(both) + 1)[::-1].tolist():
                used = np.bincount([a, b, rest - b], minlength=gap + 1)
                if (left[: gap + 1] >= used)[[a, b, rest - b]].all():
                    return (a, b, rest - b)
        return ()

    top = room
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return made
        left[top] -= 1
        filling, gap = [top], room - top
        while gap:
            add = complement(gap)
            if not add:
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                add = (int(fits[-1]) + 1,)
            filling += add
            for x in add:
                left[x] -= 1
            gap -= sum(add)
        used = np.bincount(filling, minlength=room + 1)
        at = np.flatnonzero(used)
        more = int((left[at] // used[at]).min())
        left[at] -= more * used[at]
        made.append((tuple(filling), 1 + more))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = 2048, end: int = 0, per_bucket: int = 1 << 16) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    Only the counts of the at most ``room`` lengths go to the driver, where plan() decides the
    fillings; that plan, bounded by ``room`` too, goes back to the tasks. Pieces of a length are
    numbered in hash buckets whose sizes are summed first, so that a hot length is never in one task;
    their number grows with the pieces, so that a bucket has about ``per_bucket`` of them at most.

    Null text: empty, a piece with the end id alone. Null ids, repeated rows: each row is packed.
    Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = keep(pieces(docs, tokenizer, id_col, text_col, room, end))
    buckets = max(32, -(-cut.count() // per_bucket))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("rid", "piece"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keep(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``room`` rows
    froms, sequences, offsets = [], [], []
    taken: dict[int, int] = {}
    sequence = 0
    for filling, times in plan(counts, room):
        offset = 0
        for length in filling:
            rank = taken.get(length, 0)
            taken[length] = rank + times
            froms.append((length << 48) + rank)
            sequences.append(sequence)
            offsets.append(offset)
            offset += length
        sequence += times
    order = np.argsort(np.array(froms, dtype=np.int64))
    froms, sequences, offsets = (np.array(x, dtype=np.int64)[order] for x in (froms, sequences, offsets))

    def place(batches):
        for batch in batches:
            key = (batch.column("length").to_numpy() << 48) + batch.column("rank").to_numpy()
            at = np.searchsorted(froms, key, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequences[at] + key - froms[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    inside = Window.partitionBy("length", "bucket").orderBy("rid", "piece")
    ranked = cut.withColumn("rn", F.row_number().over(inside)).join(sizes.select("length", "bucket", "base"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", (F.col("base") + F.col("rn") - 1).cast("long")).drop("base", "rn", "bucket")
    ship(spark)
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
