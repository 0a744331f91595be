"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship, sliced

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed one-to-one mix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of each run of ``size`` codes: prefix sums of codes times powers."""
    n = len(codes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    room = 1 << max(10, n.bit_length())
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * _powers(_ODD, room)[:n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * _powers(_INVERSE, room)[: n - size + 1])


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` numbers, by doubling."""
    have = 1
    out = x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1]) if have < width else out


class Windows:
    """Word codes, anchors and window hashes of texts; word codes are kept between texts."""

    def __init__(self, size: int, anchor: int):
        self.size, self.anchor, self.codes = size, min(anchor, size), {}

    def words(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        import xxhash

        words = (text or "").encode().split()
        if len(self.codes) > 400_000:
            self.codes.clear()
        codes, digest = self.codes, xxhash.xxh64_intdigest
        for w in set(words).difference(codes):
            codes[w] = digest(w)
        return words, np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))

    def anchors(self, codes: np.ndarray) -> np.ndarray:
        """For each window: the smallest hash of the ``anchor`` words runs in it."""
        if len(codes) < self.size:
            return np.zeros(0, dtype=np.uint64)
        return least_of(rolled(codes, self.anchor), self.size - self.anchor + 1)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.uint64).view(np.int64), pa.int64()))


def window_removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, anchor: int = 10) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for each row; spans: removed word intervals [start, end).

    A word goes when a window of ``size`` words that covers it also starts, word for word, in a
    document with a smaller doc_id; overlapping windows merge into maximal intervals. All windows
    of all documents take part; only the work on those that can't repeat is saved, in two exact steps:

    1. Rows with the same words as one with a smaller id lose all they have (if it is a window at
       least), and add nothing for others.
    2. The smallest hash of the runs of ``anchor`` words in a window is its anchor. Equal windows
       have equal anchors, so a window whose anchor only one document has is unique. Anchors, about
       one for 20 windows, are counted first.

    The windows left are counted by two independent 64-bit Rabin-Karp hashes. Hot anchors and
    windows are summed before they are shuffled, and their joins are split by Spark's skew join.

    Null text: no words. Null doc_id: larger than any other; such rows don't precede each other.
    Repeated rows and rows with equal ids don't precede each other; each is returned. Empty table: no
    rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    last = (1 << 63) - 1

    def facts(batches):
        made = Windows(size, anchor)
        for batch in sliced(batches):
            counts, digests, anchors = [], [], []
            for text in batch.column(2).to_pylist():
                words, codes = made.words(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(np.unique(made.anchors(codes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), _longs(anchors)], ["doc_id", "at", "n_words", "sha", "anchors"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("at"), F.col(text_col).alias("text"))
    every = keep(rows.mapInArrow(facts, "doc_id long, at long, n_words long, sha binary, anchors array<long>"))
    long = every.where(F.col("n_words") >= size)
    first = keep(long.groupBy("sha").agg(F.min("at").alias("at")))
    own = long.select("at", "sha", "anchors").join(first, ["at", "sha"], "left_semi")
    own = keep(own.select("at", "sha", F.explode("anchors").alias("anchor")))
    shared = own.groupBy("anchor").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    shared = keep(shared.where("lo < hi").select("anchor"))
    asked = own.join(shared, "anchor").groupBy("at", "sha").agg(F.collect_set("anchor").alias("wanted"))
    asked = keep(asked)

    def windows(batches):
        made = Windows(size, anchor)
        for batch in sliced(batches):
            ats, shas, texts, firsts, seconds, starts = [], [], [], [], [], []
            for at, text, wanted, sha in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted"), batch.column("sha").to_pylist()):
                words, codes = made.words(text)
                if hashlib.sha256(b" ".join(words)).digest() != sha:  # another text with this id
                    continue
                wanted = wanted.values.to_numpy().view(np.uint64)
                start = np.nonzero(np.isin(made.anchors(codes), wanted))[0]
                ats.append(at)
                shas.append(sha)
                texts.append(b" ".join(words).decode())
                firsts.append(rolled(codes, size)[start])
                seconds.append(rolled(mixed(codes), size)[start])
                starts.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(shas, pa.binary()), pa.array(texts, pa.string()), _longs(firsts), _longs(seconds), _longs(starts)], ["at", "sha", "words", "h1", "h2", "start"])

    texts = rows.select("at", "text").join(asked, "at")
    near = keep(texts.mapInArrow(windows, "at long, sha binary, words string, h1 array<long>, h2 array<long>, start array<long>"))
    each = near.select("at", "sha", F.explode(F.arrays_zip("h1", "h2", "start")).alias("w")).select("at", "sha", "w.h1", "w.h2", "w.start")
    twice = each.groupBy("h1", "h2").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    twice = keep(twice.where("lo < hi").select("h1", "h2", "lo"))
    later = each.join(twice, ["h1", "h2"]).where("at > lo").groupBy("at", "sha").agg(F.sort_array(F.collect_list("start")).alias("start"))

    def cut(batches):
        for batch in sliced(batches):
            spans, gone, kept = [], [], []
            for text, start in zip(batch.column("words").to_pylist(), batch.column("start")):
                words, s = text.split(" "), start.values.to_numpy()
                begins = s[np.r_[True, s[1:] > s[:-1] + size]]
                ends = s[np.r_[s[1:] > s[:-1] + size, True]] + size
                left, at = [], 0
                for b, e in zip(begins.tolist(), ends.tolist()):
                    left += words[at:b]
                    at = e
                left += words[at:]
                spans.append([{"start": b, "end": e} for b, e in zip(begins.tolist(), ends.tolist())])
                gone.append(len(words) - len(left))
                kept.append(hashlib.sha256(" ".join(left).encode()).digest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("sha"), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["at", "sha", "gone", "left", "spans"])

    found = near.select("at", "sha", "words").join(later, ["at", "sha"])
    removed = keep(found.mapInArrow(cut, "at long, sha binary, gone long, left binary, spans array<struct<start:long,end:long>>").dropDuplicates(["at", "sha"]))
    firsts = first.withColumnRenamed("at", "first_at")
    out = every.select("doc_id", "at", "n_words", "sha").join(firsts, "sha", "left").join(removed, ["at", "sha"], "left")
    copy = F.coalesce(F.col("first_at") < F.col("at"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.unhex(F.sha2(F.lit(""), 256))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(copy, none).otherwise(F.coalesce("left", "sha")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
    )
