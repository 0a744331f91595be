"""SimHash near-duplicates: deletion-variant signatures of two 32-bit segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, keep, maybe_in, null_safe, ship, signed, sliced, whole_row

#: Most fingerprints that one task compares in one go; larger groups are split, then cut into blocks.
BLOCK = 512
MAX_BITS = 3


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(w), 42) for w in zip(*(words[i:] for i in range(size)))], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def work(batches):
        for batch in sliced(batches):
            fps = [signed(fingerprint(t, size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, fp long")


def _close(batches):
    """For each cell of fingerprints: links from each one to the smallest of its group in the cell."""
    for batch in sliced(batches):
        a, b = [], []
        for cell in batch.column(0).to_pylist():
            signed_fps = np.sort(np.array(cell, dtype=np.int64))
            fps, todo = signed_fps.view(np.uint64), np.arange(len(cell))
            while len(todo):
                root, front, todo = signed_fps[todo[0]], todo[:1], todo[1:]
                while len(front) and len(todo):
                    near = np.zeros(len(todo), dtype=bool)
                    for f in front:
                        near |= np.bitwise_count(fps[todo] ^ fps[f]) <= MAX_BITS
                    front, todo = todo[near], todo[~near]
                    a += signed_fps[front].tolist()
                    b += [int(root)] * len(front)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _wildcards(bits: Column, width: int, first: int) -> list[Column]:
    """The variants of a segment of so many bits with one bit cleared each, numbered above the bits."""
    return [bits.bitwiseAND(F.lit((1 << width) - 1 - (1 << i)).cast("long")).bitwiseOR(F.lit((first + i) << width).cast("long")) for i in range(width)]


def _cells(member: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(fps): the members (keys, n, fp) of each key, in blocks that are put together two by two where n is above ``block``."""
    member = member.withColumn("blocks", F.when(F.col("n") <= block, 1).otherwise(F.ceil(2 * F.col("n") / block)).cast("int"))
    member = member.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = member.groupBy(*keys, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return cell.agg(F.array_sort(F.collect_list("fp")).alias("fps")).where("size(fps) > 1").select("fps")


def simhash_groups(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Class of each fingerprint: (fp, component_id), component_id the smallest doc_id reachable by links.

    prints: (doc_id, fp). Fingerprints link when they differ in at most three bits. Cut in two
    segments, one of them differs in at most one bit, so both have a one-wildcard variant of that
    segment in common: each distinct fingerprint is put under its 64 variants. Of a variant met twice its
    smallest and largest fingerprint are the two that may link; variants met more often are joined back, and
    their members compared bit by bit inside tasks. A variant with more than ``block`` members is
    split first by the same rule: at most three bits differ in the other segment, so in one of its halves of 16
    bits at most one, and members go under the 32 variants of these. So split, members have 46 bits in common:
    what is left of a hot variant has at most 2^18 fingerprints whatever the input, and is compared in
    blocks. Tasks return links to the smallest fingerprint of each group found, never all pairs.

    Copies count once. A null doc_id links like any other and is never the smallest; where all in reach are
    null, component_id is null.
    """
    ship(prints.sparkSession)
    one = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    put = one.select("fp", F.explode(F.array(*_wildcards(low, 32, 0), *_wildcards(high, 32, 32))).alias("variant"))
    met = keep(put.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a")).where("n > 1"))
    twos = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    more = keep(met.where("n > 2").select("variant", "n"))  # few: with its true size known, Spark can spare the variants a second shuffle
    member = put.join(more, "variant")
    cells = _cells(member.where(F.col("n") <= block), ["variant"], block)
    if not more.where(F.col("n") > block).isEmpty():
        other = F.when(F.shiftrightunsigned("variant", 32) < 32, high).otherwise(low)
        halves = [*_wildcards(other.bitwiseAND(F.lit(0xFFFF)), 16, 0), *_wildcards(F.shiftrightunsigned(other, 16), 16, 16)]
        split = keep(member.where(F.col("n") > block).select("variant", "fp", F.explode(F.array(*halves)).alias("part")))
        parts = split.groupBy("variant", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        cells = cells.unionAll(_cells(split.join(parts, ["variant", "part"]), ["variant", "part"], block))
    links = keep(cells.distinct().mapInArrow(_close, "a long, b long").unionAll(twos).distinct())
    found = one.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    found = keep(found)
    return found.select("fp", "root").join(found.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows: each is
    returned. Null doc_id: see simhash_groups. Very long texts: hashed whole, in parts of 8192 shingles.
    Empty table: no rows. Other columns are not read.
    """
    prints = keep(fingerprints(docs, id_col, text_col))
    groups = keep(simhash_groups(prints, block))
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key() -> Column:
    """What tells the texts of ``documents`` apart; null as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def stay_one(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of each group: that with the smallest doc_id, a null one last, and of its texts one. Same columns.

    roots: (node, root) by text_key(); texts that are not in it are groups of their own. Repeated rows stay once.
    Only rows that may have to go are shuffled with their texts; all others pass as they are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("node"))
    rows = rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("many"))
    rows = keep(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    stay = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node", "many")).alias("s"))
    stay = keep(stay.select("root", "s.id", "s.node", "s.many"))
    first = F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("node") == F.col("stay_node"))
    cut = rows.join(stay.select("root", F.col("id").alias("stay_id"), F.col("node").alias("stay_node")), "root").where(~first | (F.col("many") > 1))
    own = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("node"))
    own = maybe_in(own, keep(cut.select("id", "node")), ["id", "node"])
    sure = own.where(~F.col("maybe")).select("row.*")
    own = own.where("maybe").drop("maybe")
    once = sure.unionAll(null_safe(own, stay.where("many = 1").select("id", "node"), ["id", "node"], "left_semi").select("row.*"))
    twice = stay.where("many > 1").select("id", "node")
    if twice.isEmpty():
        return once
    more = null_safe(own, twice, ["id", "node"], "left_semi").groupBy("id", "node").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionAll(more.select("row.*"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row for each group of linked fingerprints, see stay_one(). Same columns. Nulls, long texts, empty tables: see simhash_dedup()."""
    prints = keep(fingerprints(docs.select(text_key().alias("node"), "text"), "node"))
    roots = prints.join(simhash_groups(prints), "fp").select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct()
    return stay_one(docs, keep(roots))
