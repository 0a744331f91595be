"""Near copies by five-word shingles: Jaccard similarity of 0.8 or more, found by MinHash bands and decided exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, keep, maybe_in, ship, signed, sliced

SIZE = 5
LEAST = 0.8
#: Bands and hashes in each: a pair of similarity 0.8 shares no band once in 140,000.
BANDS, ROWS = 30, 5
#: Most sets that one task compares in one go; larger groups are cut into blocks.
BLOCK = 256


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of a shorter text one of all its words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(w), 42) for w in zip(*(words[i:] for i in range(size)))], dtype="<u8"))


def band_keys(found: np.ndarray, turns: np.ndarray) -> list[int]:
    """Of each band a hash of its number and its MinHash values; none without shingles."""
    import xxhash

    if not len(found):
        return []
    least = np.full(turns.shape[1], np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        mixed = found[at : at + 512] ^ turns[0][:, None]
        mixed *= turns[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return [signed(xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b)) for b in range(BANDS)]


def _turns() -> np.ndarray:
    drawn = np.random.default_rng(7).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
    drawn[1] = drawn[1] * np.uint64(2) + np.uint64(1)  # odd, so that each is a permutation
    return drawn


def _sketch(batches):
    """(node, text) to (node, copy, n, bands); copy is a hash of the whole set."""
    import xxhash

    turns = _turns()
    for batch in sliced(batches):
        cols: list[list] = [[], [], []]
        for text in batch.column(1).to_pylist():
            found = shingles(text)
            for col, x in zip(cols, (signed(xxhash.xxh64_intdigest(found.tobytes(), 1)), len(found), band_keys(found, turns))):
                col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["node", "copy", "n", "bands"])


def _sets(batches):
    for batch in sliced(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "found"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def _pairs(batches):
    """(a, b, x, y) to the links (a, b) of those whose sets x and y are similar."""
    for batch in sliced(batches, 200):
        near = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _cells(batches):
    """For each cell of members (node, root, found): links of similar members whose roots are not yet one."""
    for batch in sliced(batches, 1):
        a, b = [], []
        for cell in batch.column(0).to_pylist():
            sets = [np.frombuffer(m["found"], "<u8") for m in cell]
            root = [m["root"] for m in cell]
            for i in range(len(cell)):
                for j in range(i):
                    if root[i] != root[j] and similar(sets[i], sets[j]):
                        a.append(cell[i]["node"])
                        b.append(cell[j]["node"])
                        old, new = root[i], root[j]
                        root = [new if x == old else x for x in root]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar_links(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs with Jaccard similarity of at least 0.8.

    texts: (node, text), one text for a node; rows may be repeated. Equal sets link first and go on as one.
    Sets that share a band are candidates: in each band the smallest node is held against all others
    exactly; then, only where members of a band are still parted, all of them against each other in
    blocks, so that no task holds more and no table of all pairs is made.
    """
    ship(texts.sparkSession)
    seen = keep(texts.mapInArrow(_sketch, "node long, copy long, n long, bands array<long>"))
    one = keep(seen.groupBy("copy").agg(F.min("node").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    copies = seen.join(one.select("copy", "first"), "copy").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    put = one.select(F.col("first").alias("node"), "n", F.explode("bands").alias("band"))
    met = put.groupBy("band").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("node", "n")).alias("low"))
    met = keep(met.where("many > 1"))  # few: with its true size known, Spark can spare the bands a second shuffle
    member = keep(put.join(met, "band"))
    near = F.least("n", "low.n") >= LEAST * F.greatest("n", "low.n")
    star = keep(member.where(F.col("node") != F.col("low.node")).where(near).select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct())
    want = keep(member.where("many > 2").select("node").unionAll(star.select("a")).unionAll(star.select("b")).distinct())
    asked = maybe_in(texts.select("node", "text"), want, ["node"]).where("maybe").select("node", "text")
    sets = keep(asked.dropDuplicates(["node"]).join(want, "node", "left_semi").mapInArrow(_sets, "node long, found binary"))
    pairs = star.join(sets.withColumnsRenamed({"node": "a", "found": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "found": "y"}), "b")
    links = keep(pairs.select("a", "b", "x", "y").mapInArrow(_pairs, "a long, b long"))
    roots = keep(components(links))
    left = member.where("many > 2").join(roots, "node", "left").select("band", "many", "node", F.coalesce("root", "node").alias("root"))
    left = keep(left)
    parted = left.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    left = left.join(keep(parted), "band", "left_semi")
    left = left.withColumn("blocks", F.when(F.col("many") <= block, 1).otherwise(F.ceil(2 * F.col("many") / block)).cast("int"))
    left = left.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = left.groupBy("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    cells = cell.agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("members")).where("size(members) > 1").select("members").distinct()
    cells = keep(cells.select(F.monotonically_increasing_id().alias("cell"), "members"))
    each = cells.select("cell", F.explode("members").alias("m")).select("cell", "m.*").join(sets, "node")
    more = each.groupBy("cell").agg(F.collect_list(F.struct("node", "root", "found")).alias("members")).select("members").mapInArrow(_cells, "a long, b long")
    return copies.unionAll(links).unionAll(more)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row for each group of near copies, that with the smallest doc_id, a null one last. Same columns. Needs doc_id and text.

    Texts link that are similar (see similar_links) or whose SimHash fingerprints link (see simhash_groups).
    Null texts: as empty, copies of each other. Repeated rows, and several texts of a group under one id: one
    stays. Very long texts: whole. Empty table: no rows. Other columns are carried.
    """
    texts = docs.select(simhash.text_key().alias("node"), "text")
    prints = keep(simhash.fingerprints(texts, "node"))
    alike = prints.join(simhash.simhash_groups(prints), "fp").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    return simhash.stay_one(docs, keep(components(keep(alike.unionAll(similar_links(texts))))))
