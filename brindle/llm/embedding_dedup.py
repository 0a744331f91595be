"""Embedding near-duplicates: tiles in the order of the first principal component, compared by leading components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep, ship

#: Vectors in a tile, at most about; a task compares two tiles at a time.
TILE = 4096
#: Rows of one tile held against all of the other at once, and components of pairs gathered at once: what bounds a task's memory.
STRIP, GATHERED = 256, 1 << 22


def _matrix(column) -> np.ndarray:
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64) if len(column) else np.zeros(0)
    offsets = column.offsets.to_numpy()
    return flat[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _moments(batches):
    """Sums of products of the unit vectors' components, by vector size."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for x in by_size(batch.column(0)).values():
            x = unit(x[1])
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], ["d", "at", "x"])


def by_size(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{size: (places, vectors)} of an Arrow list column."""
    sizes = np.diff(column.offsets.to_numpy())
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = at, _matrix(column.take(pa.array(at)))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector size, an orthonormal basis as columns, most weight first. vectors: (embedding).

    The size's square of numbers goes to the driver, as Arrow columns; it does not grow with the vectors.
    """
    sums = vectors.mapInArrow(_moments, "d int, at int, x double").groupBy("d", "at").agg(F.sum("x").alias("x")).toArrow()
    d, at, x = (sums.column(n).to_numpy() for n in ("d", "at", "x"))
    found: dict[int, np.ndarray] = {}
    for size in np.unique(d).tolist():
        m = np.zeros(size * size)
        m[at[d == size]] = x[d == size]
        found[size] = np.linalg.eigh(m.reshape(size, size))[1][:, ::-1].copy()
    return found


def _suffix(p: np.ndarray) -> np.ndarray:
    """Norm of the components from each one on."""
    squares = np.cumsum((p * p)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.maximum(0, np.concatenate([squares, np.zeros((len(p), 1))], axis=1)))


def close_pairs(x: np.ndarray, y: np.ndarray, basis: np.ndarray, least: float, same: bool):
    """Yield pairs (i, j) of rows of x and y with cosine >= least, strip by strip; with same, only i < j.

    Products of leading components are summed first; a pair is dropped as soon as its sum and the
    product of the norms of what is left can't reach the threshold. What stays is tested on the
    vectors themselves in double precision. Memory: a strip of products, and GATHERED components of pairs.
    """
    norm_x, norm_y = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    px, py = (x / norm_x[:, None]) @ basis, (y / norm_y[:, None]) @ basis
    d = px.shape[1]
    cuts = sorted({min(d, c) for c in (8, 16, 32, d)})
    sx, sy = _suffix(px), _suffix(py)
    at_once = max(1, GATHERED // d)
    for at in range(0, len(x), STRIP):
        rows = slice(at, at + STRIP)
        part = px[rows, : cuts[0]] @ py[:, : cuts[0]].T
        open_ = part + np.outer(sx[rows, cuts[0]], sy[:, cuts[0]]) >= least - 1e-9
        if same:
            open_ &= np.arange(len(y))[None, :] > np.arange(at, min(at + STRIP, len(x)))[:, None]
        every_i, every_j = np.nonzero(open_)
        for k in range(0, len(every_i), at_once):
            i, j = every_i[k : k + at_once], every_j[k : k + at_once]
            sums, i = part[i, j], i + at
            for a, b in zip(cuts, cuts[1:]):
                sums = sums + np.einsum("ij,ij->i", px[i, a:b], py[j, a:b])
                stay = sums + sx[i, b] * sy[j, b] >= least - 1e-9
                i, j, sums = i[stay], j[stay], sums[stay]
            near = np.einsum("ij,ij->i", x[i], y[j]) / (norm_x[i] * norm_y[j]) >= least
            yield i[near], j[near]


class Roots:
    """Smallest index reachable, for each of n, as pairs come in."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            for at in (i, j, root[i], root[j]):  # the roots too, so that whole classes follow
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == root).all():
                self.root = root
                return
            root = new


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors of one label and size link when their cosine is at least ``least``. Equal vectors count as
    one with their number. Distinct ones are dealt into bins of the first principal component, narrower
    than the distance that the threshold allows, and bins into tiles by hash; only tiles in bins near
    enough are compared, two at a time, each in a group of its own. A group returns, for each
    vector, its number of links and the first vector of its class there, not the pairs.

    Null, empty or zero vectors, vectors with null or non-finite components and rows with a null label
    link with nothing: n_links 0, component_id their own id. Rows with a null id: linked and counted like
    others, never the smallest; their kept is false, and component_id is null where no id is in reach. Repeated rows and
    equal ids: each is a vector of its own for the others' links. Very long vectors: a task holds two tiles of
    them, so ``tile`` should shrink with their size. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fit = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    rows = keep(rows.withColumn("fit", F.coalesce(fit, F.lit(False))))
    one = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    one = keep(one.withColumn("node", F.monotonically_increasing_id()))
    bases = principal(one.select("embedding"))
    apart = (2 - 2 * least) ** 0.5
    width = apart / 4 if least < 1 else 0.01

    def first(batches):
        for batch in batches:
            bin_, size = np.zeros((2, batch.num_rows), dtype=np.int32)
            for d, (at, x) in by_size(batch.column("embedding")).items():
                bin_[at], size[at] = np.floor(unit(x) @ bases[d][:, 0] / width), d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bin_), pa.array(size)], [*batch.schema.names, "bin", "size"])

    kind = vectors.schema[label_col].dataType.simpleString()
    inner = one.schema["embedding"].dataType.simpleString()
    binned = keep(one.select("label", "embedding", "node", "weight").mapInArrow(first, f"label {kind}, embedding {inner}, node long, weight long, bin int, size int"))
    bins = binned.groupBy("label", "size", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / tile).cast("int"))
    bins = keep(bins.select("label", "size", "bin", "blocks"))
    reach = int(np.ceil(apart / width)) + 1
    tiles = bins.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    step = F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("step")
    left = tiles.select("label", "size", "bin", "block", step).withColumn("bin2", F.col("bin") + F.col("step")).drop("step")
    right = tiles.select("label", "size", F.col("bin").alias("bin2"), F.col("block").alias("block2"))
    pairs = left.join(right, ["label", "size", "bin2"]).where("bin < bin2 or block <= block2")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), b.alias("bin"), k.alias("block")) for s, b, k in ((0, F.col("bin"), F.col("block")), (1, F.col("bin2"), F.col("block2")))])).alias("t")
    name = F.struct("bin", "block", "bin2", "block2").alias("cell")
    same = (F.col("bin") == F.col("bin2")) & (F.col("block") == F.col("block2"))
    cells = pairs.select("label", "size", name, same.alias("same"), sides).where("not same or t.side = 0").select("label", "size", "cell", "same", "t.side", "t.bin", "t.block")
    dealt = binned.join(bins, ["label", "size", "bin"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    put = dealt.join(keep(cells), ["label", "size", "bin", "block"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, same = table["side"].to_numpy(), bool(table["same"][0].as_py())
        node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
        v = _matrix(table["embedding"].combine_chunks() if isinstance(table["embedding"], pa.ChunkedArray) else table["embedding"])
        v = v / np.abs(v).max(axis=1, keepdims=True)
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        links, roots = np.zeros(len(node)), Roots(len(node))
        for i, j in close_pairs(v[a], v[b], bases[v.shape[1]], least, same) if len(a) and len(b) else ():
            i, j = a[i], b[j]
            links += np.bincount(i, weights=weight[j], minlength=len(node)) + np.bincount(j, weights=weight[i], minlength=len(node))
            roots.join(i, j)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": node[roots.root[some]]})

    found = keep(put.groupBy("label", "size", "cell").applyInArrow(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = one.join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = keep(nodes.select("label", "embedding", "low", "root", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    nodes = nodes.drop("low").join(nodes.groupBy("root").agg(F.min("low").alias("low")), "root").select("label", "embedding", "n_links", F.col("low").alias("root"))
    good = rows.where("fit").join(nodes, ["label", "embedding"])
    bad = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("root"))
    out = good.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "root").unionAll(bad)
    return out.select("vec_id", "n_links", F.col("root").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("root"), F.lit(False)).alias("kept"))
