"""Embedding whitening: exact sums of integer products by digit slices, merged as integers, then eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship, sliced
from .embedding_dedup import by_size

#: Entries as integers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Bits of a limb, limbs of a long, and rows multiplied at once: sums of products of two limbs stay below 2^53, where doubles are exact.
LIMB, LIMBS, STRIP = 20, 4, 4096
#: Components that a row gets.
COMPONENTS = 8
#: Partial sums that one group of the merge adds up, and entries of a matrix that one of its rows holds.
FAN_IN, ENTRIES = 64, 1 << 18
#: Eigenvalues below this share of the largest are taken as zero: no direction can be told there.
NOTHING = 1e-26
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as int64; what a long can't hold is held at its ends."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    inside = np.abs(scaled) < 2.0**62
    out = np.where(inside, scaled, 0).astype(np.int64) + SHIFT
    out[~inside] = [min(_HIGH, max(_LOW, int(v) + SHIFT)) if np.isfinite(v) else (_HIGH if v > 0 else _LOW) for v in scaled[~inside].tolist()]
    return out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """int64 values as float64 limbs, the least first: x = sum of limb k * 2^(20 k). All but the top one lie in [0, 2^20); none above the last that is needed."""
    out, rest = [], x
    while len(out) < LIMBS - 1 and (rest >> LIMB).any():
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def gram(x: np.ndarray) -> dict[int, np.ndarray]:
    """x.T @ x as {power k: int64 matrix}: the product is their sum, each times 2^(20 k). At most STRIP rows."""
    parts, out = limbs(x), {}
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out[i + j] = out.get(i + j, 0) + (a.T @ b).astype(np.int64)
    return out


def halves(m: np.ndarray) -> np.ndarray:
    """int64 as (low 32 bits, what is above), so that two thousand million of them can be added up without overflow."""
    return np.stack([m & 0xFFFFFFFF, m >> 32])


def whole(m: np.ndarray) -> np.ndarray:
    """Sums of halves as Python integers."""
    return (m[1].astype(object) << 32) + m[0].astype(object)


def tile_rows(d: int) -> int:
    return max(1, ENTRIES // d)


_KINDS = [("d", pa.int32()), ("power", pa.int32()), ("tile", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("x", pa.binary())]
_SUMS = "d int, power int, tile int, part long, n long, x binary"


def _partial(batches):
    """Sums of a partition's vectors by size: a row for each power and tile of rows of the product; the vectors' own sums are tile -1."""
    part, counts, found = TaskContext.get().partitionId(), {}, {}
    for batch in sliced(batches, STRIP):
        for d, (_, x) in by_size(batch.column(0)).items():
            if d:
                x = integers(x)
                counts[d] = counts.get(d, 0) + len(x)
                own = {(d, k, -1): limb.sum(axis=0).astype(np.int64) for k, limb in enumerate(limbs(x))}
                for key, m in (own | {(d, k, 0): m for k, m in gram(x).items()}).items():
                    found[key] = found.get(key, 0) + halves(m)
    for (d, power, tile), m in found.items():
        step = tile_rows(d) if tile >= 0 else d
        for t in range(-(-d // step)):
            cut = np.ascontiguousarray(m[:, t * step : (t + 1) * step])
            row = {"d": d, "power": power, "tile": t if tile >= 0 else -1, "part": part, "n": counts[d] if (power, tile) == (0, -1) else 0, "x": cut.tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema(_KINDS))


def _added(table: pa.Table) -> pa.Table:
    total = 0
    for x in table["x"]:
        total = total + np.frombuffer(x.as_buffer(), np.int64)
    one = table.slice(0, 1)
    return pa.table({**{c: one[c] for c in ("d", "power", "tile", "part")}, "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "x": pa.array([total.tobytes()], pa.binary())}, pa.schema(_KINDS))


class Fit:
    """n, sums and the covariance of the integer vectors of one size, exact."""

    def __init__(self, d: int, n: int, cells: dict[tuple[int, int], np.ndarray]):
        self.d, self.n, self.cells = d, n, cells
        self.sums = sum((whole(m.reshape(2, d)) << (LIMB * k) for (k, t), m in cells.items() if t < 0), np.zeros(d, object))

    def numerators(self) -> Iterator[tuple[slice, np.ndarray]]:
        """n * sum(x x') - S S', by tiles of rows; the covariance is this over n * n."""
        step = tile_rows(self.d)
        for t in range(-(-self.d // step)):
            at = slice(t * step, min(self.d, (t + 1) * step))
            product = sum((whole(m.reshape(2, -1, self.d)) << (LIMB * k) for (k, tile), m in self.cells.items() if tile == t), np.zeros((at.stop - at.start, self.d), object))
            yield at, self.n * product - self.sums[at, None] * self.sums[None, :]

    def components(self, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(eigenvectors as columns, eigenvalues, their shares of the trace), falling. Each has its largest entry positive.

        The covariance is rounded once, from integers, and so are its eigenvalues: quotients of integers by the vectors found.
        """
        v, trace = np.zeros((self.d, self.d)), 0
        for at, m in self.numerators():
            v[at] = (m / (self.n * self.n)).astype(float)
            trace += sum(m[i, at.start + i] for i in range(len(m)))
        _, found = np.linalg.eigh(v)
        found = found[:, ::-1][:, :most]
        found = found * np.sign(found[np.abs(found).argmax(axis=0), range(found.shape[1])])
        fixed = np.array([[int(c) for c in row] for row in np.rint(found * 2.0**60)], dtype=object).reshape(found.shape)
        quadratic = sum((fixed[at] * m.dot(fixed)).sum(axis=0) for at, m in self.numerators())
        square = (fixed * fixed).sum(axis=0)
        e = np.array([q / (s * self.n * self.n) for q, s in zip(quadratic, square)])
        share = np.array([q / (s * trace) if trace else 0.0 for q, s in zip(quadratic, square)])
        order = np.argsort(-e, kind="stable")
        return found[:, order], e[order], share[order]


def fits(vectors: DataFrame) -> dict[int, Fit]:
    """The fit of each vector size. vectors: (embedding), finite.

    Partial sums meet in a tree of groups of FAN_IN; what comes to the driver is a square of numbers for each size, whatever the rows.
    """
    sums = keep(vectors.mapInArrow(_partial, _SUMS))
    while (sums.agg(F.max("part")).first()[0] or 0) > 0:
        up = sums.withColumn("part", F.floor(F.col("part") / FAN_IN))
        sums = keep(up.groupBy("d", "power", "tile", "part").applyInArrow(_added, _SUMS))
    table = sums.toArrow()
    cells: dict[int, dict] = {}
    counts: dict[int, int] = {}
    for d, power, tile, n, x in zip(*(table[c] for c in ("d", "power", "tile", "n", "x"))):
        cells.setdefault(d.as_py(), {})[power.as_py(), tile.as_py()] = np.frombuffer(x.as_buffer(), np.int64)
        counts[d.as_py()] = counts.get(d.as_py(), 0) + n.as_py()
    return {d: Fit(d, counts[d], c) for d, c in cells.items()}


def squares(y: np.ndarray) -> list[int]:
    """Sum of squares of each row of int64 values, exact: limbs of their sizes, few enough columns at once, then big integers."""
    total = [0] * len(y)
    y = np.where(y < 0, -y, y)
    for at in range(0, y.shape[1], STRIP):
        parts = limbs(y[:, at : at + STRIP])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                for row, v in enumerate(np.einsum("ij,ij->i", a, b).tolist()):
                    total[row] += int(v) << (LIMB * (i + j))
    return total


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """x - S/n in double precision, and sum over dimensions of (n * x - S)^2, exact."""
    mean, rest = sums // n, sums % n  # both exact
    if max(map(abs, [int(x.max()), int(x.min()), *mean])) < 1 << 61:
        centred = x - mean.astype(np.int64)
        if int(np.abs(centred).max()) * n + n < 1 << 62:
            exact = squares(centred * n - rest.astype(np.int64))
            return centred - (rest / n).astype(float), exact
    y = n * x.astype(object) - sums
    return (y / n).astype(float), (y * y).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits) for each vector and component.

    Vectors that are null or hold null or non-finite entries are dropped; all others are the fit list. Entries
    become integers (see integers): covariance, eigenvalues and deviations come from exact sums of them.
    A deviation beyond a long is null; deviation_digits has its digits at any size. Vectors of unequal sizes: each size is a
    fit list of its own. Vectors shorter than ``most``: a component for each dimension; empty ones: no rows. A
    component without variance (few or equal vectors): whitened and explained 0, identity_error then 1. Entries beyond
    a long: held at its ends. Null ids and repeated rows: kept, each a vector. Very long vectors: the square of
    their size goes to the driver, in tiles. Empty table: no rows. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(x.isNotNull() & F.forall(x, finite) & (F.size(x) > 0))
    found = fits(rows.select("embedding"))
    models = {d: (fit.n, fit.sums, *fit.components(most)) for d, fit in found.items()}

    def project(batches):
        names = ["vec_id", "d", "n", "deviation", "deviation_digits", "whitened", "explained"]
        for batch in sliced(batches):
            for d, (at, x) in by_size(batch.column(1)).items():
                n, sums, u, e, share = models[d]
                centred, exact = deviations(integers(x), n, sums)
                some = e > NOTHING * max(e[0], 0)
                w = np.where(some, centred @ u / np.sqrt(np.where(some, e, 1)), 0.0)
                cols = [
                    batch.column(0).take(pa.array(at)), pa.array(np.full(len(x), d), pa.int32()), pa.array(np.full(len(x), n), pa.int64()), pa.array([v if v <= _HIGH else None for v in exact], pa.int64()),
                    pa.array(map(str, exact), pa.string()), pa.array(list(w), pa.list_(pa.float64())), pa.array([np.where(some, share, 0.0)] * len(x), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    wide = keep(rows.mapInArrow(project, "vec_id long, d int, n long, deviation long, deviation_digits string, whitened array<double>, explained array<double>"))
    k = range(most)
    pairs = [(i, j) for i in k for j in k if i <= j]
    made = wide.groupBy("d").agg(*[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs])
    errors = {r["d"]: max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < r["d"]) for r in made.collect()}  # a row for each size
    error = F.create_map(*[F.lit(v) for pair in errors.items() for v in pair])[F.col("d")] if errors else F.lit(None).cast("double")
    each = wide.select("vec_id", "n", "deviation", "deviation_digits", error.alias("identity_error"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error", "deviation_digits")
