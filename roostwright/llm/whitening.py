"""Embedding whitening (op 12): vectors projected on the components of their exact covariance, each scaled to variance 1.

One pass sums the integer outer products exactly (a float matrix product of blocks so small that no sum is rounded; wide numbers in
limbs). The scatter's characteristic polynomial is reduced modulo primes by Spark tasks and put together on the driver, which isolates its
roots; a task for each component finds its vectors. The driver gets sums of d x d numbers and d + 1 coefficients, whatever the number of rows. A
second pass measures the covariance of what comes out, a third writes it; none of them shuffles rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import eigen

#: Rows of a block and bits of a limb: BLOCK x (2^LIMB)^2 < 2^53, so a float matrix product of one block is exact.
BLOCK, LIMB = 4096, 20
SCALE = 64


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # of floor(64 c) for each dimension
    trace: int  # of n times the sum of products less the product of sums, as are
    values: list[float]  # its largest eigenvalues, falling, and
    vectors: list[list[float]]  # their unit vectors
    identity_error: float | None = None

    def explained(self) -> list[float]:
        return [v / self.trace for v in self.values]


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * entry) of vectors of one length, as int64; others, and entries out of its range, are an error."""
    sizes = np.unique(np.diff(np.asarray(column.offsets)))
    if len(sizes) != 1:
        raise ValueError(f"vectors of one length are needed, not of {sizes.tolist()}")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise OverflowError(f"{scale} times an entry doesn't fit a long")
    return x.astype(np.int64).reshape(len(column), int(sizes[0]))


def gram(x: np.ndarray) -> np.ndarray:
    """The sum of outer products of at most BLOCK integer rows, exact, as Python integers."""
    limbs = max(1, -(-(int(np.abs(x).max(initial=0)).bit_length() + 1) // LIMB))
    parts = [((x >> (LIMB * k)) & ((1 << LIMB) - 1) if k + 1 < limbs else x >> (LIMB * k)).astype(np.float64) for k in range(limbs)]
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out = out + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return out


def scatter(rows: DataFrame, vec_col: str) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * sum of products - product of sums) over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0), SCALE)
            s, ss = (np.zeros(x.shape[1], object), np.zeros((x.shape[1],) * 2, object)) if s is None else (s, ss)
            if x.shape[1] != len(s):
                raise ValueError(f"vectors of one length are needed, not of {len(s)} and {x.shape[1]}")
            n += len(x)
            for lo in range(0, len(x), BLOCK):
                part = x[lo : lo + BLOCK]
                s, ss = s + part.astype(object).sum(axis=0), ss + gram(part)
        if s is not None:
            d = len(s)
            i, j = np.triu_indices(d)
            at = [(-1, -1, n), *((-1, k, v) for k, v in enumerate(s)), *zip(i.tolist(), j.tolist(), ss[i, j], strict=True)]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), *(pa.array([x[k] for x in at], pa.int32()) for k in (0, 1)), pa.array([Decimal(int(x[2])) for x in at], kind)], ["d", "i", "j", "v"])

    sums = C.durable(rows.select(F.col(f"`{vec_col}`").alias("__vector")).mapInArrow(add, "d int, i int, j int, v decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("v").alias("v")), "whitening-sums")
    sizes = [r.d for r in sums.filter("i = -1 and j = -1").select("d").limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of one length are needed, not of {sizes}")
    if not sizes:
        return 0, [], []
    got = {(r.i, r.j): int(r.v) for r in sums.collect()}
    C.delete(sums)
    d, n = sizes[0], got[-1, -1]
    s = [got[-1, j] for j in range(d)]
    return n, s, [[n * got[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


def characteristic(spark, m: list[list[int]]) -> list[int]:
    """The exact characteristic polynomial of a positive semidefinite integer matrix, each prime's residues worked out by a task."""
    bits = eigen.coefficient_bits(sum(m[i][i] for i in range(len(m))), len(m)) + 1
    primes = eigen.primes_below(1 << 31, bits // 30 + 1)

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": b["id"].map(lambda i: primes[i]), "residues": [eigen.charpoly_mod(m, primes[i]) for i in b["id"]]})

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    got = spark.range(0, len(primes), 1, tasks).mapInPandas(reduce_, "p long, residues array<long>").collect()
    return eigen.remaindered({r.p: list(r.residues) for r in got})


def components(spark, m: list[list[int]], most: int) -> tuple[list[float], list[list[float]]]:
    """(eigenvalues above 0, falling; their unit vectors): the first `most`, an eigenvalue as often as its multiplicity."""
    if not m or not any(m[i][i] for i in range(len(m))):
        return [], []
    roots = eigen.ranked_roots(characteristic(spark, m), most)
    jobs = [(r.mid(), r.times) for r in roots]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, t, v) for i in b["id"] for t, v in enumerate(eigen.null_space(m, *jobs[i]))], columns=["id", "t", "v"])

    tasks = max(1, min(len(jobs), spark.sparkContext.defaultParallelism))
    got = sorted(spark.range(0, len(jobs), 1, tasks).mapInPandas(solve, "id long, t int, v array<double>").collect())[:most]
    return [float(jobs[r.id][0]) for r in got], [list(r.v) for r in got]


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - sums: longs where they fit, Python integers otherwise."""
    wide = (int(np.abs(x).max(initial=0)) * model.n + max(map(abs, model.sums), default=0)) ** 2 * max(1, x.shape[1]) >= 1 << 63
    return (x.astype(object) if wide else x) * model.n - np.array(model.sums, object if wide else np.int64)


def projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    return c.astype(np.float64) @ np.array(model.vectors).reshape(-1, c.shape[1]).T / np.sqrt(np.array(model.values))


def measured(rows: DataFrame, model: Whitening, vec_col: str) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows less the identity; None without components."""
    k = len(model.values)
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, ss = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = projected(centred(matrix(b.column(0), SCALE), model), model)
                s, ss = s + w.sum(axis=0), ss + w.T @ w
        at = np.arange(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.full(k, -1), np.repeat(at, k)), pa.int32()), pa.array(np.append(at, np.tile(at, k)), pa.int32()), pa.array(np.append(s, ss.ravel()))], ["i", "j", "v"])

    got = rows.select(F.col(f"`{vec_col}`").alias("__vector")).mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in got:
        if r.i < 0:
            mean[r.j] = r.v / model.n
        else:
            cov[r.i, r.j] = r.v / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, most: int = 32, vec_col: str = "embedding") -> Whitening:
    """The mean and first `most` components of all vectors, and how far the whitened vectors' covariance is from the identity.

    Vectors that are null or hold null or non-finite entries are passed over. Components of variance 0 don't exist, so there are fewer
    of them than dimensions for few or degenerate vectors, and none for equal ones or an empty table; an eigenvalue that comes k times
    gives k orthogonal components. Vectors of different lengths are an error, as are entries of 2^56 and more.
    """
    rows = vectors.filter(finite(F.col(f"`{vec_col}`")))
    n, sums, m = scatter(rows, vec_col)
    values, units = components(vectors.sparkSession, m, most)
    model = Whitening(n, sums, sum(m[i][i] for i in range(len(m))), values, units)
    return Whitening(n, sums, model.trace, values, units, measured(rows, model, vec_col))


def whiten(vectors: DataFrame, model: Whitening, vec_col: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows with finite vectors, with `out` (array<double>, an entry a component) and `deviation` (decimal(38,0): the sum over dimensions of (n * x - sums)^2, exact).

    All other columns stay, whatever their names, but columns named `out` or `deviation` are replaced. One pass, no shuffle.
    """
    rows = C.hold(vectors.filter(finite(F.col(f"`{vec_col}`")))).withColumn("__vector", C.field(vec_col))
    schema = T.StructType([*C.nullable(rows.schema).fields[:1], T.StructField("__out", T.ArrayType(T.DoubleType())), T.StructField("__deviation", T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for b in batches:
            if not b.num_rows:
                continue
            c = centred(matrix(b.column(1), SCALE), model)
            w = projected(c, model) if k else np.zeros((len(c), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            far = [Decimal(int(v)) for v in (c * c).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(far, pa.decimal128(38, 0))], schema.names)

    return C.unhold(rows.mapInArrow(run, schema), (out, deviation), F.col("__out").alias(out), F.col("__deviation").alias(deviation))


def op12_charpoly_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each vector and component. `deviation` is a long by contract: beyond it (about 4e7 vectors like the given ones) the cast fails, and `whiten`'s decimal serves."""
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    rows = whiten(vectors, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, model.explained())), F.col("at")) if model.values else F.lit(None).cast("double")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
