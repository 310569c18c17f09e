"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers x. The fit list, each distinct x once, is packed into
blocks of rows and written; X below is that list, centred. Lanczos vectors v
have as many entries as a vector has dimensions and stay on the driver. A
vector u has one entry per fitted row and is never gathered: it equals X w for
a short w, so a task forms its part of u from its rows and w. One pass over the
blocks multiplies both ways, u = X w and then X'u, and returns X'u, U'u and
|u|^2, one row of sums per block, added up by Spark:

* the driver sets w so that u is orthogonal to the earlier u (their X'u are
  known), and the measured U'u corrects what rounding left of it;
* X'u is orthogonalised against all earlier v and gives the next v;
* a product that vanishes ends a Krylov space, and a fresh start orthogonal to
  all v opens the next.

The bidiagonal matrix of the steps has at most one row per dimension. Its SVD
on the driver gives components and deviations. A last pass over the blocks
whitens the fit list and measures how far its covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.session import write_table

from .common import small_batches, table
from .queries import query

COMPONENTS = 16
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Rows of a block of the fit list.
BLOCK_ROWS = 4096
#: Products below this share of the matrix's norm count as zero.
VANISHING = 1e-12
#: Lanczos ends early when the wanted triplets have residuals below this share of the largest singular value.
RESIDUAL = 1e-14

_FIT = "rows int, x binary"
_BIG = 2.0**62


def scaled(vectors: DataFrame) -> DataFrame:
    """``vectors`` with a column __x (array of long) for the rows that take part."""
    entry = F.col("embedding")
    fits = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < _BIG))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fits)
    return rows.withColumn("__x", x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            data = np.concatenate(held)
            return pa.RecordBatch.from_pydict({"rows": pa.array([len(data)], pa.int32()), "x": pa.array([data.tobytes()], pa.binary())})

        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at : at + BLOCK_ROWS]
                if held and size + len(part) > BLOCK_ROWS:
                    yield block()
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield block()

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they fit, else Python integers."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def square_sums(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None beyond 64 bits."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**63:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d.tolist()]
    return [s if s < 2**63 else None for s in exact]


def _added(blocks: DataFrame, of_block) -> np.ndarray:
    """The element-wise sum over all blocks of the array that ``of_block`` returns for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0):
                part = of_block(np.frombuffer(data.as_buffer(), dtype=np.int64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total))), "value": pa.array(total)})

    parts = blocks.select("x").mapInArrow(run, "at long, value double")
    added = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")
    return added["value"].to_numpy(dtype=np.float64)


@dataclass
class Whitening:
    """What ``fit`` learns: n, S, eigenvalues e (falling), components (columns), trace of V, identity error."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def _against(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis`` (twice, which is enough)."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def _unit(rng: np.random.Generator, basis: list[np.ndarray], dim: int) -> np.ndarray:
    while True:
        v = _against(rng.standard_normal(dim), basis)
        if (size := np.linalg.norm(v)) > 1e-6:
            return v / size


def bidiagonalise(product, dim: int, norm: float, wanted: int, seed: int = 0):
    """Golub-Kahan-Lanczos steps until the wanted triplets stand or the dimensions are used up.

    ``product(w, W)`` returns X'u, U'u and |u|^2 for u = X w and U = X W.
    Returns the v (columns) and the bidiagonal matrix of the steps.
    """
    rng = np.random.default_rng(seed)
    tiny = VANISHING * norm
    vs: list[np.ndarray] = []
    ws: list[np.ndarray] = []  # u_i = X w_i; None where X v_i has nothing outside the earlier u
    backs: list[np.ndarray] = []  # X'u_i
    b = np.zeros((dim, dim))
    v = _unit(rng, vs, dim)
    while True:
        k = len(vs)
        w = v.copy()
        live = [i for i, x in enumerate(ws) if x is not None]
        if live:  # u_i' X v = (X'u_i)' v
            h = np.array([backs[i] @ v for i in live])
            w -= np.array([ws[i] for i in live]).T @ h
        back, overlap, square = product(w, [ws[i] for i in live])
        if live:
            w -= np.array([ws[i] for i in live]).T @ overlap
            back = back - np.array([backs[i] for i in live]).T @ overlap
            square -= float(overlap @ overlap)
        alpha = np.sqrt(max(square, 0.0))
        vs.append(v)
        if alpha <= tiny:
            ws.append(None)
            backs.append(np.zeros(dim))
            rest = np.zeros(dim)
        else:
            b[k, k] = alpha
            ws.append(w / alpha)
            backs.append(back / alpha)
            rest = _against(backs[-1], vs)
        if k + 1 == dim:
            return np.array(vs).T, b
        beta = np.linalg.norm(rest)
        if beta <= tiny:
            v = _unit(rng, vs, dim)
            continue
        b[k, k + 1] = beta
        v = rest / beta
        if k + 1 >= 2 * wanted:
            left, values, _ = np.linalg.svd(b[: k + 1, : k + 1])
            if beta * np.abs(left[k, :wanted]).max() <= RESIDUAL * values[0]:
                return np.array(vs).T, b[: k + 1, : k + 1]


def fit(scaled_rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct __x of ``scaled_rows``, all of ``dim`` entries; None if there are none."""
    distinct = scaled_rows.select("__x").distinct()
    blocks = write_table(distinct.mapInArrow(_pack(dim), _FIT), "whitening-fit")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = np.frombuffer(data.as_buffer(), dtype=np.int64).reshape(-1, dim)
                if int(np.abs(x).max()) * len(x) >= 2**63:
                    x = x.astype(object)
                total = [str(int(v)) for v in x.sum(axis=0)]
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dim)), "value": pa.array(total)})

    n = int(blocks.agg(F.sum("rows")).first()[0] or 0)
    if not n:
        return None
    added = blocks.select("x").mapInArrow(sums_of, "at long, value string").groupBy("at")
    found = {r["at"]: int(r["value"]) for r in added.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    sums = [found[i] for i in range(dim)]

    def squares(data: np.ndarray) -> np.ndarray:
        x = centred(data.reshape(-1, dim), n, sums)
        return (x * x).sum(axis=0)

    trace_n = float(_added(blocks, squares).sum())
    if trace_n <= 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0)

    def product(w: np.ndarray, ws: list[np.ndarray]):
        basis = np.array(ws).reshape(len(ws), dim).T

        def of_block(data: np.ndarray) -> np.ndarray:
            x = centred(data.reshape(-1, dim), n, sums)
            u = x @ w
            return np.concatenate([x.T @ u, (x @ basis).T @ u, [u @ u]])

        total = _added(blocks, of_block)
        return total[:dim], total[dim:-1], float(total[-1])

    vs, b = bidiagonalise(product, dim, np.sqrt(trace_n), min(components, dim))
    _, singular, right = np.linalg.svd(b)
    kept = min(components, int((singular > VANISHING * singular[0] * dim).sum()))
    axes = vs @ right.T[:, :kept]
    axes /= np.linalg.norm(axes, axis=0)
    values = singular[:kept] ** 2 / n

    def covariance(data: np.ndarray) -> np.ndarray:
        z = centred(data.reshape(-1, dim), n, sums) @ axes / np.sqrt(values)
        return (z.T @ z).ravel()

    error = np.abs(_added(blocks, covariance).reshape(kept, kept) / n - np.eye(kept)).max()
    return Whitening(n, sums, values, axes, trace_n / n, float(error))


def _apply(model: Whitening, dim: int, columns: list[str]):
    kept = len(model.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = deviations(_matrix(batch.column("__x"), dim), model.n, model.sums)
            z = d.astype(np.float64) / model.n @ model.components / np.sqrt(model.values)
            out = {c: batch.column(c) for c in columns}
            out["__deviation"] = pa.array(square_sums(d), pa.int64())
            flat = pa.array(np.ascontiguousarray(z, dtype=np.float64).ravel())
            out["__z"] = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * kept, pa.int32()), flat)
            yield pa.RecordBatch.from_pydict(out)

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component.

    ``vectors`` has vec_id and embedding; other columns are not read. Returns
    vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained and identity_error, at most ``components`` per vector.

    Null and empty vectors, and vectors with a null, NaN or infinite entry or one
    whose integer passes 62 bits, take no part. Vectors of different lengths have
    no common covariance: those of the commonest length take part, of two equally
    common lengths the smaller. Repeated rows count once in the fit list and give
    a row each; a null vec_id stays null. Directions without variance are no
    components, so a table with a single distinct vector, or none, gives no rows.
    A deviation beyond 64 bits is null. Equal eigenvalues have no order of their
    own; any orthonormal axes of their space are right.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = write_table(scaled(vectors.select("vec_id", "embedding")).select("vec_id", "__x"), "whitening-rows")
    common = rows.groupBy(F.size("__x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.where(F.size("__x") == dim).withColumn("vec_id", F.col("vec_id").cast("long"))
    model = fit(rows, dim, components)
    if not len(model.values):
        return spark.createDataFrame([], schema)
    out = rows.mapInArrow(_apply(model, dim, ["vec_id"]), "vec_id long, __deviation long, __z array<double>")
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return out.select("vec_id", "__deviation", F.posexplode("__z").alias("at", "z")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("__deviation").alias("deviation"),
        F.col("z").alias("whitened"),
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
