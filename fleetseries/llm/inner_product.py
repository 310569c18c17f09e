"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length, longest first, and packed into
buckets of bounded size (equal lengths are split, so copies of one vector do
not make a large bucket). A first pass scores every query against the longest
bucket of its dimension and so gets a lower bound of its k-th score. Then query
blocks and buckets meet in groups of a few of each. Within a group a query
skips a bucket if even the bucket's longest vector at cosine 1 stays below its
bound; otherwise the bound gives the cosine that a vector of the bucket needs:

* small: length pruning, only the vectors that are long enough are kept;
* large: coordinate pruning, only vectors whose normalised value at the
  query's largest coordinate lies in the feasible interval are kept.

What is left is verified with exact integer products. Bounds only skip what
cannot enter a result, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetseries.session import write_table

from .common import small_batches, table
from .queries import query

TOP = 5
#: Vectors of a bucket, and of a query block.
BUCKET = 1024
#: Buckets, and query blocks, of one group.
GROUP = 8
#: Local cosine thresholds from here on use coordinate pruning.
COORDINATE_FROM = 0.7
#: Largest table of longest buckets (one per dimension) that is broadcast for the first bounds.
SEED_BYTES = 64 << 20
#: Classes of length: a query block only goes to those that its bounds leave open.
CLASSES_PER_DOUBLING = 8

_BLOCK = "block long, dim int, rows int, longest double, need double, ids binary, uids binary, vectors binary, bounds binary"
_RESULT = "query_uid long, query_id long, vec_id long, score long"
_SLACK = 1e-9


def scaled(vectors: DataFrame) -> DataFrame:
    """Rows uid, vec_id, dim, length, v (floor(256 x) as doubles) of the vectors that take part."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", F.size("v").alias("dim"), F.sqrt(squares).alias("length"), "v"
    )


class Block:
    """Vectors of one dimension, longest first."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.uids = np.frombuffer(row["uids"], dtype=np.int64)
        self.v = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(self.ids), row["dim"])
        self.length = np.sqrt((self.v * self.v).sum(axis=1))
        self.bound = np.frombuffer(row["bounds"], dtype=np.float64)
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Normalised values of coordinate ``f`` in order, and the rows they belong to."""
        if f not in self._sorted:
            unit = np.divide(self.v[:, f], self.length, out=np.zeros(len(self.v)), where=self.length > 0)
            order = np.argsort(unit)
            self._sorted[f] = unit[order], order
        return self._sorted[f]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every partial sum is an exact integer, else with Python integers."""
    most = np.abs(queries).sum(axis=1).max(initial=0) * np.abs(vectors).max(initial=0)
    if most < 2**53:
        return queries @ vectors.T
    exact = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (queries, vectors)]
    return exact[0] @ exact[1].T


class TopK:
    """The best scores of each query of a block so far; of equal scores the smaller id."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.bound = queries.bound.copy() if len(queries.bound) else np.full(len(queries.ids), -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= max(edge, self.bound[q])
            scores, ids = scores[keep], ids[keep]
        own = sorted(self.best[q] + [(-int(s), i) for s, i in zip(scores.tolist(), ids.tolist())])[: self.k]
        self.best[q] = own
        if len(own) == self.k:
            self.bound[q] = max(self.bound[q], -own[-1][0])

    def scan(self, bucket: Block) -> None:
        block = self.queries
        if not len(bucket.ids):
            return
        reach = block.length * bucket.length[0]
        need = np.divide(self.bound, reach, out=np.full(len(reach), -np.inf), where=reach > 0)
        need[(reach == 0) & (self.bound > 0)] = np.inf
        open_ = np.flatnonzero(need <= 1 + _SLACK)
        by_coordinate = need[open_] >= COORDINATE_FROM
        for q in open_[by_coordinate].tolist():
            at = self._feasible(q, min(1.0, need[q]), bucket)
            if len(at):
                self._verify(q, products(block.v[q : q + 1], bucket.v[at])[0], at, bucket)
        rest = open_[~by_coordinate]
        if not len(rest):
            return
        shortest = np.divide(
            self.bound[rest], block.length[rest], out=np.full(len(rest), -np.inf), where=block.length[rest] > 0
        )
        # lengths fall, so the vectors that are long enough are a prefix of the bucket
        reached = np.searchsorted(-bucket.length, -(shortest * (1 - _SLACK) - _SLACK), side="right")
        scores = products(block.v[rest], bucket.v[: reached.max()])
        for row, (q, n) in enumerate(zip(rest.tolist(), reached.tolist())):
            self._verify(q, scores[row, :n], np.arange(n), bucket)

    def _feasible(self, q: int, need: float, bucket: Block) -> np.ndarray:
        unit = self.queries.v[q] / self.queries.length[q]
        f = int(np.abs(unit).argmax())
        middle, spread = unit[f] * need, np.sqrt(max(0.0, 1 - unit[f] ** 2) * (1 - need * need))
        low = -1.0 if unit[f] <= -need else middle - spread
        high = 1.0 if unit[f] >= need else middle + spread
        values, rows = bucket.column(f)
        return rows[np.searchsorted(values, low - _SLACK) : np.searchsorted(values, high + _SLACK, side="right")]

    def _verify(self, q: int, scores: np.ndarray, at: np.ndarray, bucket: Block) -> None:
        good = (scores >= self.bound[q]) & (bucket.uids[at] != self.queries.uids[q])
        if good.any():
            self.add(q, scores[good], bucket.ids[at][good])

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        for uid, own, best in zip(self.queries.uids.tolist(), self.queries.ids.tolist(), self.best):
            for s, i in best:
                yield uid, own, i, -s


def _pack(with_bounds: bool):
    """Consecutive rows of a partition in blocks of one dimension and at most BUCKET rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows):
            uid, ids, length, v, bound = zip(*rows)
            bounds = np.array(bound if with_bounds else [], dtype=np.float64)
            open_ = [b / n if n > 0 else -np.inf for b, n in zip(bound, length)]
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "block": uid[0],
                        "dim": len(v[0]),
                        "rows": len(rows),
                        "longest": length[0],
                        "need": max(min(open_), 0.0) if with_bounds else 0.0,
                        "ids": np.array(ids, dtype=np.int64).tobytes(),
                        "uids": np.array(uid, dtype=np.int64).tobytes(),
                        "vectors": np.array(v, dtype=np.float64).tobytes(),
                        "bounds": bounds.tobytes(),
                    }
                ],
                schema=_BLOCK_SCHEMA,
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("uid", "vec_id", "length", "v", "bound"))):
                if held and (len(held) == BUCKET or len(row[3]) != len(held[0][3])):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("rows", pa.int32()), ("longest", pa.float64()), ("need", pa.float64())]
    + [(n, pa.binary()) for n in ("ids", "uids", "vectors", "bounds")]
)


def _blocks(rows: DataFrame, order: list, n: int, with_bounds: bool, name: str) -> DataFrame:
    parts = max(1, -(-n // (4 * BUCKET)))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return write_table(dealt.mapInArrow(_pack(with_bounds), _BLOCK), name)


def _best(k: int):
    """Results of the query blocks of a group over its buckets, longest first."""

    def run(queries: pa.Table, buckets: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and buckets.num_rows:
            held = [Block(r) for r in buckets.sort_by([("longest", "descending")]).to_pylist()]
            for row in queries.to_pylist():
                top = TopK(Block(row), k)
                for bucket in held:
                    top.scan(bucket)
                out += top.rows()
        columns = list(zip(*out)) or [()] * 4
        names = ["query_uid", "query_id", "vec_id", "score"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return run


def _seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                top = TopK(Block(row), k)
                top.scan(Block({**{c: row[f"seed_{c}"] for c in ("ids", "uids", "vectors")}, "dim": row["dim"], "bounds": b""}))
                bound = np.where([len(b) == k for b in top.best], top.bound, -np.inf)
                yield pa.RecordBatch.from_pydict({"uid": pa.array(top.queries.uids), "bound": pa.array(bound)})

    return run


def top_products(vectors: DataFrame, is_query, k: int = TOP) -> DataFrame:
    """The ``k`` highest inner products of each query row with all other rows.

    ``vectors`` has vec_id and embedding (other columns are not read);
    ``is_query`` is a condition on vec_id. Components become floor(256 x).
    Returns query_id, rank (from 1), vec_id, score; of equal scores the smaller
    vec_id comes first; fewer than ``k`` rows where fewer candidates exist.

    Rows without an id, null vectors and vectors with a null, NaN or infinite
    component take no part. Only vectors of a query's own dimension are its
    candidates. Rows that repeat a vec_id are candidates, and queries, each by
    itself. A score beyond 64 bits raises an error.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = write_table(scaled(vectors), "mips-rows")
    n = rows.count()
    order = [F.col("dim"), F.col("length").desc(), F.xxhash64("uid")]
    unbound = F.lit(float("-inf")).alias("bound")
    buckets = _blocks(rows.select("*", unbound), order, n, False, "mips-buckets")
    asked = rows.where(is_query)
    n_asked = asked.count()

    longest = buckets.groupBy("dim").agg(F.max_by(F.struct("ids", "uids", "vectors"), F.struct("longest", "block")).alias("s"))
    longest = longest.select(
        F.col("dim").alias("seed_dim"), F.col("s.ids").alias("seed_ids"), F.col("s.uids").alias("seed_uids"),
        F.col("s.vectors").alias("seed_vectors"),
    )
    longest = write_table(longest, "mips-seeds")
    size = longest.agg(F.sum(F.length("seed_vectors"))).first()[0] or 0
    if size <= SEED_BYTES:
        plain = _blocks(asked.select("*", unbound), order, n_asked, False, "mips-asked")
        met = plain.join(F.broadcast(longest), plain["dim"] == longest["seed_dim"]).drop("seed_dim")
        bounds = met.mapInArrow(_seeds(k), "uid long, bound double")
        asked = asked.join(bounds, "uid")
    else:  # no first bounds: nothing is skipped until a group has found its own
        asked = asked.select("*", unbound)
    need = F.when(F.col("length") > 0, F.col("bound") / F.col("length")).otherwise(F.lit(float("-inf")))
    queries = _blocks(asked, [F.col("dim"), need.desc(), F.xxhash64("uid")], n_asked, True, "mips-queries")

    # lengths in classes: class c holds lengths up to 2 ** (c / CLASSES_PER_DOUBLING)
    def length_class(x):
        return F.when(x > 0, F.ceil(F.log2(x) * CLASSES_PER_DOUBLING)).otherwise(F.lit(-1000)).cast("int")

    n_queries, n_buckets = queries.count(), buckets.count()
    salts, groups = max(1, -(-n_buckets // GROUP)), max(1, -(-n_queries // GROUP))
    buckets = buckets.select("*", length_class(F.col("longest")).alias("class"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    spread = buckets.groupBy("dim").agg(F.sort_array(F.collect_set(F.struct("class", "salt"))).alias("cells"))
    open_cells = F.filter("cells", lambda c: c["class"] >= length_class(F.col("need") * (1 - _SLACK)))
    left = (
        queries.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
        .join(spread, "dim")
        .withColumn("cell", F.explode(open_cells))
        .select(*queries.columns, "group", "cell.class", "cell.salt")
    )
    right = buckets.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    key = ["dim", "class", "salt", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), _RESULT)
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_inner_product", ORACLE)
def op2_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
