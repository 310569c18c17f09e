"""Near-duplicate embeddings by hierarchical navigable small-world graphs per shard.

1. Equal vectors become one class with a weight, so exact copies meet no search.
2. Classes are dealt to shards by hash. A task takes a shard and gathers tight
   balls: a vector within a third of the link angle of an earlier leader joins
   its ball, so any two vectors of a ball are linked by the triangle inequality
   of angles and need no comparison. A graph is built over the leaders and the
   shard, with its graph, is written as one row.
3. The leaders of every shard query the graph of their own and of every later
   shard, which looks at each pair once. A query whose whole beam stays within
   reach widens its beam. Then an audit scans the shard for a spread of queries:
   while too few of the pairs within reach were found, all beams widen; a beam
   that reaches the size of the shard becomes a scan.
4. Pairs of balls that the angles do not decide are verified by cosine in double
   precision. A task returns, per vector, its number of links and the root of
   its component within the task, so links are never written out as pairs.
5. Roots are united by min-label propagation and the results go back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.session import write_table

from . import hnsw
from .common import small_batches, table
from .components import connected
from .joins import lookup
from .queries import query

COSINE = 0.9
#: Vectors, and bytes of vectors, of a shard.
SHARD_ROWS = 8192
SHARD_BYTES = 32 << 20
#: Shards whose leaders meet a graph in one task.
QUERY_SHARDS = 2
#: First beam, and the share of pairs within reach that an audit must find.
BEAM = 16
AUDIT_RECALL = 0.98
#: Audited queries of a block, spread evenly over it.
AUDIT_QUERIES = 512
#: Queries searched together.
QUERY_ROWS = 512
#: Most partitions of a shuffle of shards (groups of them share a partition beyond).
PARTITIONS = 10_000

_SLACK = 1e-6
_SHARD = "dim int, shard int, uids binary, weights binary, vectors binary, balls binary, graph binary"
_FOUND = "uid long, links long, root long"


class Shard:
    """The vectors of one shard: leaders first (in random order), then the others; ``ball`` is each vector's leader."""

    def __init__(self, row: dict, dtype):
        self.uid = np.frombuffer(row["uids"], dtype=np.int64)
        self.weight = np.frombuffer(row["weights"], dtype=np.int64)
        v = np.frombuffer(row["vectors"], dtype=dtype).reshape(len(self.uid), row["dim"]).astype(np.float64)
        self.unit = unit(v)
        self.ball = np.frombuffer(row["balls"], dtype=np.int32).astype(np.int64)
        self.leaders = int(self.ball.max()) + 1
        self.order = np.argsort(self.ball, kind="stable")
        self.first = np.searchsorted(self.ball[self.order], np.arange(self.leaders + 1))
        to_leader = np.einsum("ij,ij->i", self.unit, self.unit[self.ball])
        self.reach = np.zeros(self.leaders)  # largest angle of a ball's member to its leader
        np.maximum.at(self.reach, self.ball, np.where(np.arange(len(self.uid)) < self.leaders, 0.0, _angle(to_leader)))
        self.fine = self.unit[: self.leaders].astype(np.float32)

    def members(self, ball: int) -> np.ndarray:
        return self.order[self.first[ball] : self.first[ball + 1]]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares of very large and small entries finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _balls(x: np.ndarray, radius: float) -> np.ndarray:
    """The leader (a row) of each row: the closest leader within ``radius`` before it, else the row itself."""
    near = np.cos(radius)
    leader = np.full(len(x), -1, dtype=np.int64)
    leaders = np.zeros(0, dtype=np.int64)
    for at in range(0, len(x), QUERY_ROWS):
        rows = np.arange(at, min(at + QUERY_ROWS, len(x)))
        if len(leaders):
            sims = x[rows] @ x[leaders].T
            best = sims.argmax(axis=1)
            ok = sims[np.arange(len(rows)), best] >= near
            leader[rows[ok]] = leaders[best[ok]]
        rest = rows[leader[rows] < 0]
        fresh = []
        if len(rest):
            among = x[rest] @ x[rest].T >= near
            for k in range(len(rest)):
                if leader[rest[k]] < 0:
                    own = rest[among[k] & (leader[rest] < 0)]
                    leader[own] = rest[k]
                    fresh.append(rest[k])
        leaders = np.concatenate([leaders, np.array(fresh, dtype=np.int64)])
    return leader


def _build(dtype, radius: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        order = np.argsort(rows.column("mixed").to_numpy(), kind="stable")
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.astype(dtype).reshape(-1, dim)[order]
        x = unit(v.astype(np.float64))
        leader = _balls(x, radius)
        is_leader = leader == np.arange(len(x))
        place = np.cumsum(is_leader) - 1
        ball = place[leader]
        new = np.concatenate([np.flatnonzero(is_leader), np.flatnonzero(~is_leader)])
        graph = hnsw.Graph.build(x[is_leader].astype(np.float32))
        row = {
            "dim": dim, "shard": shard,
            "uids": rows.column("uid").to_numpy()[order][new].astype(np.int64).tobytes(),
            "weights": rows.column("weight").to_numpy()[order][new].astype(np.int64).tobytes(),
            "vectors": np.ascontiguousarray(v[new]).tobytes(),
            "balls": ball[new].astype(np.int32).tobytes(),
            "graph": graph.pack(),
        }
        schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), *[(c, pa.binary()) for c in ("uids", "weights", "vectors", "balls", "graph")]])
        return pa.Table.from_pylist([row], schema)

    return run


class Links:
    """Links between the vectors of a task: counts and a forest, no list of pairs."""

    def __init__(self, n: int, weight: np.ndarray):
        self.count = np.zeros(n, dtype=np.int64)
        self.root = np.arange(n)
        self.weight = weight

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        while len(a):
            low = np.minimum(self.root[a], self.root[b])
            before = self.root.copy()
            np.minimum.at(self.root, self.root[a], low)
            np.minimum.at(self.root, self.root[b], low)
            np.minimum.at(self.root, a, low)
            np.minimum.at(self.root, b, low)
            self.root = self.root[self.root]
            if np.array_equal(before, self.root):
                return

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every vector of ``a`` is linked with every one of ``b``."""
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        self._join(np.concatenate([a, b]))

    def within(self, a: np.ndarray) -> None:
        self.count[a] += self.weight[a].sum() - self.weight[a]
        self._join(a)

    def _join(self, nodes: np.ndarray) -> None:
        roots = np.unique(self.root[nodes])
        self.root[np.isin(self.root, roots)] = roots[0]


class Search:
    """Pairs of leaders within reach of each other: those of ``asked`` against the graph of ``shard``."""

    def __init__(self, asked: Shard, shard: Shard, graph: hnsw.Graph, angle: float):
        self.asked, self.shard, self.graph, self.angle = asked, shard, graph, angle
        self.same = asked is shard
        self.spread = float(shard.reach.max())

    def _floor(self, q: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
        """The similarity from which a ball of that reach may hold a link with the ball of ``q``."""
        return np.cos(np.minimum(self.angle + self.asked.reach[q] + reach, np.pi)) - _SLACK

    def _pairs(self, q: np.ndarray, nodes: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the scored nodes (rows: queries; -1: none) that may hold a link."""
        hit = (nodes >= 0) & (sims >= self._floor(q[:, None], self.shard.reach[nodes]))
        if self.same:
            hit &= nodes != q[:, None]
        r, c = np.nonzero(hit)
        a, b = q[r], nodes[r, c]
        return (np.minimum(a, b), np.maximum(a, b)) if self.same else (a, b)

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = self.asked.fine[q] @ self.shard.fine.T
        return self._pairs(q, np.broadcast_to(np.arange(self.shard.leaders), sims.shape), sims)

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs found with a beam of ``width``; queries whose beam is within reach to its end search again, wider."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            if 4 * width >= self.shard.leaders:
                found.append(self.scan(q))
                break
            nodes, sims = self.graph.search(self.asked.fine[q], width)
            full = (nodes[:, -1] >= 0) & (sims[:, -1] >= self._floor(q, self.spread))
            found.append(self._pairs(q[~full], nodes[~full], sims[~full]))
            q, width = q[full], 4 * width
        return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *(f[k] for f in found)]) for k in range(2))

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within reach, each once, in batches. Audits set the beam before the first batch leaves."""
        n = self.asked.leaders
        cells = self.shard.leaders
        step = max(1, min(QUERY_ROWS, hnsw.SEEN_CELLS // max(cells, 1)))
        width = BEAM
        audited = np.unique(np.linspace(0, n - 1, min(n, AUDIT_QUERIES)).astype(np.int64))
        truth = self._codes(audited, step, None)
        while 4 * width < cells:
            found = self._codes(audited, step, width)
            if len(np.intersect1d(found, truth)) >= AUDIT_RECALL * len(truth):
                break
            width *= 2
        seen = np.zeros((cells, cells) if self.same else (0, 0), dtype=bool)
        for at in range(0, n, step):
            a, b = self.beam(np.arange(at, min(at + step, n)), width)
            if self.same:  # a pair may turn up from both sides
                codes = np.unique(a * cells + b)
                a, b = codes // cells, codes % cells
                fresh = ~seen[a, b]
                a, b = a[fresh], b[fresh]
                seen[a, b] = True
            yield a, b

    def _codes(self, audited: np.ndarray, step: int, width: int | None) -> np.ndarray:
        out = []
        for at in range(0, len(audited), step):
            q = audited[at : at + step]
            a, b = self.scan(q) if width is None else self.beam(q, width)
            out.append(a * self.shard.leaders + b)
        return np.unique(np.concatenate(out))


def _verify(search: Search, links: Links, base: int, cosine: float) -> None:
    """Add the links of every pair of balls that ``search`` finds; vectors of the asked shard stand from ``base`` on."""
    asked, shard, angle = search.asked, search.shard, search.angle
    size_a = np.diff(asked.first)
    size_b = np.diff(shard.first)
    for a, b in search.batches():
        single = (size_a[a] == 1) & (size_b[b] == 1)
        x, y = a[single], b[single]
        ok = np.einsum("ij,ij->i", asked.unit[x], shard.unit[y]) >= cosine
        links.pairs(base + x[ok], y[ok])
        for p, q in zip(a[~single].tolist(), b[~single].tolist()):
            rows, columns = asked.members(p), shard.members(q)
            between = float(_angle(asked.unit[p] @ shard.unit[q]))
            if between + asked.reach[p] + shard.reach[q] <= angle - _SLACK:
                links.all_of(base + rows, columns)
                continue
            for at in range(0, len(rows), QUERY_ROWS):
                part = rows[at : at + QUERY_ROWS]
                r, c = np.nonzero(asked.unit[part] @ shard.unit[columns].T >= cosine)
                links.pairs(base + part[r], columns[c])


def _meet(dtype, cosine: float):
    angle = float(np.arccos(cosine))

    def run(asked: pa.Table, graphs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for row in graphs.to_pylist():
            shard = Shard(row, dtype)
            graph = hnsw.Graph.unpack(shard.fine, row["graph"])
            for other in range(asked.num_rows):
                number = asked.column("shard")[other].as_py()
                own = number == row["shard"]
                block = shard if own else Shard(asked.slice(other, 1).to_pylist()[0], dtype)
                uid = shard.uid if own else np.concatenate([shard.uid, block.uid])
                weight = shard.weight if own else np.concatenate([shard.weight, block.weight])
                links = Links(len(uid), weight)
                if own:
                    for ball in np.flatnonzero(np.diff(shard.first) > 1).tolist():
                        links.within(shard.members(ball))
                _verify(Search(block, shard, graph, angle), links, 0 if own else len(shard.uid), cosine)
                touched = np.flatnonzero(links.count)
                out.append((uid[touched], links.count[touched], uid[links.root[touched]]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=np.int64) for k in range(3)]
        return pa.table(dict(zip(("uid", "links", "root"), map(pa.array, columns))))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    ``vectors`` has vec_id and embedding; other columns are not read. Two rows
    are linked if their cosine, in double precision, is at least ``cosine`` (over
    0.5); n_links counts the linked rows, component_id is the smallest vec_id
    reachable by links. The search is approximate: a task's audit must find
    ``AUDIT_RECALL`` of the pairs; what is returned is verified.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, and vectors of different lengths not with each other. Rows that
    repeat a vec_id, or have none, are rows of their own; a null vec_id is never
    a component_id unless nothing else is reachable, and is not kept.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    element = vectors.schema["embedding"].dataType.elementType
    single = isinstance(element, T.FloatType)
    dtype = np.float32 if single else np.float64
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    whole = F.coalesce(F.col("embedding").isNotNull() & fits, F.lit(False))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.when(whole, v).alias("v"))
    rows = write_table(rows.withColumn("k1", F.xxhash64(F.lit(1), "v")).withColumn("k2", F.xxhash64(F.lit(2), "v")), "dedup-rows")
    counted = rows.where("v is not null").agg(F.count("*").alias("n"), F.sum(F.size("v").cast("double")).alias("entries")).first()
    n, width = counted["n"], (counted["entries"] or 0) * np.dtype(dtype).itemsize
    shards = max(1, -(-n // SHARD_ROWS), int(-(-width // SHARD_BYTES)))

    classes = rows.where("v is not null").groupBy("k1", "k2").agg(
        F.min_by(F.struct("uid", "v"), "uid").alias("one"), F.count("*").alias("weight"), F.min("vec_id").alias("least")
    )
    classes = write_table(classes.select("k1", "k2", "one.uid", "one.v", "weight", "least"), "dedup-classes")
    dealt = classes.select(
        "uid", "weight", "v", F.size("v").alias("dim"), F.xxhash64("uid").alias("mixed"),
        F.pmod(F.xxhash64(F.lit(3), "uid"), F.lit(shards)).cast("int").alias("shard"),
    )
    dealt = dealt.repartition(min(4 * shards, PARTITIONS), "dim", "shard")
    built = dealt.groupBy("dim", "shard").applyInArrow(_build(dtype, float(np.arccos(cosine)) / 3), _SHARD)
    built = write_table(built, "dedup-shards")

    last = F.lit((shards - 1) // QUERY_SHARDS)
    asked = built.drop("graph").withColumn("part", (F.col("shard") / QUERY_SHARDS).cast("int"))
    asked = asked.withColumn("target", F.explode(F.sequence("shard", F.lit(shards - 1))))
    graphs = built.withColumn("part", F.explode(F.sequence(F.lit(0), F.least(last, (F.col("shard") / QUERY_SHARDS).cast("int")))))
    graphs = graphs.withColumn("target", F.col("shard"))
    key = ["dim", "target", "part"]
    tasks = min(4 * shards * -(-shards // QUERY_SHARDS), PARTITIONS)
    asked, graphs = (side.repartition(tasks, *key).groupBy(*key) for side in (asked, graphs))
    met = asked.cogroup(graphs).applyInArrow(_meet(dtype, cosine), _FOUND)
    met = write_table(met, "dedup-links")

    labels = connected(met.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    linked = met.groupBy("uid").agg(F.sum("links").alias("links"))
    linked = classes.select("uid", "k1", "k2", "weight", "least").join(linked, "uid", "left").join(
        labels.withColumnRenamed("node", "uid"), "uid", "left"
    )
    linked = linked.select("k1", "k2", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "uid").alias("label"))
    linked = write_table(linked, "dedup-linked")
    tops = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    found = lookup(linked, tops, ["label"], "size", n).select(
        "k1", "k2", "weight", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links")
    )
    ids = rows.where("v is not null").select("vec_id", "k1", "k2")
    found = write_table(found, "dedup-found")
    out = lookup(ids, found, ["k1", "k2"], "weight", n).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op13_near_dedup")
def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
