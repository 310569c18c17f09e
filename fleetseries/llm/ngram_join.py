"""Exact Jaccard join of documents on word n-grams, as a join in a metric space.

Jaccard distance is a metric on sets. Regions are made by pivots, documents
near a border are replicated to every region where a partner may have its
home, and large regions are joined recursively:

1. Documents with equal shingle sets are one class (distance 0).
2. Unrelated documents all lie at a distance close to 1 from each other, so
   cells of sampled documents would hold everything. The pivots of the first
   level therefore are the one-shingle sets {s}: s in x puts x nearer to {s}
   than any set without it. Under a fixed order of the shingles (rare ones
   first; the order only affects speed) a set's home is its first shingle, and
   a partner at distance at most e has its home among the set's first
   n - ceil((1 - e) n) + 1 shingles: the border window. Windows are ``COMMON`` - 1
   shingles longer; then partners share at least ``COMMON`` of them, which tells
   them from texts that share a phrase.
3. Regions of at most ``REGION`` classes compare their pairs of fitting size.
   Larger ones get pivots among their own documents: each member goes to the
   cell of its nearest pivot and, by the triangle inequality, to every cell
   whose pivot is at most 2e farther. Members within e of a pivot are linked
   through it; of those a cell keeps only the ones that a member beyond e can
   reach. Cells are joined recursively.
4. Cells that pivots no longer divide are compared in blocks: members outside
   the cell's largest component so far against all members.

Links are a spanning forest of the true links: pairs inside a component are
not listed. Groups never meet in one task but in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.session import drop_table, write_table

from .common import SPACED_WORD, Words, mix, small_batches, table, text_batches
from .components import connected
from .queries import query

#: Shingles of their windows that a pair must share (fewer where sets are too small for it).
COMMON = 4
WORDS = 3
PERCENT = 90
#: Classes of a region whose pairs are compared directly.
REGION = 32
#: Members of a chunk or block that one task compares at a time, and pivots of a cell.
CHUNK = 256
PIVOTS = 8
LEVELS = 3
#: Shingles that the order knows as frequent at most (9 bytes each are broadcast); the rarest go first.
ORDER_ROWS = 3_000_000
#: Documents whose ids (with the names of their sets, about 60 bytes each) may be broadcast to pick texts.
BROADCAST_ROWS = 500_000
#: Shingles (8 bytes each) that a task aims at when it verifies clusters, and of the largest cluster that is verified whole.
GROUP_SHINGLES = 500_000
CLUSTER_SHINGLES = 4_000_000
#: Shingles that a task counts at a time for the order.
COUNT_ROWS = 1_500_000

_U64 = np.uint64
_SET = "sid long, n int"


class ShingleSets:
    """The distinct shingles of each text: ``hash`` sorted within each text, text k from ``first[k]`` on."""

    def __init__(self, texts: list[str | None], words: int = WORDS):
        w = Words(texts, SPACED_WORD)
        sizes = np.diff(w.first)
        h = np.zeros(len(w.hash), dtype=_U64)
        padded = np.concatenate([w.hash, np.zeros(words, dtype=_U64)])
        for k in range(words):
            h = mix(h * _U64(0x9E3779B97F4A7C15) + padded[k : k + len(h)])
        doc = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(w.first[1:], sizes) - np.arange(len(h))  # words from here to the end of the text
        whole = left >= words
        for k in np.flatnonzero((sizes > 0) & (sizes < words)).tolist():
            at, own = int(w.first[k]), _U64(0x5851F42D4C957F2D)
            for x in w.hash[at : at + sizes[k]]:
                own = _chain(own, x)
            h[at], whole[at] = own, True
        h, doc = h[whole], doc[whole]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each set."""
        out = []
        for salt in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
            total = np.concatenate([[_U64(0)], np.cumsum(mix(self.hash ^ _U64(salt)))])
            own = total[self.first[1:]] - total[self.first[:-1]]
            out.append(mix(own + self.size.astype(_U64)).view(np.int64))
        return out[0], out[1]


def _chain(own: np.uint64, word: np.uint64) -> np.uint64:
    return mix(np.array([int(own) * 0x9E3779B97F4A7C15 + int(word) & (1 << 64) - 1], dtype=_U64))[0]


def least_linkable(percent: int) -> int:
    """The smallest set that can link with a different one: there must be room for a larger partner."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 31


def common_shingles(percent: int) -> int:
    """How many shingles of their windows two linked sets share at least: windows are that much longer."""
    return max(1, min(COMMON, -(-percent * least_linkable(percent) // 100)))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the border window: n - ceil((1 - e) n) + common_shingles; none for sets that link with no other."""
    return np.where(n < least_linkable(percent), 0, n + (-percent * n) // 100 + common_shingles(percent))


def _classes(words: int):
    """A row for each document (kind 0), and counts of the shingles that a task meets more than once (kind 1)."""
    names = ["kind", "doc_id", "n", "s1", "s2"]

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = h[n > 1].view(np.int64), n[n > 1]
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), none, pa.array(n), pa.array(h), none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in text_batches(batches, "text", 2 << 20):
            sets = ShingleSets(part.column("text").to_pylist(), words)
            s1, s2 = sets.names()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(s1), np.int32)), part.column("doc_id").combine_chunks(), pa.array(sets.size), pa.array(s1), pa.array(s2)],
                names=names,
            )
            held.append(sets.hash)
            size += len(sets.hash)
            if size >= COUNT_ROWS:
                yield counts(held)
                held, size = [], 0
        if size:
            yield counts(held)

    return run


def _prefixes(shared, words: int, percent: int):
    """(h, sid, n, place): the border window of each distinct set of a batch, with the places of its shingles in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = shared.value
        for part in text_batches(batches, "text", 2 << 20):
            sets = ShingleSets(part.column("text").to_pylist(), words)
            sid, _ = sets.names()
            _, only = np.unique(sid, return_index=True)
            use = np.zeros(len(sid), dtype=bool)
            use[only] = True
            rank = np.zeros(len(sets.hash), dtype=np.uint8)
            if len(common):
                at = np.minimum(np.searchsorted(common, sets.hash), len(common) - 1)
                rank = np.where(common[at] == sets.hash, level[at], 0).astype(np.uint8)
            # hashes are sorted within a document, so only those with frequent shingles need another order
            order = np.arange(len(rank))
            mixed = np.flatnonzero(np.bincount(sets.doc[rank > 0], minlength=len(sid)) > 0)
            for k in mixed.tolist():
                a, b = sets.first[k], sets.first[k + 1]
                order[a:b] = a + np.argsort(rank[a:b], kind="stable")
            place = np.arange(len(rank)) - sets.first[sets.doc]
            keep = (place < prefix_size(sets.size, percent)[sets.doc]) & use[sets.doc]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sets.hash[order[keep]].view(np.int64)),
                    pa.array(sid[sets.doc[keep]]),
                    pa.array(sets.size[sets.doc[keep]].astype(np.int32)),
                    pa.array(place[keep].astype(np.int32)),
                ],
                names=["h", "sid", "n", "place"],
            )

    return run


def _shared_only(percent: int):
    """Of rows sorted by (h, n, sid): distinct ones that have another set of fitting size at their shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, False  # the last row of the batch before, and whether it was given already
        for batch in batches:
            h, sid, n, place = (batch.column(c).to_numpy() for c in ("h", "sid", "n", "place"))
            if last is not None:
                h, sid, n, place = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (h, sid, n, place)))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
            h, sid, n, place = h[new], sid[new], n[new], place[new]
            # sizes rise within a shingle, so a set has a partner of fitting size only if its neighbour fits
            fits = (h[1:] == h[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            keep = np.zeros(len(h), dtype=bool)
            keep[1:] |= fits
            keep[:-1] |= fits
            last_given = bool(keep[-1]) if len(h) > 1 else given
            if given:
                keep[0] = False
            last, given = (h[-1], sid[-1], n[-1], place[-1]), last_given
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, sid, n, place)], names=["h", "sid", "n", "place"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, "text", 2 << 20):
            sets = ShingleSets(part.column("text").to_pylist(), words)
            sid, _ = sets.names()
            lists = pa.ListArray.from_arrays(pa.array(sets.first, pa.int32()), pa.array(sets.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("want").combine_chunks(), pa.array(sid), lists], names=["want", "sid", "hashes"])

    return run


def _arrays(column) -> list[np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1]) if len(lists) else []


class Overlaps:
    """Sizes of the intersections of one set with each set of a list."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.ids, self.flat = np.unique(np.concatenate(sets) if sets else np.empty(0, np.int64), return_inverse=True)
        self.first = np.cumsum(self.size) - self.size

    def of(self, own: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(self.ids) + 1, dtype=np.int64)
        at = np.searchsorted(self.ids, own)
        at[at == len(self.ids)] = 0
        mark[at[self.ids[at] == own]] = 1
        total = np.concatenate([[0], np.cumsum(mark[self.flat])])
        return total[self.first + self.size] - total[self.first]


def _linked(both: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * union


def _verify_group(percent: int):
    """Of the candidate pairs of whole clusters, with each set given once: a spanning forest of the links."""

    def work(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        own = dict(zip(sets.column("sid").to_pylist(), _arrays(sets.column("hashes"))))
        top = {sid: sid for sid in own}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        out = []
        for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
            if find(a) != find(b):
                x, y = own[a], own[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
                    top[find(b)] = find(a)
        columns = list(zip(*out)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return work


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by region: those that connect what their region's pairs before them did not."""
    last, top = None, {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for k, (region, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("region", "a", "b")))):
            if region != last:
                last, top = region, {}
            x, y = find(a), find(b)
            keep[k], top[y] = x != y, x
        yield batch.filter(pa.array(keep)).select(["a", "b"])


_CELL = "region long, a long, b long, sid long, n int, both long, size long"


def _cells(percent: int):
    """Links of a chunk's members to the pivots of their region (a, b), and members of the cells (both and the union's size: the distance)."""

    def work(members: pa.Table, pivots: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if members.num_rows and pivots.num_rows:
            pivots = pivots.sort_by("sid")
            names, of = pivots.column("sid").to_pylist(), Overlaps(_arrays(pivots.column("hashes")))
            region = members.column("region")[0].as_py()
            for sid, n, own in zip(members.column("sid").to_pylist(), members.column("n").to_pylist(), _arrays(members.column("hashes"))):
                both = of.of(own)
                union = of.size + n - both
                distance = 1 - both / union
                near = distance <= distance.min() + 2 * (100 - percent) / 100 + 1e-9
                link = _linked(both, union, percent)
                for k in np.flatnonzero(near | link).tolist():
                    cell = int(_chain(_U64(region & (1 << 64) - 1), _U64(names[k] & (1 << 64) - 1)).view(np.int64))
                    out.append((cell if near[k] else None, sid if link[k] else None, names[k] if link[k] else None, sid, n, int(both[k]), int(union[k])))
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) or [()] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["region", "a", "b", "sid", "n", "both", "size"])

    return work


def _blocks(percent: int):
    """A spanning forest of the links between open members and all members of a block."""

    def work(open_: pa.Table, others: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if open_.num_rows and others.num_rows:
            names = others.column("sid").to_numpy()
            labels: dict[int, int] = {}
            comp = np.array([labels.setdefault(x, len(labels)) for x in others.column("label").to_pylist()], dtype=np.int64)
            of = Overlaps(_arrays(others.column("hashes")))
            for sid, label, own in zip(open_.column("sid").to_pylist(), open_.column("label").to_pylist(), _arrays(open_.column("hashes"))):
                mine = labels.setdefault(label, len(labels))
                both = of.of(own)
                hit = np.flatnonzero(_linked(both, of.size + len(own) - both, percent) & (comp != mine))
                _, first = np.unique(comp[hit], return_index=True)
                for k in hit[first].tolist():
                    out.append((sid, int(names[k])))
                    comp[comp == comp[k]] = mine
                    labels[label] = mine
        columns = list(zip(*out)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return work


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, for a cogroup with a frame of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class JaccardJoin:
    """Classes and links of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, region: int = REGION):
        self.spark: SparkSession = docs.sparkSession
        small_batches(self.spark)
        self.words, self.percent, self.region = words, percent, region
        self._held: list[DataFrame] = []
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        seen = write_table(self.rows.mapInArrow(_classes(words), "kind int, doc_id long, n long, s1 long, s2 long"), "join-classes")
        #: One row per document: doc_id, n (set size), s1, s2 (name of its set).
        self.documents = seen.where("kind = 0").select("doc_id", "n", "s1", "s2")
        #: One row per distinct non-empty set: sid, n, doc_id (smallest).
        self.classes = self.documents.where("n > 0").groupBy(F.col("s1").alias("sid"), "s2", "n").agg(F.min("doc_id").alias("doc_id"))
        self._counts = seen.where("kind = 1").select(F.col("s1").alias("h"), "n")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        """A table that only this join reads; it goes with the join's end, or before by ``_drop``."""
        return self._hold(write_table(df, name))

    def _hold(self, table: DataFrame) -> DataFrame:
        self._held.append(table)
        return table

    def _drop(self, *tables: DataFrame) -> None:
        for table in tables:
            drop_table(table)
        self._held = [t for t in self._held if all(t is not table for table in tables)]

    def _order(self):
        """The frequent shingles, sorted, and the logarithm of their counts; of too many the most frequent."""
        level = F.least(F.floor(F.log2("n")), F.lit(60)).cast("int")
        frequent = self._counts.groupBy("h").agg(F.sum("n").alias("n")).select("h", level.alias("level")).where("level >= 1")
        frequent = self._write(frequent, "join-order")
        sizes = sorted(frequent.groupBy("level").count().collect(), reverse=True)
        least, total = 61, 0
        for row in sizes:
            total += row["count"]
            if total > ORDER_ROWS:
                break
            least = row["level"]
        rows = frequent.where(F.col("level") >= least).toArrow()
        self._drop(frequent)
        h = rows.column("h").to_numpy().view(_U64)
        order = np.argsort(h)
        return self.spark.sparkContext.broadcast((h[order], rows.column("level").to_numpy().astype(np.uint8)[order]))

    def _windows(self) -> DataFrame:
        """(h, sid, n, place) for the shingles whose window holds more than one set."""
        kinds = "h long, sid long, n int, place int"
        rows = self.rows.select("text").mapInArrow(_prefixes(self._order(), self.words, self.percent), kinds)
        dealt = rows.repartition("h").sortWithinPartitions("h", "n", "sid")
        return self._write(dealt.mapInArrow(_shared_only(self.percent), kinds), "join-windows")

    def _payload(self, windows: DataFrame) -> DataFrame:
        """(sid, hashes) of every set in ``windows``, from one document of each."""
        wanted = windows.select("sid").distinct().join(self.classes.select("sid", "doc_id"), "sid")
        wanted = wanted.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("sid").alias("want"))
        wanted = few = self._write(wanted, "join-wanted")
        if wanted.count() <= BROADCAST_ROWS:  # else the texts are shuffled by document
            few = F.broadcast(wanted)
        texts = self.rows.join(few, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("want", "text")
        sets = texts.mapInArrow(_sets(self.words), "want array<long>, sid long, hashes array<long>")
        # a doc_id that several rows share brings all their texts: only the wanted sets stay, each once
        sets = sets.where(F.array_contains("want", F.col("sid"))).select("sid", "hashes")
        if self.documents.groupBy("doc_id").count().where("count > 1").limit(1).count():
            sets = sets.dropDuplicates(["sid"])
        sets = self._write(sets, "join-sets")
        self._drop(wanted)
        return sets

    def _pairs(self, members: DataFrame, sets: DataFrame, common: int) -> tuple[DataFrame, DataFrame]:
        """Links inside regions of at most ``region`` members; members of clusters that are too large for one task.

        Only pairs with ``common`` regions count: a linked pair with fewer also meets in a larger region. Regions
        that are shingles come with the members' places in the order: up to the last shingle that a pair shares
        here, each set has all its other shingles to itself, and what follows bounds the rest of the overlap. A
        linked pair beyond that bound shares a shingle of a larger region before that place, and meets there.
        """
        placed = "place" in members.columns
        own = [F.col("place")] if placed else [F.lit(0).alias("place")]
        left = members.select("region", F.col("sid").alias("a"), F.col("n").alias("na"), *[c.alias("pa") for c in own])
        right = members.select("region", F.col("sid").alias("b"), F.col("n").alias("nb"), *[c.alias("pb") for c in own])
        fits = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        pairs = left.join(right, "region").where(fits).groupBy("a", "b").agg(
            F.count("*").alias("count"), *[F.max(c).alias(c) for c in ("na", "nb", "pa", "pb")],
            F.min("region").alias("region"))
        open_ = F.col("count") >= common
        if placed:
            most = F.col("count") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
            open_ &= (100 + self.percent) * most >= self.percent * (F.col("na") + F.col("nb"))
        pairs = self._write(pairs.where(open_).select("region", "a", "b"), "join-pairs")
        sizes = left.select(F.col("a").alias("sid"), F.col("na").alias("n")).distinct()
        # candidates that hang together are verified together, so each set travels once; a region hangs together
        # by fewer pairs than it has members
        dealt = pairs.repartition("region").sortWithinPartitions("region", "a", "b")
        # stored, as both directions of a link must come from one forest
        forest = self._write(dealt.mapInArrow(_forest, "a long, b long"), "join-forest")
        found = self._hold(connected(forest))
        self._drop(forest)
        weight = sizes.join(found, sizes["sid"] == found["node"]).groupBy("label").agg(F.sum("n").alias("weight"))
        total = weight.agg(F.sum("weight")).first()[0] or 0
        group = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-int(total) // GROUP_SHINGLES))))
        clusters = found.join(weight, "label").select(F.col("node").alias("sid"), "label", "weight", group.alias("group"))
        clusters = self._write(clusters, "join-clusters")
        self._drop(found)
        whole = clusters.where(F.col("weight") <= CLUSTER_SHINGLES).select("sid", "group")
        picked, own = self._with_sets(whole, sets)
        own = own.select("group", "sid", "hashes")
        of = _renamed(pairs.join(_renamed(whole), F.col("a") == F.col("sid")).select("group", "a", "b"))
        links = own.groupBy("group").cogroup(of.groupBy("group")).applyInArrow(_verify_group(self.percent), "a long, b long")
        links = self._write(links, "join-links")
        self._drop(picked, pairs)
        larger = clusters.where(F.col("weight") > CLUSTER_SHINGLES).join(sizes, "sid")
        larger = self._write(larger.select(F.col("label").alias("region"), "sid", "n"), "join-larger")
        self._drop(clusters)
        return links, larger

    def _with_sets(self, members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``members`` as a table, and with their sets; the sets are not shuffled for it where the members are few."""
        members = self._write(members, "join-picked")
        few = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
        return members, sets.join(few, "sid")

    def _divide(self, members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One level of pivots: the links to them, and the members of the cells (region, sid, n, parent_size)."""
        slot = F.pmod(F.xxhash64("sid", "region"), F.lit(PIVOTS))
        pick = F.min(F.struct(F.xxhash64("region", "sid").alias("o"), "sid"))
        pivots = members.groupBy("region", slot.alias("slot")).agg(pick.alias("p")).select("region", F.col("p.sid").alias("sid"))
        counts = members.groupBy("region").agg(F.count("*").alias("members"))
        n_chunks = F.ceil(F.col("members") / CHUNK).cast("long")
        left = members.join(counts, "region").withColumn("chunk", F.pmod(F.xxhash64("sid"), n_chunks))
        chunks, left = self._with_sets(left.select("region", "chunk", "sid", "n"), sets)
        right = pivots.join(counts, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)))
        picked, right = self._with_sets(right.select("region", "chunk", "sid"), sets)
        right = _renamed(right)
        found = left.groupBy("region", "chunk").cogroup(right.groupBy("region", "chunk")).applyInArrow(_cells(self.percent), _CELL)
        found = self._write(found, "join-cells")
        self._drop(chunks, picked)
        links = found.where("a is not null").select("a", "b")
        cells = found.where("region is not null").withColumn("distance", 1 - F.col("both") / F.col("size"))
        linked = 100 * F.col("both") >= self.percent * F.col("size")
        # a linked member stays only if a member that is not linked may be its partner
        reach = cells.groupBy("region").agg(F.min(F.when(~linked, F.col("distance"))).alias("reach"))
        slack = (100 - self.percent) / 100 + 1e-9
        kept = cells.join(reach, "region").where(~linked | (F.col("distance") >= F.col("reach") - slack))
        return links, kept.select("region", "sid", "n")

    def _compare(self, members: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
        """Links of regions that stay large: members outside the region's largest component against all of it."""
        found = self._hold(connected(links))
        named = members.join(found, members["sid"] == found["node"], "left")
        named = self._write(named.select("region", "sid", F.coalesce("label", "sid").alias("label")), "join-named")
        self._drop(found)
        sizes = named.groupBy("region", "label").agg(F.count("*").alias("n"))
        main = sizes.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"))
        blocks = F.ceil(F.col("members") / CHUNK).cast("long")
        named = named.join(main, "region")
        mine = F.pmod(F.xxhash64("sid"), blocks)
        every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        columns = ["region", "sid", "label"]
        # open members in blocks of their own meet every block of the region
        left = named.where("label <> main").withColumn("o", mine).withColumn("b", every).select(*columns, "o", "b")
        slots = left.select("region", "o").distinct()
        right = named.withColumn("b", mine).join(slots, "region").select(*columns, "o", "b")
        key = ["region", "o", "b"]
        (opened, left), (picked, right) = self._with_sets(left, sets), self._with_sets(right, sets)
        right = _renamed(right)
        links = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_blocks(self.percent), "a long, b long")
        links = self._write(links, "join-links")
        self._drop(opened, picked)
        return links

    def links(self) -> DataFrame:
        """(a, b): links between classes, enough of them to connect every pair that links."""
        windows = self._windows()
        sets = self._payload(windows)
        members, read = windows.select(F.col("h").alias("region"), "sid", "n", "place"), windows
        done: list[DataFrame] = []
        for level in range(LEVELS + 1):
            sized = members.groupBy("region").agg(
                F.count("*").alias("members"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("name")
            )
            few = sized.where((F.col("members") <= self.region) & (F.col("members") > 1)).select("region")
            common = common_shingles(self.percent) if level == 0 else 1
            found, larger = self._pairs(members.join(few, "region", "left_semi"), sets, common)
            done.append(found)
            # regions of the same members are one
            large = sized.where(F.col("members") > self.region).groupBy("members", "name").agg(F.min("region").alias("region"))
            large = members.join(large.select("region"), "region", "left_semi").select("region", "sid", "n")
            members = self._write(large.select("region", "sid", "n").unionByName(larger), "join-members")
            self._drop(read, larger)
            read = members
            if not members.limit(1).count():
                break
            if level == LEVELS:
                done.append(self._compare(members, sets, self._union(done)))
                break
            before = members.count()
            links, cells = self._divide(members, sets)
            done.append(links)
            cells = self._write(cells, "join-members")
            if cells.count() > before:  # pivots no longer divide: replicas outgrow the cells
                done.append(self._compare(members, sets, self._union(done)))
                break
            self._drop(read)
            members = read = cells
        self._drop(sets)
        return self._union(done)

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def components(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, n_classes (texts with different sets in the component)."""
        found = self._hold(connected(self.links()))
        labelled = self.classes.join(found, self.classes["sid"] == found["node"], "left")
        labelled = labelled.select("sid", "s2", "n", "doc_id", F.coalesce("label", "sid").alias("label"))
        tops = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_classes"))
        tops = labelled.join(tops, "label").select("sid", "s2", F.col("n").alias("__n"), "component_id", "n_classes")
        tops = write_table(tops, "join-tops")
        self._drop(*self._held)
        own = self.documents
        joined = own.join(tops, (own["s1"] == tops["sid"]) & (own["s2"] == tops["s2"]) & (own["n"] == tops["__n"]), "left")
        empty = F.col("n") == 0
        return joined.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_classes", F.lit(1)).cast("long").alias("n_classes"),
        )


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, n_classes: one per row of ``docs``.

    Two documents link when 100 x intersection >= ``percent`` x union of their
    sets of distinct ``words``-word shingles (a text of fewer words is one
    shingle); component_id is the smallest doc_id that links reach. Documents
    without words (null, empty, blank) link with nothing. Rows that share a
    doc_id are documents of their own; a null doc_id is never the smallest
    unless all in the component are null.
    """
    return JaccardJoin(docs, words, percent).components()


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rn, doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
  FROM (SELECT rn, doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rn, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY rn),
e AS (
  SELECT x.rn AS a, y.rn AS b
  FROM (SELECT x.rn AS xr, y.rn AS yr, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.rn < y.rn GROUP BY 1, 2)
  JOIN n x ON x.rn = xr JOIN n y ON y.rn = yr WHERE 100 * same >= 90 * (x.n + y.n - same)),
p AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT * FROM (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM p UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a) SELECT * FROM t)),
c AS (SELECT a AS rn, min(n.doc_id) AS low FROM r JOIN n ON n.rn = r.b GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (rn) LEFT JOIN c USING (rn)
"""


@query("op10_ngram_join", ORACLE)
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
