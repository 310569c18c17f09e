"""Prefix trie of conversations, rolled up by depth bands.

A node is a sequence of first turns. Its key is the XOR of two 64-bit hashes of
(role, text, place) over its turns, so keys of all prefixes are running XORs
and need no texts. Rows are dealt by range of (conversation, turn), not by
conversation: places and running XORs are taken per (range, conversation) and
carried over by the totals of the ranges before, so that a conversation of any
length is spread over tasks.

Sums over subtrees go by bands of ``BAND`` depths. A node explodes only to its
ancestors in its own band; that completes the sums of the deepest band. The
tops of the bands form a trie of their own, ``BAND`` times lower, which is
rolled up in the same way; its completed totals then go to the ancestors in the
band above each top. Rounds grow with the logarithm of the depth, and every
node is exploded at most ``BAND`` times a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetseries.session import write_table

from .common import small_batches, table
from .joins import lookup
from .queries import query

#: Conversations of a family share the first turns of the family's first id.
FAMILY = 20
#: A conversation takes over fewer than this many turns.
SHARED = 4
#: Depths of a band.
BAND = 16
#: Ids whose value agrees but for this many low bits are joined into one text.
CHUNK_BITS = 12

WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["k1", "k2"]


def _family(c: Column) -> Column:
    return c - c % FAMILY


def _taken(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % SHARED).cast("long")


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, part, depth, h1, h2, words) and one row (conv_id, length) per conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("uid"),
    )
    # equal rows of one conversation may fill several ranges: the row number tells them apart
    rows = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "h1", "h2", "uid")
    rows = write_table(rows.withColumn("part", F.spark_partition_id()), "trie-rows")

    piece = Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2", "uid")
    pieces = rows.groupBy("part", "conv_id").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    pieces = pieces.select(
        "part", "conv_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"), F.sum("count").over(whole).alias("own")
    )
    pieces = write_table(pieces, "trie-pieces")
    heads = pieces.where((F.col("conv_id") % FAMILY == 0) & (F.col("offset") == 0)).select(
        F.col("conv_id").alias("family"), F.col("own").alias("head")
    )
    taken = F.least(_taken(F.col("conv_id")), F.coalesce("head", F.lit(0)))
    pieces = pieces.withColumn("family", _family(F.col("conv_id"))).join(heads, "family", "left").select(
        "part", "conv_id", "family", "offset", "own", taken.alias("taken"),
        (taken + F.greatest(F.col("own") - _taken(F.col("conv_id")), F.lit(0))).alias("length"),
    )
    pieces = write_table(pieces, "trie-pieces")
    numbered = rows.withColumn("at", F.row_number().over(piece).cast("long")).join(
        pieces.select("part", "conv_id", "offset", "taken"), ["part", "conv_id"]
    )
    numbered = write_table(
        numbered.select("conv_id", "part", (F.col("at") + F.col("offset")).alias("at"), "taken", "h1", "h2", "words"), "trie-numbered"
    )
    skipped = _taken(F.col("conv_id"))
    own = numbered.where(F.col("at") > skipped).select(
        "conv_id", "part", (F.col("at") - skipped + F.col("taken")).alias("depth"), "h1", "h2", "words"
    )
    heads = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < SHARED)).select(
        F.col("conv_id").alias("family"), F.col("at").alias("depth"), "h1", "h2", "words"
    )
    convs = pieces.where("offset = 0").select("conv_id", "family", "taken", "length")
    first = convs.join(heads, "family").where(F.col("depth") <= F.col("taken")).select(
        "conv_id", F.lit(-1).alias("part"), "depth", "h1", "h2", "words"
    )
    return own.unionByName(first), convs.select("conv_id", "length")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """Rows conv_id, depth, k1, k2 (key), p1, p2 (key of the parent), words of every turn."""
    hashed = rebuilt.select(
        "conv_id", "part", "depth", F.xxhash64("h1", "depth").alias("i1"), F.xxhash64("h2", "depth").alias("i2"), "words"
    )
    hashed = write_table(hashed, "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("part", "conv_id").agg(F.bit_xor("i1").alias("x1"), F.bit_xor("i2").alias("x2"))
    totals = totals.select(
        "part", "conv_id", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(o) for x, o in (("x1", "o1"), ("x2", "o2"))]
    )
    upto = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("*", F.bit_xor("i1").over(upto).alias("r1"), F.bit_xor("i2").over(upto).alias("r2"))
    keyed = running.join(totals, ["part", "conv_id"])
    k1, k2 = F.col("r1").bitwiseXOR(F.col("o1")), F.col("r2").bitwiseXOR(F.col("o2"))
    return keyed.select(
        "conv_id", "depth", k1.alias("k1"), k2.alias("k2"),
        k1.bitwiseXOR(F.col("i1")).alias("p1"), k2.bitwiseXOR(F.col("i2")).alias("p2"), "words",
    )


def _paths(keyed: DataFrame, height: int) -> DataFrame:
    """Per conversation and band of ``BAND`` steps of ``height`` depths: the keys of its prefixes there, top first."""
    step = F.floor(F.col("depth") / height)
    rows = keyed.where(F.col("depth") % height == 0).groupBy("conv_id", F.floor(step / BAND).alias("band"))
    return rows.agg(F.sort_array(F.collect_list(F.struct(step.alias("step"), "k1", "k2"))).alias("path"))


def _to_ancestors(nodes: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """Sums of leaves and saved over each node's subtree as far as its band reaches.

    ``nodes`` are those whose depth divides by ``height``; the nodes that one
    conversation stands for in one band are added up before they are sent.
    """
    step = F.floor(F.col("depth") / height)
    own = nodes.groupBy("conv_id", F.floor(step / BAND).alias("band")).agg(
        F.collect_list(F.struct(step.alias("step"), "leaves", "saved")).alias("own")
    )
    met = own.join(paths, ["conv_id", "band"]).select("own", F.explode("path").alias("to"))
    below = F.filter("own", lambda o: o["step"] >= F.col("to.step"))
    zero = F.lit(0).cast("long")
    sent = met.withColumn("below", below).where(F.size("below") > 0).select(
        "to.k1", "to.k2",
        F.aggregate("below", zero, lambda a, o: a + o["leaves"]).alias("leaves"),
        F.aggregate("below", zero, lambda a, o: a + o["saved"]).alias("saved"),
    )
    return sent.groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _rolled(nodes: DataFrame, keyed: DataFrame, deepest: int, height: int = 1) -> DataFrame:
    """Rows k1, k2, leaves, saved: whole subtree sums of ``nodes``, whose depths divide by ``height``."""
    paths = write_table(_paths(keyed, height), "trie-paths")
    sums = _to_ancestors(nodes, paths, height)
    bands = BAND * height
    if deepest < bands:
        return sums
    place = nodes.select(*_KEY, "conv_id", "depth")
    sums = write_table(place.join(sums, _KEY), "trie-bands")
    tops = sums.where(F.col("depth") % bands == 0)
    done = _rolled(tops, keyed, deepest, bands)
    done = write_table(place.where(F.col("depth") % bands == 0).join(done, _KEY), "trie-tops")
    above = done.where("depth > 0").withColumn("band", F.floor(F.col("depth") / bands) - 1).join(paths, ["conv_id", "band"])
    sent = above.select("leaves", "saved", F.explode("path").alias("to")).groupBy("to.k1", "to.k2").agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    both = sums.join(sent, _KEY, "left")
    return both.select(
        *_KEY, (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each key, joined by commas as they come (rows of a key are adjacent and in order)."""
    names = ["k1", "k2", "ends_sha256"]
    key, state = None, None
    for batch in batches:
        out = []
        for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids").to_pylist()):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
    if key is not None:
        yield pa.RecordBatch.from_pydict(dict(zip(names, ([key[0]], [key[1]], [state.hexdigest()]))))


def _ends(ends: DataFrame) -> DataFrame:
    """Rows k1, k2, ends_sha256. Ids are joined in chunks of near values; the chunks of a key stream through one task."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    texts = ends.groupBy(*_KEY, chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = texts.select(*_KEY, "chunk", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))
    ordered = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids")
    return ordered.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text; other columns are not
    read. Turns stand in order of ``turn``, null first; turns of one number in the
    order of a hash of role and text, so that repeated rows are turns of their own
    and the result does not depend on the order of the table. Null role or text
    is empty. Rows without a conv_id belong to no conversation. Ids below zero
    have families like the others (the remainder has the sign of the id). A table
    without conversations gives no rows, not even a root.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    small_batches(conversations.sparkSession)
    rebuilt, convs = turns(conversations)
    keyed = write_table(prefixes(rebuilt), "trie-prefixes")
    zero = F.lit(0).cast("long")
    total = convs.agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.max("length").alias("deepest")).first()

    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("words"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
    )
    nodes = keyed.groupBy(*_KEY).agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    nodes = write_table(nodes.unionByName(top), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    nodes = write_table(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")

    root = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))
    steps = keyed.select("conv_id", "depth", *_KEY).unionByName(root)
    sums = _rolled(nodes.select(*_KEY, "conv_id", "depth", "leaves", "saved"), steps, total["deepest"] or 0)
    sums = sums.select(*_KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    # the last turn of a conversation has its length as depth; the deepest step of each is its end
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "depth").alias("k")).select("conv_id", "k.k1", "k.k2")
    ends = _ends(last.unionByName(convs.where("length = 0").select("conv_id", zero.alias("k1"), zero.alias("k2"))))

    out = nodes.join(sums, _KEY).join(ends, _KEY, "left")
    out = write_table(out.select(
        "p1", "p2", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ), "trie-out")
    parents = nodes.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__size")
    )
    below = lookup(out.where("depth > 0"), parents, ["p1", "p2"], "__size", out.count())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    root = out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.select(*columns).unionByName(root.select(*columns))


ORACLE = rf"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
cs AS (
  SELECT c, max(i) AS own, c - c % {FAMILY} AS fam,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
             lambda acc, x: list_reduce(list_prepend(xor(acc, x), list_transform(range(8), lambda b: CAST(b AS BIGINT))),
                 lambda z, b: xor(z >> 1, (z & 1) * 3988292384))), 4294967295) % {SHARED} AS h
  FROM o GROUP BY c),
k AS (SELECT cs.c, cs.own, cs.fam, cs.h, least(cs.h, coalesce(f.own, 0)) AS taken FROM cs LEFT JOIN cs f ON f.c = cs.fam),
t AS (
  SELECT k.c, o.i AS d, o.role, o.text FROM k JOIN o ON o.c = k.fam AND o.i <= k.taken
  UNION ALL SELECT k.c, k.taken + o.i - k.h, o.role, o.text FROM k JOIN o ON o.c = k.c AND o.i > k.h),
p AS (
  SELECT c, d, to_json(list(struct_pack(r := role, t := text)) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t
  UNION ALL SELECT c, 0, '[]', 0 FROM k),
l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (
  SELECT p.node, min(p.d) AS depth, min(p.c) AS conv_id, count(*) AS n_convs, min(p.words) AS words,
         sha256(coalesce(string_agg(CASE WHEN l.len = p.d THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends_sha256
  FROM p JOIN l ON l.c = p.c GROUP BY p.node),
up AS (
  SELECT n.node, par.node AS parent, pn.conv_id AS parent_conv_id FROM n
  JOIN p par ON par.c = n.conv_id AND par.d = n.depth - 1 JOIN n pn ON pn.node = par.node),
ch AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
x AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.node = n.node),
s AS (
  SELECT p.node, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM x JOIN p ON p.c = x.conv_id AND p.d <= x.depth GROUP BY p.node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, up.parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.node = x.node LEFT JOIN up ON up.node = x.node
"""


@query("op11_conversation_trie", ORACLE)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
