"""Conversation trie, embedding whitening and near-duplicate search against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetseries.llm import conversation_trie as ct
from fleetseries.llm import hnsw
from fleetseries.llm import vector_dedup as vd
from fleetseries.llm import whitening as wh

SCHEMA = "conv_id long, turn int, role string, text string, depth string, part int, k1 int"


def brute_trie(spark, rows):
    """Nodes of the trie by dictionaries over whole prefixes; ties of a turn in the order of the turn's hash."""
    df = spark.createDataFrame(rows, SCHEMA)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    df = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.xxhash64(F.lit(1), role, text).alias("h"))
    own = {}
    for r in sorted(df.where("conv_id is not null").collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.h)):
        own.setdefault(r.conv_id, []).append((r.role, r.text))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(family, [])[:h] + turns[h:]
    nodes, ends = {}, {}
    for c in sorted(rebuilt):
        seq = tuple(rebuilt[c])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    for key in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        below = kids.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) if below else 1
        saved[key] = (len(nodes[key]) - 1) * words + sum(saved[k] for k in below)
    return sorted(
        (m[0], len(key), None if not key else nodes[key[:-1]][0], len(m), len(kids.get(key, [])), leaves[key], saved[key],
         hashlib.sha256(",".join(map(str, ends.get(key, []))).encode()).hexdigest())
        for key, m in nodes.items()
    )


def trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(5)
    rows = []

    def add(c, turn, role, text):
        rows.append((c, turn, role, text, "x", 7, 1))

    texts = ["hello there", "", None, "a  b\tc", "übung macht", "ok\n ok"]
    for c in [*range(0, 90), -20, -19, -3, 10_020, 10_021, 9_000_000_000]:
        for t in range(rnd.randint(1, 7)):
            add(c, None if rnd.random() < 0.1 else t, rnd.choice(["user", "bot", None]), rnd.choice(texts))
    for t in range(700):  # deep enough for three levels of bands, and a copy that leaves it late
        add(100, t, "user", f"turn {t}")
        add(120, t, "user", f"turn {t}" if t < 520 else "else")
    for c in range(140, 200):  # many copies of one conversation
        for t in range(20):
            add(c, t, "bot", f"same {t}")
    rows += [r for r in rows if r[0] in (7, 11)]  # repeated rows
    add(None, 1, "user", "of nobody")
    rnd.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark, talk, monkeypatch):
    want = brute_trie(spark, talk)
    assert max(r[1] for r in want) >= 700
    df = spark.createDataFrame(talk, SCHEMA).repartition(5)
    assert trie_rows(ct.conversation_trie(df)) == want
    monkeypatch.setattr(ct, "BAND", 5)
    monkeypatch.setattr(ct, "CHUNK_BITS", 2)
    assert trie_rows(ct.conversation_trie(df)) == want


def test_trie_of_nothing(spark, talk):
    empty = spark.createDataFrame([], SCHEMA)
    assert ct.conversation_trie(empty).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", "", 0, 0)], SCHEMA)
    assert ct.conversation_trie(nobody).count() == 0


def brute_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    dev = ((n * x - sums) ** 2).sum(axis=1)
    c = ((n * fit - sums) / n).astype(float)
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)
    return n, dev, ((n * x - sums) / n).astype(float), values[order], axes[:, order]


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((400, 24)) @ rng.standard_normal((24, 24)) * 3).astype(np.float32)
    good[50:90] = good[50]  # repeated vectors count once
    rows = [(i, v.tolist(), "n") for i, v in enumerate(good)] + [(3, good[3].tolist(), "n"), (None, good[4].tolist(), "n")]
    bad = [(900, None, ""), (901, [], ""), (902, [None] + good[0].tolist()[1:], ""), (903, [float("nan")] * 24, ""),
           (904, [float("inf")] * 24, ""), (905, [1.0, 2.0], ""), (906, [3e38] * 24, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n string").repartition(4)
    got = wh.whiten(df).toPandas()
    n, dev, centred, values, axes = brute_whitening([r[1] for r in rows])
    assert len(got) == len(rows) * 16 and set(got.n) == {n} and sorted(set(got.component)) == list(range(1, 17))
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    place = {r[0]: i for i, r in enumerate(rows[:400])} | {None: len(rows) - 1}
    got["row"] = [place[None if np.isnan(v) else int(v)] for v in got.vec_id]
    assert all(int(d) == int(dev[r]) for d, r in zip(got.deviation, got.row))
    for k in range(16):
        part = got[got.component == k + 1]
        want = centred[part.row] @ axes[:, k] / np.sqrt(values[k])
        sign = np.sign(want @ part.whitened)
        assert np.abs(want - sign * part.whitened).max() < 1e-8
        assert np.abs(part.explained - values[k] / values.sum()).max() < 1e-12


def test_whitening_of_little_and_of_much(spark):
    schema = "vec_id long, embedding array<double>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # rank one, and entries whose squares pass 64 bits
    line = [(i, [1e9 * i, 0.0, -1e9 * i]) for i in range(5)]
    got = wh.whiten(spark.createDataFrame(line, schema)).toPandas()
    assert set(got.component) == {1} and got.identity_error.iloc[0] < 1e-9 and got.deviation.isna().any()
    # equal eigenvalues: the axes are free, the covariance is not
    cross = [(i, v) for i, v in enumerate(([4.0, 0.0, 0.0], [-4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, -4.0, 0.0], [0.0, 0.0, 4.0], [0.0, 0.0, -4.0]))]
    got = wh.whiten(spark.createDataFrame(cross, schema)).toPandas()
    assert set(got.component) == {1, 2, 3} and got.identity_error.iloc[0] < 1e-9
    assert np.abs(got.explained - 1 / 3).max() < 1e-12


def brute_links(rows, cosine=0.9):
    whole = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float) / max(map(abs, v))) / max(map(abs, v)) if ok else None for ok, (_, v) in zip(whole, rows)]
    near = [{j for j in range(len(rows)) if j != i and whole[i] and whole[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine} for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        label[i] = min(ids) if ids else None
    return sorted(map(repr, ((r[0], len(near[i]), label[i], r[0] is not None and r[0] == label[i]) for i, r in enumerate(rows))))


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, shard_rows):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((60, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k in range(60, 200):  # copies of one vector, tight and loose
        rows.append((k, (base[0] + rng.standard_normal(12) * rng.choice([0.01, 0.2, 0.45])).tolist()))
    for k in range(200, 230):
        rows.append((k, base[5].tolist()))  # exact copies, and one of another length
    rows += [(230, (base[5] * 1e30).tolist()), (231, (base[7] * 1e-30).tolist()), (232, [1.0, 2.0]), (233, [2.0, 4.0])]
    rows += [(234, None), (235, []), (236, [0.0] * 12), (237, [float("nan")] * 12), (238, [None] + [1.0] * 11), (3, base[9].tolist()), (None, base[9].tolist()), (None, base[11].tolist())]
    monkeypatch.setattr(vd, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vd, "BEAM", 2)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, uid int, v int").repartition(3)
    got = sorted(map(repr, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(df).collect())))
    assert got == brute_links(rows)


def test_near_duplicates_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert vd.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = vd.near_duplicates(spark.createDataFrame([(4, None), (5, [1.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_graph_finds_neighbours_and_survives_packing():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[1500:] = x[:1500] + 0.05 * rng.standard_normal((1500, 16)).astype(np.float32)
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph.build(x)
    again = hnsw.Graph.unpack(x, graph.pack())
    ids, sims = again.search(x[:300], 16)
    truth = np.argsort(-(x[:300] @ x.T), axis=1)[:, :2]
    assert np.mean([len(set(a) & set(b[:4])) / 2 for a, b in zip(truth.tolist(), ids.tolist())]) > 0.95
    assert (np.diff(sims, axis=1) <= 0).all() and len(graph.layers) == 3
    assert all((layer < len(layer)).all() for layer in graph.layers)
    assert hnsw.Graph.build(x[:1]).search(x[:2], 4)[0][:, 0].tolist() == [0, 0]
