"""Operators on texts against brute force and the tokenizer library, with edge cases."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from fleetseries import session  # noqa: E402
from fleetseries.llm import components as comp  # noqa: E402
from fleetseries.llm import decontaminate as wm  # noqa: E402
from fleetseries.llm import license_scan as lic  # noqa: E402
from fleetseries.llm import line_dedup as ld  # noqa: E402
from fleetseries.llm import ngram_join as nj  # noqa: E402
from fleetseries.llm import piece_codec as pc  # noqa: E402
from fleetseries.llm import token_count as tc  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_chars long, n_tokens string"


def frame(spark, rows):
    """Documents with an extra column whose name clashes with a result."""
    return spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], SCHEMA)


def odd_texts(seed=3, n=150):
    rnd = random.Random(seed)
    letters = "aaabehtin  .,\té漢字☃🙂<s>0Z\n▁"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [*texts, None, "", " ", "\n", " " * 100 + "word", "ab" * 3000, "=-" * 900, "<s></s>"]


def test_token_counts_equal_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    got = tc.token_counts(frame(spark, enumerate(texts)), MODEL).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == {
        (i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts)
    }
    assert tc.token_counts(frame(spark, []), MODEL).count() == 0


def best_split(word, pieces, score, unknown):
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):  # the longest last piece comes first and stays on ties
            piece = word[start:end]
            if piece in pieces:
                total = best[start][0] + score[pieces[piece]]
            elif end - start == 1:
                total = best[start][0] + unknown
            else:
                continue
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[start][1] + [piece])
    return best[-1][1]


def test_encoding_is_the_best_split_and_decodes(spark):
    vocab = pc.vocabulary(MODEL)
    table = pc.piece_table(MODEL)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("aehtinors,.é") for _ in range(rnd.randint(1, 14))) for _ in range(200)]
    ids, sizes = pc.encode_texts(words, MODEL)
    for word, own in zip(words, np.split(ids, np.cumsum(sizes)[:-1])):
        assert [vocab.names[i] for i in own] == best_split("▁" + word, vocab.pieces, vocab.score, table.unknown)
    texts = odd_texts(5)
    rows = pc.decode(pc.encode(frame(spark, enumerate(texts)), MODEL), MODEL).collect()
    assert {r.doc_id: r.decoded for r in rows} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert all(r.n_tokens == len(r.token_ids) for r in rows)


def test_round_trip_in_one_step_equals_both_steps(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts(8) + ["many words of one text " * 400]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    want = sorted(repr((i, sp.encode(t or ""), hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest())) for i, t in rows)
    for cache, chars, step in ((pc.CACHE, pc.CACHE_CHARS, pc.DECODED_IDS), (50, 300, 64)):  # caches that start afresh, rows decoded one by one
        monkeypatch.setattr(pc, "CACHE", cache)
        monkeypatch.setattr(pc, "CACHE_CHARS", chars)
        monkeypatch.setattr(pc, "DECODED_IDS", step)
        encoder = list(pc._round_tripper(MODEL)(frame(spark, rows).select("doc_id", "text").fillna("").toArrow().to_batches()))
        got = [r for batch in encoder for r in batch.to_pylist()]
        assert sorted(repr((r["doc_id"], r["token_ids"], r["decoded_sha256"])) for r in got) == want
        assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in got)
        ids = {r["doc_id"]: hashlib.sha256(np.array(r["token_ids"], "<i4").tobytes()).hexdigest() for r in got}
        assert all(ids[r["doc_id"]] == r["ids_sha256"] for r in got)
    assert pc.round_trip(frame(spark, rows), MODEL).count() == len(rows)
    assert pc.round_trip(frame(spark, []), MODEL).count() == 0


def brute_contamination(text, items, window):
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    own, hit, found = words(text), set(), set()
    for item, body in items:
        target = words(body)
        n = min(window, len(target))
        for k in range(len(target) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == target[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, pattern_bytes):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice(["a", "B", "c,", "Éa", "d-e"]) for _ in range(n))
    items = [(i, text(rnd.randint(1, 12))) for i in range(8)] + [(20, None), (21, "..."), (None, "a b"), (22, "zz zz"), (23, "ZZ, zz")]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "zz zz zz"), (52, "zz zz zz"), (None, "zz-ZZ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = wm.decontaminate(frame(spark, docs), bench, 4, pattern_bytes).collect()
    want = [(i, *brute_contamination(t, [x for x in items if x[0] is not None], 4)) for i, t in docs]
    spans = lambda s: sum(s[1::2]) - sum(s[::2])
    assert sorted(map(repr, ((r.doc_id, r["__found"].n_words, spans(r["__found"].hit_words), r["__found"]["items"]) for r in got))) == sorted(
        map(repr, want)
    )
    empty = wm.decontaminate(frame(spark, docs), bench.limit(0), 4)
    assert empty.where("size(__found.items) > 0").count() == 0


def brute_lines(texts, least):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    seen = defaultdict(set)
    for k, t in enumerate(texts):
        for line in (t or "").split("\n"):
            seen[key(line)].add(k)
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or len(seen[key(x)]) < least) for t in texts]


def test_line_dedup_equals_brute_force_and_is_reversible(spark):
    rnd = random.Random(4)
    lines = ["Menu", " menu\t", "ÉTÉ", "été", "", "x", "long line " * 30, "one"]
    texts = ["\n".join(rnd.choice(lines + [str(k)]) for _ in range(rnd.randint(1, 6))) for k in range(30)] + [None, "", "Menu", "Menu"]
    docs = frame(spark, enumerate(texts))
    index = ld.LineIndex(spark, min_docs=5).insert(docs)
    for cleaned in (index.clean(docs), index.clean_by_join(docs)):
        assert {r.doc_id: r["__lines"].kept for r in cleaned.collect()} == dict(enumerate(brute_lines(texts, 5)))
    rest = docs.where("doc_id % 3 <> 0")
    reverted = index.delete(docs.where("doc_id % 3 = 0"))
    fresh = ld.LineIndex(spark, min_docs=5).insert(rest)
    counts = lambda x: sorted(map(tuple, x.counts().select("h1", "h2", "n").collect()))
    assert counts(reverted) == counts(fresh)
    assert sorted(map(str, reverted.clean(rest).collect())) == sorted(map(str, fresh.clean(rest).collect()))


def test_cuckoo_filter_keeps_every_key_and_deletes():
    rnd = np.random.default_rng(1)
    h1, h2 = (rnd.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    kept = ld.CuckooFilter.sized(5000)
    assert kept.insert(h1, h2) and kept.contains(h1, h2).all()
    kept.delete(h1[:2500], h2[:2500])
    assert kept.contains(h1[2500:], h2[2500:]).all() and kept.contains(h1[:2500], h2[:2500]).mean() < 0.01


def brute_components(texts, percent=90):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets, top = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {(k, len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize("region", [32, 2])
def test_jaccard_components_equal_brute_force(spark, region):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    texts = [None, "", "  \n", "one", "One", "one two", "two one"]
    for _ in range(8):
        base = [word() for _ in range(rnd.randint(9, 90))]
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    got = nj.JaccardJoin(frame(spark, enumerate(texts)), region=region).components().collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_jaccard_components_of_odd_rows(spark):
    same = "a b c d e f g h i j k l"
    rows = [(5, same), (5, same), (None, same), (7, None), (None, "x y z"), (9, same.upper())]
    got = sorted(map(repr, ((r.doc_id, r.component_id) for r in nj.jaccard_components(frame(spark, rows)).collect())))
    assert got == sorted(map(repr, [(5, 5), (5, 5), (None, 5), (7, 7), (None, None), (9, 5)]))
    assert nj.jaccard_components(frame(spark, [])).count() == 0


def test_license_lines(spark):
    rows = [(1, "x\nReleased under the MIT License!\nfoo bar"), (2, None), (3, ""), (4, "licensed under CC BY-NC 4.0"), (4, "word")]
    found = {(r.doc_id, tuple(m.license for m in r.matches)) for r in lic.scan_licenses(frame(spark, rows)).collect()}
    assert found == {(1, ("MIT",)), (2, ()), (3, ()), (4, ("CC-BY-NC-4.0",)), (4, ())}


def test_items_digest_is_of_sorted_strings(spark, tmp_path):
    frame(spark, [(1, "q w e r t y u i o p")]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(10, "q w e r t y u i o p"), (9, "Q W E R T Y U I O P")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    row = wm.op7_decontaminate(spark, str(tmp_path)).first()
    assert (row.n_hit, row.n_items, row.items_sha256) == (10, 2, hashlib.sha256(b"10,9").hexdigest())


def test_ids_are_those_of_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(8)
    words = "under Licensed the misunderstanding of straightforward — naïve Übergröße 漢字 ☃ 🙂 x=1; foo_bar() it's\tand\n".split(" ")
    whole = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(20)]
    texts = [*odd_texts(9), *whole, "under", "Licensed", " " * 67 + "a" + " " * 33 + "b  c   "]
    got = {r.doc_id: r.token_ids for r in pc.encode(frame(spark, enumerate(texts)), MODEL).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}


def test_candidates_of_a_region_are_connected_by_fewer_pairs_than_members(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base, *(rnd.choice("abcdefgh") + str(k) for _ in range(2))]) for k in range(24)]
    seen = []
    connect = nj.connected

    def counted(links):
        assert "MapInArrow" not in links._jdf.queryExecution().toString()  # both directions of one forest
        seen.append(links.count())
        return connect(links)

    monkeypatch.setattr(nj, "connected", counted)
    got = {r.doc_id: r.component_id for r in nj.jaccard_components(frame(spark, enumerate(texts))).collect()}
    assert set(got.values()) == {0}
    # 24 near copies have 276 pairs
    assert seen and max(seen) <= 23 * 8


def test_forest_keeps_what_hangs_together(spark):
    rows = [(1, a, b) for a in range(6) for b in range(a + 1, 6)] + [(2, 0, 1), (2, 7, 8), (3, 8, 9), (3, 9, 8)]
    pairs = spark.createDataFrame(rows, "region long, a long, b long").coalesce(1)
    kept = pairs.sortWithinPartitions("region").mapInArrow(nj._forest, "a long, b long").collect()
    assert len(kept) == 5 + 2 + 1
    tops = {r.node: r.label for r in nj.connected(spark.createDataFrame(kept)).collect()}
    assert tops == {**dict.fromkeys(range(6), 0), 7: 7, 8: 7, 9: 7}


def test_a_join_leaves_only_the_tables_that_its_rows_come_from(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "with blank"))
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base, f"x{k}"]) for k in range(40)] + ["", None, "one two"]
    out = nj.JaccardJoin(frame(spark, enumerate(texts)), region=8).components()
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "with blank" / "fleetseries").iterdir())
    assert left == ["join-classes", "join-tops"]
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got == {**dict.fromkeys(range(40), 0), 40: 40, 41: 41, 42: 42}


def test_shuffle_files_go_with_the_write(spark):
    def stored():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before = stored()
    session.write_table(spark.range(1000).repartition(4, "id"), "shuffled")
    assert spark.conf.get(session.FREE_SHUFFLES) == "false"
    deadline = time.time() + 20
    while stored() > before and time.time() < deadline:
        time.sleep(0.2)
    assert stored() <= before


@pytest.mark.parametrize("limit", [7, 50, 500_000])
def test_components_join_fewer_links_than_nodes(spark, monkeypatch, limit):
    monkeypatch.setattr(comp, "TASK_LINKS", limit)
    rnd = random.Random(4)
    links = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(300)] + [(k, k + 1) for k in range(100, 160)] + [(None, 3), (-5, 900)]
    written = []
    write = comp.write_table
    monkeypatch.setattr(comp, "write_table", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    dropped = []
    monkeypatch.setattr(comp, "drop_table", dropped.append)
    got = {r.node: r.label for r in comp.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(20), 0), **dict.fromkeys(range(100, 161), 100), -5: -5, 900: -5}
    if limit > 400:  # one task: 83 nodes in 3 components
        assert dict(written)["cc-edges"].count() == 2 * (83 - 3)
    assert len(dropped) == len(written) - 1
