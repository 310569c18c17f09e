"""WARC, top-k search, main text, toxicity and the pipeline on small fixtures."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from fleetseries.llm import html_text as ht  # noqa: E402
from fleetseries.llm import inner_product as ip  # noqa: E402
from fleetseries.llm import toxicity as tox  # noqa: E402
from fleetseries.llm import warc  # noqa: E402
from fleetseries.session import write_table  # noqa: E402


def test_archives_round_trip_at_any_split(spark):
    rnd = random.Random(1)
    big = "".join(rnd.choice("abcdefgh<>é") for _ in range(300_000))
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", big), (None, "u", big), (7, "u", "z"), (7, "u", "z")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int")
    manifest = warc.write_archives(pages)
    for split in (1000, 8 << 20):
        got = warc.read_archives(manifest, split).collect()
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
            again = first is not None and page != first
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((page, len(data), digest, "revisit" if again else "response", first if again else None))
        assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))
        payload = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
        assert payload[5] == big and payload[1] == "<p>é</p>" and payload[3] == ""
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_reader_ignores_magic_that_starts_no_record(tmp_path):
    record = warc._record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), None, False)
    junk = warc.MAGIC + b"not a member" + zlib.compress(b"x")
    path = str(tmp_path / "a.warc.gz")
    with open(path, "wb") as f:
        f.write(junk + record + junk + record)
    size = os.path.getsize(path)
    assert len(list(warc.records(path, 0, size, size))) == 2
    assert sum(len(list(warc.records(path, a, min(a + 50, size), size))) for a in range(0, size, 50)) == 2


def brute_top(vectors, k=5):
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in whole:
        if qi % 3 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != qi and len(v) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "near", "ties"])
def test_top_products_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(ip, "BUCKET", 16)
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(4, 6))
    vectors = []
    for i in range(150):
        v = {"random": rnd.normal(size=6) * rnd.uniform(0.1, 5), "near": base[i % 4] + rnd.normal(size=6) * 0.05, "ties": base[i % 2]}[kind]
        vectors.append((i, [float(x) for x in v]))
    vectors += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [0.0] * 6), (205, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in ip.top_products(df, F.col("vec_id") % 3 == 0).collect())
    assert got == brute_top(vectors)


def test_blocks_of_a_page():
    page = (
        "<html><head><title>no</title><script>var a='</p>';</script></head><body class='has-sidebar'><header>Top<h1>Site</h1></header>"
        "<div class='cookie-notice'>We use</div><main><header><h1>T&eacute;st</h1></header><p>foo<b>bar</b> x<br>y<p>z &amp;"
        " <span class=ad>buy</span>q<!-- c --><section id='comments'><article>Nice!</article></section></main><footer>c</footer>"
    )
    assert " ".join(t for zone, t in ht.blocks(page) if zone == ht.ARTICLE) == "Tést foobar x y z & q"
    assert ht.blocks("") == [] and ht.blocks("<p") == [] and ht.blocks("a < b") == [(ht.REST, "a < b")]


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    menu = "Home News Sport Culture Weather Contact About Imprint Shop Jobs"
    texts = [f"the story number {k} tells of things w{k} that only this page x{k} knows y{k}" for k in range(12)]
    rows = [(k, f"http://Host.example/{k}", f"<div>{menu}</div><div>{t}</div><div>{menu.lower()}</div>", "e") for k, t in enumerate(texts)]
    rows += [(20, "http://other.example/", f"<div>{menu}</div>", "e"), (21, None, None, "e"), (22, "http://host.example/a", "<article>A &lt; b</article><nav>x</nav>", "e")]
    rows += [(30 + k, "http://copies.example/", "<div>the same page in three copies is a text of its own</div>", "e") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for chunk in (2000, 3):  # a host in one suffix array, and in several
        got = {r.page_id: r.text for r in ht.main_text(df, chunk_pages=chunk).collect()}
        assert [got[k] for k in range(12)] == texts
        assert (got[20], got[21], got[22]) == (menu, "", "A < b")
        assert {got[30 + k] for k in range(3)} == {"the same page in three copies is a text of its own"}
    assert ht.main_text(df.limit(0)).count() == 0


def test_the_host_decides_the_rest_of_marked_pages_and_spares_copies(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words[:30] + [own] + words[31:]) for own in ("x30", "y30")]
    rows = [(k, "http://near.example/", f"<div>{t}</div>") for k, t in enumerate(near)]
    foot = "all rights are reserved by the makers of this site since long ago"
    quote = "a passage of ten words that two of the pages quote"
    body = {k: " ".join(f"b{k}_{i}" for i in range(20)) + (f" {quote}" if k in (11, 12) else "") for k in range(10, 22)}
    rows += [(k, "http://part.example/", f"<main><h1>Title {k}</h1></main><div>{t}</div><div>{foot}</div><div>More</div>") for k, t in body.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (2000, 3):
        got = {r.page_id: r.text for r in ht.main_text(df, chunk_pages=chunk).collect()}
        assert [got[0], got[1]] == near  # near copies are one page
        assert {k: got[k] for k in body} == {k: f"Title {k} {t}" for k, t in body.items()}


def test_repeated_runs_against_brute_force(spark):
    rnd = random.Random(3)
    parts = [" ".join(f"p{k}_{i}" for i in range(9)) for k in range(6)]
    texts = [" ".join([*rnd.sample(parts, 2), *(f"own{k}_{i}" for i in range(30))]) for k in range(16)]
    df = spark.createDataFrame([(k, "http://h.example/", f"<div>{t}</div>") for k, t in enumerate(texts)], "page_id long, url string, html string")
    pages = [t.split() for t in texts]
    runs = [{tuple(p[i : i + ht.MIN_RUN]) for i in range(len(p) - ht.MIN_RUN + 1)} for p in pages]
    for chunk in (2000, 3):
        got = {r.page_id: r.text for r in ht.main_text(df, chunk_pages=chunk).collect()}
        for k, p in enumerate(pages):
            gone = set()
            for i in range(len(p) - ht.MIN_RUN + 1):
                if sum(tuple(p[i : i + ht.MIN_RUN]) in r for r in runs) >= max(2, ht.SHARE * len(pages)):
                    gone |= set(range(i, i + ht.MIN_RUN))
            assert got[k] == " ".join(w for i, w in enumerate(p) if i not in gone)


def test_the_host_decides_what_of_an_article_is_text(spark):
    own = lambda k, n=40: " ".join(f"a{k}_{i}" for i in range(n))
    sign = "sign up here to get all of our stories by mail each day"
    quote = "a passage of ten words that two of the articles quote"
    rows = [(k, "http://news.example/", f"<article><p>{own(k)}</p><p>{sign}</p>" + (f"<p>{quote}</p>" if k in (3, 4) else "") + "</article>") for k in range(12)]
    text = {k: own(k) + (f" {quote}" if k in (3, 4) else "") for k in range(12)}
    # near copies and copies of an article are one: most of the host's pages, and no boilerplate
    words = [f"n{k}" for k in range(200)]
    near = {20 + k: " ".join([*words[: 10 * k], f"x{k}", *words[10 * k + 1 :]]) for k in range(14)} | {k: own(40) for k in range(40, 50)}
    rows += [(k, "http://news.example/", f"<main>{t}</main><footer>{quote}</footer>") for k, t in near.items()]
    # two articles that share a passage may quote it; what a menu names is not repeated by it
    rows += [(60 + k, "http://two.example/", f"<nav>{own(60)}</nav><article>{own(60 + k)} {quote}</article>") for k in range(2)]
    rows += [(70 + k, "http://menu.example/", f"<nav>{own(70)}</nav><article>{own(70 + k)}</article>") for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = text | near | {60 + k: f"{own(60 + k)} {quote}" for k in range(2)} | {70 + k: own(70 + k) for k in range(4)}
    for chunk in (2000, 5):
        assert {r.page_id: r.text for r in ht.main_text(df, chunk_pages=chunk).collect()} == want


def test_runs_of_articles_against_brute_force(spark):
    rnd = random.Random(4)
    parts = [" ".join(f"p{k}_{i}" for i in range(9)) for k in range(6)]
    texts = [" ".join([*rnd.sample(parts, 2), *(f"own{k}_{i}" for i in range(60))]) for k in range(16)]
    texts += [f"{texts[k]} more{k}" for k in range(8)] + texts[8:10]  # eight near copies, two copies
    df = spark.createDataFrame([(k, "http://h.example/", f"<article>{t}</article>") for k, t in enumerate(texts)], "page_id long, url string, html string")
    pages = [t.split() for t in texts]
    names = {t: 0.5 if t in texts[:8] or t in texts[16:24] else 1.0 for t in texts}
    runs = {t: {tuple(t.split()[i : i + ht.MIN_RUN]) for i in range(len(t.split()) - ht.MIN_RUN + 1)} for t in names}
    cut = 0
    for chunk in (2000, 7, 2):
        got = {r.page_id: r.text for r in ht.main_text(df, chunk_pages=chunk).collect()}
        for k, p in enumerate(pages):
            gone = set()
            for i in range(len(p) - ht.MIN_RUN + 1):
                if sum(w for t, w in names.items() if tuple(p[i : i + ht.MIN_RUN]) in runs[t]) >= max(ht.ARTICLES, ht.SHARE * 16) - 1e-6:
                    gone |= set(range(i, i + ht.MIN_RUN))
            cut += len(gone)
            assert got[k] == " ".join(w for i, w in enumerate(p) if i not in gone)
    assert cut


def toxic_corpus(n=400, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(30, 80))]
        if i % 4 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["scumbag", "moronic", "worthless"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_separates_held_out_rows_and_misspellings(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    truth = {i: y for i, _, y in rows}
    got = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in held]) >= 0.9
    plain, near = model.word_scores(["tornaise", "worthlesss"])
    assert near > plain
    odd = spark.createDataFrame([(1, None), (None, ""), (3, " ")], "doc_id long, text string")
    assert all(r.score < 0.5 for r in tox.score(odd, model).collect())
    assert tox.score(docs.limit(0), model).count() == 0


def test_pipeline_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, t) for i, t, y in toxic_corpus(200, 5) if not y]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(i, t + "\nshared line") for i, t in clean]
    docs += [(1000, clean[0][1] + "\nshared line"), (1001, f"before it {passage} after"), (1002, None), (1003, "")]
    docs += [(2000 + i, t) for i, t, y in toxic_corpus(400, 1) if y]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 2000)) for i, _ in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not [i for i in got if i >= 2000 or i == 1001]  # toxic texts and the benchmark passage are gone
    assert (clean[0][0] in got) != (1000 in got)  # one of two copies stays
    assert {1002, 1003} <= got.keys() and len(got) >= 0.95 * len(clean)
    assert all(r.round_trip for r in got.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "piece_codec"]


def test_near_copies_of_the_pipeline_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    shingles = lambda t, n: {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)}
    alike = lambda x, y, n: len(shingles(x, n) & shingles(y, n)) / len(shingles(x, n) | shingles(y, n))
    texts = []
    for k in range(8):
        base = [word() for _ in range(100 + 20 * k)]
        for changed in range(k % 4 + 1):  # 0 to 3 words replaced, in places far apart
            own = list(base)
            for c in range(changed):
                own[20 + 30 * c] = word()
            texts.append(" ".join(own))
    between = [(x, y) for x in texts for y in texts if x < y and 0.8 <= alike(x, y, 5) < 0.9 and alike(x, y, 3) < 0.9]
    assert between  # pairs that op10's 3 words and 90 % do not link
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if alike(texts[a], texts[b], 5) >= 0.8:
                top = [top[b] if x == top[a] else x for x in top] if top[a] > top[b] else [top[a] if x == top[b] else x for x in top]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    got = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(path), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(top))


def test_near_copies_survive_other_splits_of_the_input(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    path = str(tmp_path / "documents.parquet")
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(k, words(k // 2)) for k in range(40)]  # each text twice
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id").write.parquet(path)
    components = corpus_pipeline._ngram_join.jaccard_components

    def components_then_fewer_cores(*args):
        found = write_table(components(*args), "components")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return found

    monkeypatch.setattr(corpus_pipeline._ngram_join, "jaccard_components", components_then_fewer_cores)
    spark.conf.set("spark.sql.files.minPartitionNum", "16")
    try:
        got = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(path), str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r.text for r in got) == sorted(words(k) for k in range(20))


def test_training_on_the_whole_sample_needs_little_memory():
    import tracemalloc

    assert tox.SAMPLE == 6000
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(4, 9))) for _ in range(30_000)]
    texts = [" ".join(rnd.sample(vocabulary, 500)) for _ in range(2400)]
    labels = np.arange(len(texts)) % 2
    tracemalloc.start()
    tox.train(iter(texts), labels, epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 1.2 million words of texts: 8 bytes each and blocks of bounded size
    assert peak < 75e6, peak


def test_archives_keep_pages_with_a_very_long_url(spark):
    rows = [(1, "http://a/" + "é" * 22_000, "<p>a</p>"), (2, "u", "<p>b</p>"), (3, "data:" + "x" * 200_000, "c")]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for split in (1000, 8 << 20):
        assert sorted(r.page_id for r in warc.read_archives(manifest, split).collect()) == [1, 2, 3]
    missing = manifest.withColumn("starts", F.concat("starts", F.array(F.lit(1).cast("long"))))
    with pytest.raises(Exception, match="the manifest has"):
        warc.read_archives(missing).collect()
