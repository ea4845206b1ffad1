from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestra.llm import history as h
from attestra.llm.words import words_of

REC = "crawl_id long, batch_no int, document_id string, sha256 string, final_url string, status string, at string"


def runs(t):
    w = words_of(t)
    return set(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


def near(a, b):
    x, y = runs(a), runs(b)
    return bool(x and y and len(x & y) >= 0.8 * len(x | y))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    common = [" ".join(rng.choices(vocab[:50], k=25)) for _ in range(4)]
    texts = []
    for n in (20, 24, 31, 33, 60, 64, 130, 300, 700, 1500):
        for _ in range(4):
            w = rng.choices(vocab, k=n)
            texts.append(" ".join(w))
            for rate in (0.01, 0.03, 0.06, 0.2):
                v = [rng.choice(vocab) if rng.random() < rate else x for x in w]
                texts.append(" ".join(v))
            texts.append(" ".join(w[:-1]).upper() + ",")
            texts.append(" ".join(w[1:] + ["tail"]))
    texts += [f"{common[i % 4]} {' '.join(rng.choices(vocab, k=40))} {common[(i + 1) % 4]}" for i in range(80)]
    texts += ["same words here " * 10] * 30 + ["", None, "few words only"]
    return texts


def test_links_against_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "id long, text string")
    members, links = h.near_identical(df)
    cls = {r["id"]: bytes(r["class"]) for r in members.collect()}
    got = {(bytes(r["a"]), bytes(r["b"])) for r in links.collect()}
    ids = [i for i, t in enumerate(corpus) if t and runs(t)]
    assert set(cls) == set(ids)
    want = {tuple(sorted((cls[i], cls[j]))) for i in ids for j in ids if i < j and cls[i] != cls[j] and near(corpus[i], corpus[j])}
    assert got == want and len(want) > 60
    same = {(i, j) for i in ids for j in ids if i < j and words_of(corpus[i]) == words_of(corpus[j])}
    assert same == {(i, j) for i in ids for j in ids if i < j and cls[i] == cls[j]}


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("https://www.a.example/x/?b=1&a=2#f", "http://A.example:80/x?a=2&b=1&utm_source=q", True), ("https://a.example:443/r%65port.pdf", "https://a.example/report.pdf", True),
        ("https://a.example/X", "https://a.example/x", False), ("https://a.example:8443/x", "https://a.example/x", False), ("https://a.example/a%2Fb", "https://a.example/a/b", False),
        ("https://a.example/x?id=1", "https://a.example/x?id=2", False), ("http://a.example", "https://www.a.example/", True), ("https://a.example/%zz", "https://a.example/%zz", True),
    ],
)
def test_address_key(spark, a, b, same):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(h.address_key(F.col("a")), h.address_key(F.col("b"))).first()
    assert x is not None and (x == y) is same


def test_file_key(spark):
    k = "ab" * 32
    got = spark.createDataFrame([(k,), (f"SHA256-{k.upper()}",), (f" sha256:{k}\n",), ("xyz",), (None,), (k + "0",)], "s string").select(h.file_key(F.col("s"))).collect()
    assert [r[0] for r in got] == [k, k, k, None, None, None]


def test_batch_repeats(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rec = [
        (1, 1, "d1", "aa" * 32, "https://a.example/1", "downloaded", "x"), (2, 1, "d2", "SHA256-" + "AA" * 32, None, "downloaded", "x"), (3, 2, "d1", None, None, "failed", "x"),
        (4, 2, "d4", "bb" * 32, "https://www.a.example/1/", "downloaded", "x"), (5, 2, "d5", None, None, "downloaded", "x"), (6, 3, "d6", None, None, "downloaded", "x"),
        (7, 3, None, None, "", "downloaded", "x"), (8, 3, "d8", "cc" * 32, None, "downloaded", "x"), (8, 3, "d8", "cc" * 32, None, "downloaded", "x"),
    ]
    docs = [(5, text), (6, text.upper().replace(" ", ",  ") + " more"), (7, None), (8, "short text"), (1, "short text")]
    r, t = spark.createDataFrame(rec, REC), spark.createDataFrame([(*x, "y") for x in docs], "crawl_id long, text string, class string")
    got = {x["record"]: (x["earliest"], x["by"]) for x in h.batch_repeats(r, t).collect()}
    assert got == {2: (1, ["sha256"]), 4: (1, ["final_url"]), 6: (5, ["text"])}
    assert h.batch_repeats(r.limit(0), t.limit(0)).count() == 0


def test_hot_key_is_reduced_to_its_earliest(spark):
    rec = spark.range(2000).selectExpr("id + 1 as crawl_id", "1 as batch_no", "'same' as document_id", "cast(null as string) as sha256", "cast(null as string) as final_url", "'downloaded' as status")
    got = h.batch_repeats(rec, spark.createDataFrame([], "crawl_id long, text string"))
    assert got.count() == 1999 and got.select("earliest").distinct().count() == 1


def test_history_batch_by_batch(spark, tmp_path):
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"v{i}" for i in range(900)], k=120)) for _ in range(6)]
    store = h.History(spark, f"file://{tmp_path}/store")
    schema = "crawl_id long, document_id string, sha256 string, final_url string, text string"
    one = store.add(spark.createDataFrame([(i, f"d{i}", None, None, t) for i, t in enumerate(base)], schema))
    assert {r["record"]: r["repeats"] for r in one.collect()} == dict.fromkeys(range(6))
    edited = base[2].replace("v1 ", "w ") + " end"
    two = store.add(spark.createDataFrame([(10, "d10", None, None, edited), (11, "d1", None, None, None), (12, "d12", "ab" * 32, None, "new"), (13, "d13", "AB" * 32, None, None), (14, None, None, None, None)], schema))
    assert {r["record"]: r["repeats"] for r in two.collect()} == {10: 2, 11: 1, 12: None, 13: 12, 14: None}
    assert store.add(spark.createDataFrame([], schema)).count() == 0
    assert store.accepted().count() == 8


def links_and_truth(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members, links = h.near_identical(df)
    cls = {r["id"]: bytes(r["class"]) for r in members.collect()}
    got = {(bytes(r["a"]), bytes(r["b"])) for r in links.collect()}
    sets = [runs(t) for t in texts]
    similar = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i + 1, len(texts)) if cls[i] != cls[j]}
    return got, {tuple(sorted((cls[i], cls[j]))): s for (i, j), s in similar.items() if s >= 0.8}


def edited(words, places):
    return " ".join(f"new{k}x{len(words)}" if k in places else w for k, w in enumerate(words))


def test_evenly_spaced_edits_lose_no_link(spark):
    rng = random.Random(5)
    texts = []
    for n in (400, 400, 400, 400, 500, 600):
        for _ in range(12):
            w = rng.choices([f"v{i}" for i in range(20000)], k=n)
            texts += [" ".join(w), edited(w, set(range(rng.randrange(4, 24), n, 28)))]
    got, want = links_and_truth(spark, texts)
    assert len(want) > 50 and max(want.values()) < 0.83 and got == set(want)


def test_gathered_edits_moved_blocks_and_boilerplate_lose_no_link(spark):
    rng = random.Random(9)
    word = lambda n: rng.choices([f"v{i}" for i in range(20000)], k=n)
    page = word(300)
    texts = []
    for n in (40, 90, 200, 450, 900):
        for share in (0.05, 0.09, 0.105):
            w = word(n)
            k, at = int(n * share), rng.randrange(n // 2)
            texts += [" ".join(w), edited(w, set(range(at, at + k)))]
            texts.append(" ".join(w[at + k :] + w[:at] + w[at : at + k]))  # blocks in another order
            texts.append(" ".join(w[:at] + word(k) + w[at:]))
    # one template with a filling of its own in each
    texts += [" ".join(page[:150] + word(12) + page[150:]) for _ in range(60)]
    got, want = links_and_truth(spark, texts)
    assert len(want) > 60 * 59 // 2 and got == set(want)


def test_texts_of_few_different_runs_and_hot_runs(spark):
    rng = random.Random(4)
    texts = ["same " * n for n in range(20, 60)] + ["one two " * n for n in range(10, 40)] + ["a b c " * n for n in range(7, 30)] + ["a b c d " * n + "a " * (n % 3) for n in range(6, 30)]
    head = [f"h{i}" for i in range(24)]
    texts += [" ".join(head[: 20 + i % 5] + [f"t{rng.randrange(9)}", f"u{rng.randrange(9)}"]) for i in range(60)]
    texts += [" ".join([f"p{k}" for k in range(28 + i % 14)]) for i in range(40)] + [" ".join([f"p{k}" for k in range(i % 5, 36)]) for i in range(10)]
    got, want = links_and_truth(spark, texts)
    assert len(want) > 300 and got == set(want)


def test_batch_by_batch_gives_what_the_whole_delivery_gives(spark, sf, tmp_path):
    from attestra.runtime import table

    rec, docs = table(spark, sf, "crawl_documents"), table(spark, sf, "documents")
    rec = rec.where("batch_no > 8")
    got = {tuple(r) for r in h.deliveries(rec, docs, f"file://{tmp_path}/h").collect()}
    want = {(r["record"], r["earliest"]) for r in h.batch_repeats(rec, docs).collect()}
    assert got == want and want


def test_chunks_are_looked_up_in_parts_and_their_shuffles_removed(spark, corpus, monkeypatch):
    import attestra.runtime as rt

    # a table's rows in a pass, and shuffle files that are there after each write
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get
    kept, sizes = [], []

    def cut(df, *a):
        before = {x.toString() for x in blocks()}
        out = rt.cut(df, *a)
        kept.append(len({x.toString() for x in blocks()} - before))
        if "df" in df.columns and "text" in df.columns and "side" not in df.columns:
            sizes.append(out.count())
        return out

    def blocks():
        found = status().blockManager().diskBlockManager().getAllBlocks()
        return [found.apply(i) for i in range(found.size()) if found.apply(i).toString().startswith("shuffle_")]

    monkeypatch.setattr(h, "cut", cut)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "id long, text string")
    want = {(bytes(r["a"]), bytes(r["b"])) for r in h.near_identical(texts)[1].collect()}
    assert len(sizes) == h.PASSES and min(sizes) > 0 and max(sizes) < sum(sizes) / 2
    assert sum(kept) == 0
    # ids of repeats instead of all are sent, or chunks are written once more; the links stay
    for most in (40, 0):
        monkeypatch.setattr(h, "BROADCAST_IDS", most)
        assert {(bytes(r["a"]), bytes(r["b"])) for r in h.near_identical(texts)[1].collect()} == want
