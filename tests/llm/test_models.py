"""Ops 5, 9 and 10: held-out accuracy, planted leaks, and the odd cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roostwright.llm import decontaminate, language, textnum, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus(spark, n=240):
    r = random.Random(1)
    rows = [(i, words(r, ("aeiourstn", "äöüßchkz", "éèçouaiq")[i % 3], r.randint(5, 120)), ("xx", "yy", "zz")[i % 3], "s", 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_language_is_learnt_and_odd_texts_are_defined(spark):
    rows, docs = corpus(spark)
    net = language.train(docs.filter(F.col("doc_id") % 4 != 2), per_lang=60)
    odd = spark.createDataFrame([(1000, None, "xx", "s", 0), (1001, "", "xx", "s", 0), (1002, "123 — !", "xx", "s", 0), (1003, words(random.Random(2), "aeiourstn", 4000), "xx", "s", 0)], SCHEMA)
    got = {r.doc_id: r for r in language.predict(docs.unionByName(odd).withColumn("lang_pred", F.lit("clash")), net).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _, _ in rows if i % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred == "xx"
    assert all(0 <= g.score <= 1 for g in got.values())
    assert language.predict(docs.limit(0), net).count() == 0
    assert language.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    r = random.Random(8)
    rows = [(i, words(r, chr(0x4E00 + 40 * (i % 70)) + "ab", 60), f"l{i % 70:02}", "s", 0) for i in range(70 * 40)]
    net = language.train(spark.createDataFrame(rows[:-140], SCHEMA))
    assert net.langs == [f"l{n:02}" for n in range(70)]
    got = {x.doc_id: x.lang_pred for x in language.predict(spark.createDataFrame(rows[-140:], SCHEMA), net).collect()}
    right = [got[i] == lang for i, _, lang, _, _ in rows[-140:]]
    late = [got[i] == lang for i, _, lang, _, _ in rows[-140:] if lang >= "l64"]
    assert np.mean(right) > 0.5 and np.mean(late) > 0.5


@pytest.mark.parametrize("doc_id", [7, 8, None])
def test_languages_that_share_one_id_are_all_learnt(spark, doc_id):
    rows, _ = corpus(spark, 600)
    docs = spark.createDataFrame([(doc_id, t, lang, "s", i) for i, t, lang, _, _ in rows], SCHEMA)
    net = language.train(docs.unionByName(docs.filter("lang = 'zz'")), per_lang=60)
    assert net.langs == ["xx", "yy", "zz"]
    got = {x.n_chars: x.lang_pred for x in language.predict(docs, net).collect()}
    assert sum(got[i] == lang for i, _, lang, _, _ in rows) / len(rows) > 0.95


def test_tables_of_the_network_give_its_convolutions():
    r = np.random.default_rng(0)
    x = r.integers(0, 256, (50, language.WINDOW)).astype(np.uint8)
    net = language.fit(x, r.integers(0, 3, 50), list("abc"), epochs=1)
    f, _ = net.features(x)
    z = f @ net.out[1:] + net.out[0]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.abs(net.log_probs(x, net.tables()) - want).max() < 1e-4


def test_toxicity_is_learnt_from_positives_and_unlabelled(spark):
    r, bad = random.Random(3), ["grumbalot", "vexnoid", "snarkle"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        t = words(r, "aeioulmnrst", r.randint(20, 100)).split()
        for _ in range(3 if toxic else 0):
            t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append((i, " ".join(t), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fitted(spark, docs, lab)
    got = {x.doc_id: x.score for x in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i in range(500) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    hits = [got[i] >= 0.7 for i in held if i % 5 == 0]
    false = [got[i] >= 0.7 for i in held if i % 5]
    assert np.mean(hits) > 0.9 and np.mean(false) < 0.03
    odd = spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0), (3, "é" * 5000, "", "", 0)], SCHEMA)
    assert len({x.score for x in toxicity.score(odd, model).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, lab.filter("toxic = 0"))
    assert {round(x.score, 6) for x in toxicity.score(docs.limit(5), none).collect()} == {0.001}


def test_nn_pu_keeps_its_risk_from_going_negative():
    r = np.random.default_rng(0)
    xp, xu = r.normal(0, 1, (200, 5)).astype(np.float32), r.normal(0, 1, (1000, 5)).astype(np.float32)
    xp[:, 0] += 4
    xu[:200, 0] += 4
    w, b = toxicity.nn_pu(xp, xu, 0.2)
    score = 1 / (1 + np.exp(-(xu @ w + b)))
    assert score[:200].mean() > 0.8 and score[200:].mean() < 0.1


def leak_truth(texts, items, least=0.8, k=5):
    out = set()
    shing = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for i, item in enumerate(items):
            v = (item or "").lower().split()
            if not v or not w or len(w) < min(k, len(v)):
                continue
            n, want = min(len(v), len(w)), shing(v)
            for s in range(len(w) - n + 1):
                got = shing(w[s : s + n]) if len(v) >= k else Counter([tuple(w[s : s + n])])
                both = sum((got & want).values())
                if both >= least * sum((got | want).values()):
                    out.add((d, i))
                    break
    return out


def test_decontamination(spark):
    r = random.Random(4)
    items = [words(r, "abcdefgh", n) for n in (60, 40, 20, 12, 5, 3)] + [None, "", "word " * 30]
    texts = [words(r, "abcdefgh", 120) for _ in range(30)]
    for d, (item, edits) in enumerate([(0, 0), (0, 2), (0, 4), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0), (8, 0)]):
        w = items[item].split()
        for e in range(edits):
            w[e] = "edited"
        texts[d] = texts[d][:200] + " " + " ".join(w).upper() + " " + texts[d][200:]
    texts += [items[1], " ".join(items[1].split()[:-2]), None, "", "word " * 25, items[0] + " " + items[1]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).withColumn("leaks", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    got = {(x.doc_id, y.item_id) for x in found for y in x.leaks}
    assert len(found) == len(texts) and got == leak_truth(texts, items)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert all(not x.leaks for x in decontaminate.find_leaks(docs, bench.limit(0)).collect())


def test_items_with_long_runs_and_without_ids_are_found(spark):
    r = random.Random(9)
    around = [(words(r, "abcdefgh", 90), words(r, "abcdefgh", 93)) for _ in range(12)]
    items = [f"{a} {'. ' * 17}{b}" for a, b in around]
    docs = spark.createDataFrame([(i, f"{words(r, 'abcdefgh', 9)} {a} {'_ ' * 17}{b}", "en", "s", 0) for i, (a, b) in enumerate(around)], SCHEMA)
    bench = spark.createDataFrame([(i if i < 10 else None, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, y.item_id, y.start) for x in decontaminate.find_leaks(docs, bench).collect() for y in x.leaks}
    assert got == {(i, i if i < 10 else None, 9) for i in range(12)}


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    r = random.Random(6)
    items = [words(r, "abcdefgh", 20) for _ in range(12)]
    docs = spark.createDataFrame([(i, words(r, "abcdefgh", 30) + " " + t, "en", "s", 0) for i, t in enumerate(items)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 5)
    assert {(x.doc_id, y.item_id) for x in decontaminate.find_leaks(docs, bench).collect() for y in x.leaks} == {(i, i) for i in range(12)}


@pytest.mark.parametrize("entries", [10**6, 200 * 17, 0])
def test_hamming_index_misses_nothing_within_its_radius(monkeypatch, entries):
    monkeypatch.setattr(decontaminate, "ENTRIES", entries)
    r = np.random.default_rng(2)
    prints = r.integers(0, 65536, (200, 16)).astype(np.uint16)
    index = decontaminate.Index(list(range(200)), np.full(200, 9), [np.zeros(1, np.uint64)] * 200, prints, 5)
    for _ in range(200):
        i = int(r.integers(200))
        bits = np.unpackbits(prints[i].view(np.uint8))
        bits[r.permutation(256)[: int(r.integers(0, decontaminate.RADIUS + 1))]] ^= 1
        window = np.packbits(bits).view(np.uint16)
        found = index.search(window).tolist()
        assert i in found and found == np.flatnonzero(np.bitwise_count(prints ^ window).sum(axis=1, dtype=np.int64) <= decontaminate.RADIUS).tolist()


@pytest.mark.parametrize("text", ["", "a", " a  b\tc\nd ", "é ü x y", "a" * 50])
def test_words_are_cut_at_ascii_white_space(text):
    import pyarrow as pa

    data, off = textnum.column_bytes(pa.array([text, None, text]))
    w = textnum.words(data, off)
    want = text.encode().split()
    got = [data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    assert got == want + want and np.array_equal(w.hash[: len(want)], w.hash[len(want) :])


def test_one_worker_goes_through_all_blocks_of_the_benchmark(spark, monkeypatch):
    """50 blocks: one Python node in the plan, texts taken through them a few at a time, and the same leaks as with one block."""
    r = random.Random(7)
    items = [words(r, "abcdefgh", r.randint(3, 30)) for _ in range(120)]
    docs = spark.createDataFrame([(i, f"{words(r, 'abcdefgh', 30)} {items[i % 120]} {items[(7 * i + 1) % 120]}", "en", "s", 0) for i in range(200)], SCHEMA).repartition(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    leaks = lambda df: sorted((x.doc_id, y.item_id, y.start, y.n_words, y.similarity) for x in df.collect() for y in x.leaks)
    want = leaks(decontaminate.find_leaks(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(decontaminate, "CHUNK", 9_000)
    assert len(list(decontaminate.benchmark_blocks(bench, 5))) == 50
    many = decontaminate.find_leaks(docs, bench)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert leaks(many) == want and len({x[1] for x in want}) == 120


def plain_language(net, text):
    """(language, score) of one text by plain loops over windows, filters and bytes."""
    import math

    data, size = text.encode(), language.WINDOW
    cuts = [data[i : i + size] for i in range(0, len(data), size)]
    total = [0.0] * len(net.langs)
    for cut in cuts:
        x, f = cut + bytes(size - len(cut)), []
        for w, k in zip(language.WIDTHS, net.kernels, strict=True):
            for c in range(language.FILTERS):
                f.append(max(0.0, max(sum(float(net.embed[x[p + j], e]) * float(k[j * language.EMBED + e, c]) for j in range(w) for e in range(language.EMBED)) for p in range(size - w + 1))))
        z = [float(net.out[0, i]) + sum(v * float(net.out[1 + n, i]) for n, v in enumerate(f)) for i in range(len(net.langs))]
        norm = math.log(sum(math.exp(v) for v in z))
        total = [t + (v - norm) * len(cut) for t, v in zip(total, z, strict=True)]
    z = [t / len(data) * min(4, max(1, len(data) / size)) for t in total]
    p = [math.exp(v - max(z)) for v in z]
    return max(range(len(p)), key=lambda i: p[i]), max(p) / sum(p)


def test_languages_are_scored_as_plain_loops_score_them(spark):
    r = np.random.default_rng(4)
    f32 = np.float32
    net = language.Net(["a", "b", "c"], r.normal(0, 0.5, (256, language.EMBED)).astype(f32), [r.normal(0, 0.4, (w * language.EMBED, language.FILTERS)).astype(f32) for w in language.WIDTHS], r.normal(0, 0.3, (1 + language.FILTERS * 3, 3)).astype(f32))
    texts = ["a", "żółw", words(random.Random(1), "aeioun", 60), words(random.Random(2), "xyzß", 100)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA)
    for row in language.predict(docs, net).collect():
        lang, score = plain_language(net, row.text)
        assert row.lang_pred == net.langs[lang] and abs(row.score - score) < 1e-4


def test_toxicity_is_scored_as_a_plain_loop_scores_it(spark):
    import math

    run = lambda s: int.from_bytes(s.encode(), "big")
    weights = {run("snark"): 1.5, run("narkl"): -0.5, run(" bad "): 2.0, run("idiot"): 1.0}
    model = toxicity.Model(np.array(sorted(weights)), np.array([weights[k] for k in sorted(weights)]), -1.0)
    texts = ["Snarkle snarkle, SNARK", "bad", "a bad, bad? bad!", "", None, "é idiot9idiot\nbad", "nothing here", "idio t"]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA)
    for row in toxicity.score(docs, model).collect():
        flat = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in (row.text or "").encode())
        flat = b" " + flat + b" "
        times = Counter(int.from_bytes(flat[i : i + 5], "big") for i in range(len(flat) - 4))
        z = -1.0 + sum(w * math.log1p(times[k]) for k, w in weights.items())
        assert abs(row.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_columns_may_have_any_names(spark):
    rows, docs = corpus(spark, 60)
    odd = docs.withColumnsRenamed({"source": "a.b", "n_chars": "__text"}).withColumns({"__letter": F.lit(1), "__row": F.lit(2)})
    net = language.train(docs, per_lang=10)
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    for out, new in ((language.predict(odd, net), ["lang_pred", "score"]), (language.predict(odd, None), ["lang_pred", "score"]), (toxicity.score(odd, model), ["score"]), (decontaminate.find_leaks(odd, bench), ["leaks"]), (decontaminate.find_leaks(odd, bench.limit(0)), ["leaks"])):
        assert out.columns == [*odd.columns, *new] and {x["a.b"] for x in out.collect()} == {"s"}


def test_languages_share_a_bounded_sample(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, words(r, "abcdef", 20), f"l{i % 30}", "s", 0) for i in range(600)], SCHEMA)
    seen = []
    real = language.fit
    try:
        language.fit = lambda x, y, langs: seen.append(Counter(Counter(y.tolist()).values())) or real(x, y, langs, epochs=1)
        assert len(language.train(docs, per_text=1, most_texts=60).langs) == 30 and len(language.train(docs, per_text=1, most_texts=5).langs) == 30
    finally:
        language.fit = real
    assert seen == [{2: 30}, {1: 30}]


def test_repeated_rows_and_very_long_texts(spark):
    r = random.Random(11)
    item = words(r, "abcdefgh", 30)
    long = f"{words(r, 'ijklmnop', 150_000)} {item} {words(r, 'ijklmnop', 150_000)}"
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, item, "en", "s", 0), (2, item, "en", "s", 0), (None, "x", "en", "s", 0)], SCHEMA)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = sorted((str(x.doc_id), y.start, round(y.similarity, 6)) for x in decontaminate.find_leaks(docs, bench).collect() for y in x.leaks)
    assert got == [("1", 150_000, 1.0), ("2", 0, 1.0), ("2", 0, 1.0)]
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    assert toxicity.score(docs, model).count() == 4


def test_languages_that_tie_go_to_the_first(spark):
    f32 = np.float32
    net = language.Net(["a", "b"], np.zeros((256, language.EMBED), f32), [np.zeros((w * language.EMBED, language.FILTERS), f32) for w in language.WIDTHS], np.zeros((1 + language.FILTERS * 3, 2), f32))
    docs = spark.createDataFrame([(1, "text", None, "s", 0), (2, "text " * 400, None, "s", 0)], SCHEMA)
    assert {(r.lang_pred, round(r.score, 6)) for r in language.predict(docs, net).collect()} == {("a", 0.5)}
