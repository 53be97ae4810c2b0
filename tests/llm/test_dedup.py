"""Ops 1 to 4 against brute force: nulls, empties, ties, repeated rows, empty tables and clashing columns included."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roostwright.llm import common, exact_dedup, fm_index, line_dedup, minhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n=40):
    """Random texts, exact and near copies, shared passages, nulls and empties."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "a", "é", "ß"]
    base = [[r.choice(words) for _ in range(r.randint(0, 160))] for _ in range(n)]
    passage = [r.choice(words) for _ in range(60)]
    for i in range(0, n, 5):
        base[i] = base[i] + passage + base[(i + 1) % n][:5]
    for i in range(3, n, 7):
        copy = list(base[i - 3])
        for _ in range(len(copy) // 40):
            copy[r.randrange(len(copy))] = "edited"
        base[i] = copy
    texts = [" ".join(b) if i % 4 else "\n".join([" ".join(b[:20]), "\t".join(b[20:])]) for i, b in enumerate(base)]
    return texts + [None, "", "   ", "one", "one", texts[4], texts[4], "x " * 90, "Ab aB ab AB x", "ab AB Ab aB X"]


def test_exact_dedup(spark):
    texts = prose(1)
    d = docs_of(spark, texts).withColumn("kept", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(d, F.col("doc_id") % 2 == 0, per_bucket=4).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        want = (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest(), "clash")
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256, got[i].digest) == want


def test_exact_dedup_of_a_hot_group_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = ["hot"] * 20 + [f"t{i // 2}" for i in range(30)] + ["long " * 50_000, "long " * 50_000, "long " * 49_999 + "lone "]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs_of(spark, texts), F.col("doc_id") % 3 == 0).collect()}
    assert got == {i: (max(j for j, u in enumerate(texts) if u == t), texts.count(t)) for i, t in enumerate(texts)}


def test_exact_dedup_of_nothing_and_of_one_side(spark):
    none = docs_of(spark, ["a"]).limit(0)
    assert exact_dedup.exact_dedup(none, F.lit(True)).count() == 0
    for side in (True, False):
        assert sorted(r.keep_id for r in exact_dedup.exact_dedup(docs_of(spark, ["a", "a", "b"]), F.lit(side)).collect()) == [1, 1, 2]
    repeated = docs_of(spark, ["a", "b"]).unionByName(docs_of(spark, ["a", "b"]))
    assert [(r.group_size, r.kept) for r in exact_dedup.exact_dedup(repeated, F.col("doc_id") == 0).collect()] == [(2, True)] * 4


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 20_000])
def test_fuse_filter_misses_nothing(n):
    keys = np.unique(exact_dedup.mix64(np.arange(n).astype(np.uint64)))
    filt = exact_dedup.build_fuse(keys)
    assert exact_dedup.may_hold(filt, keys).all()
    others = exact_dedup.mix64(np.arange(10**7, 10**7 + 200_000).astype(np.uint64))
    assert exact_dedup.may_hold(filt, others).mean() < 3e-4


def substring_truth(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("seed", "width"), [(2, 35), (3, 9), (4, 200)])
def test_substring_dedup(spark, seed, width):
    texts = prose(seed)
    if width > 128:
        texts += [" ".join(f"long{i}" for i in range(5000)), " ".join(f"long{i}" for i in range(700, 2000)), "y " * 450, "y " * 300]
    d = docs_of(spark, texts).withColumn("kept_text", F.lit("clash")).withColumn("seg", F.lit("kept"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(d, width).collect()}
    assert got == dict(enumerate(substring_truth(texts, width)))


def test_substring_dedup_puts_common_minimizers_last(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 3)
    texts = prose(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(docs_of(spark, texts), 12).collect()}
    assert got == dict(enumerate(substring_truth(texts, 12)))


def test_substring_dedup_of_a_hot_phrase(spark, monkeypatch):
    """A third of the texts is one phrase over and over, of many lengths: its windows are dealt one by one."""
    monkeypatch.setattr(substring, "HOT", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    texts = prose(7, 20) + ["a b c " * n for n in range(3, 15)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(docs_of(spark, texts), 12).collect()}
    assert got == dict(enumerate(substring_truth(texts, 12)))


def test_spans_tell_which_words_went(spark):
    texts = prose(9)
    for r in substring.dedup_substrings(docs_of(spark, texts), 9).collect():
        w = WORD.findall(texts[r.doc_id] or "")
        gone = [i for s in r.removed_spans for i in range(s.a, s.b)]
        assert len(gone) == len(set(gone)) == r.n_removed and " ".join(x for i, x in enumerate(w) if i not in set(gone)) == r.kept_text
        assert all(x.b < y.a for x, y in zip(r.removed_spans, r.removed_spans[1:]))


def test_substring_dedup_of_nothing_and_of_repeated_rows(spark):
    assert substring.dedup_substrings(docs_of(spark, ["a"]).limit(0)).count() == 0
    t = " ".join(f"u{i}" for i in range(40))
    twice = docs_of(spark, [t, None]).unionByName(docs_of(spark, [t, None]))
    assert sorted((r.doc_id, r.n_removed) for r in substring.dedup_substrings(twice).collect()) == [(0, 40), (0, 40), (1, 0), (1, 0)]


def test_fm_index_counts_windows():
    r = np.random.default_rng(0)
    for _ in range(20):
        length = r.integers(1, 60, 12)
        base = np.cumsum(length + 1) - length - 1
        text = np.zeros(int((length + 1).sum()), np.int64)
        for b, n in zip(base, length, strict=True):
            text[b : b + n] = r.integers(1, 4, n)
        width = int(r.integers(2, 9))
        per = np.maximum(0, length - width + 1)
        windows = Counter(tuple(text[b + i : b + i + width]) for b, p in zip(base, per, strict=True) for i in range(p))
        want = {(s, i) for s, (b, p) in enumerate(zip(base, per, strict=True)) for i in range(p) if windows[tuple(text[b + i : b + i + width])] > 1}
        seq, a, b2 = fm_index.repeated_windows(fm_index.FMIndex(text, depth=16), text, base, per, width)
        assert {(int(s), i) for s, x, y in zip(seq, a, b2, strict=True) for i in range(x, y + 1)} == want


def line_truth(texts):
    def cut(t):
        lines, out, now = (t or "").split("\n"), [], []
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        for i, x in enumerate(lines):
            now.append(x)
            total = sum(w * (h[i - j] if i >= j else 0) for j, w in enumerate(line_dedup.WEIGHTS))
            run = i > 1 and h[i] == h[i - 1] == h[i - 2]
            if (i % 2 == 1 if run else total % line_dedup.MODULUS % line_dedup.DIVISOR == 0) or i == len(lines) - 1:
                out.append(now)
                now = []
        return out

    seen, out = set(), []
    for t in texts:
        kept, removed, n = [], 0, 0
        chunks = cut(t)
        for c in chunks:
            n += len(c)
            if len(c) > 1 and tuple(c) in seen:
                removed += len(c)
                continue
            if len(c) > 1:
                seen.add(tuple(c))
            kept += c
        out.append((n, removed, len(chunks), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    r = random.Random(5)
    block = [f"licence line {i}" for i in range(12)]
    texts = ["\n".join([f"own {i} {j}" for j in range(r.randint(0, 6))] + block[r.randint(0, 2) :] + [f"end {i}"]) for i in range(30)] + [None, "", "\n\n\n", "a", "a\r\nb", "a\r\nb"]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.n_chunks, x.kept_text) for x in line_dedup.dedup_lines(docs_of(spark, texts).withColumn("chunks", F.lit(1))).collect()}
    want = dict(enumerate(line_truth(texts)))
    assert got == want and sum(w[1] for w in want.values()) > 100
    assert line_dedup.dedup_lines(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert "Python" not in line_dedup.dedup_lines(docs_of(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()


def test_runs_of_one_line_go(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = ["\n".join([f"start {i}", *["By To."] * n, f"end {i}"]) for i, n in enumerate((92, 5, 6, 7, 300, 2, 1))] + ["one\ntwo\nthree\n" * 400, None]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.n_chunks, x.kept_text) for x in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(line_truth(texts)))
    assert all(got[i][3].count("By To.") <= 7 for i in range(7))
    twice = docs_of(spark, texts[:2]).unionByName(docs_of(spark, texts[:2]))
    assert len(line_dedup.dedup_lines(twice).collect()) == 4


def near_truth(texts, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def family(seed, n=60):
    """Chains of ever more edited copies around a common passage, so that links and near misses lie close together."""
    r = random.Random(seed)
    passage = [f"p{r.randrange(999)}" for _ in range(50)]
    out = []
    for f in range(4):
        now = passage + [f"f{f}{r.randrange(9999)}" for _ in range(60)]
        for _ in range(n // 4):
            now = list(now)
            for _ in range(r.randint(0, 4)):
                now[r.randrange(len(now))] = f"e{r.randrange(99999)}"
            out.append(" ".join(now))
    return out


@pytest.mark.parametrize(("make", "k"), [(prose, 4), (family, 5)])
def test_near_dedup(spark, make, k):
    texts = make(6)
    d = docs_of(spark, texts).withColumn("component_id", F.lit("clash")).withColumn("rep", F.lit("kept"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(d, k=k).collect()}
    assert got == near_truth(texts, k, 80)


def test_near_dedup_of_hot_groups_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = family(8)
    third = [texts[0].upper() if i % 2 else texts[0] for i in range(20)] + [f"{texts[1]} x{i}" for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(docs_of(spark, texts + third)).collect()}
    assert got == near_truth(texts + third, 5, 80)


def test_near_dedup_of_very_long_texts(spark):
    r = random.Random(12)
    w = [f"w{r.randrange(50_000)}" for _ in range(250_000)]
    near = [*w[:1000], "new", *w[1001:]]
    rows = [(5, " ".join(w)), (3, " ".join(near)), (4, " ".join(w[:150_000])), (1, "w1 w2")]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][1:] for i in (5, 3, 4, 1)] == [(3, False), (3, True), (4, True), (1, True)] and got[1][0] == 1 and got[5][0] > 249_000


def test_near_dedup_of_nothing_and_of_repeated_rows(spark):
    assert minhash.near_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0
    twice = docs_of(spark, ["a b c d e f", None, "x y"]).unionByName(docs_of(spark, ["a b c d e f", None, "x y"]))
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_dedup(twice).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 2), (2, 2)]


def test_super_minhash_estimates_similarity():
    r, off = np.random.default_rng(1), []
    for _ in range(60):
        n = int(r.integers(3, 400))
        a = r.integers(0, 2**63, n).astype(np.uint64)
        same = int(round(2 * n * 0.6 / 1.6))
        b = np.concatenate([a[:same], r.integers(0, 2**63, n - same).astype(np.uint64)])
        sig = minhash.super_minhash(np.concatenate([np.sort(a), np.sort(b)]), np.array([n, n]))
        assert (sig < np.uint64(minhash.PLACES) << np.uint64(56)).all()
        off.append((sig[0] == sig[1]).mean() - same / (2 * n - same))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    comp, _ = minhash.components(edges)
    assert {r.node: r.comp for r in comp.collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
