"""Ops 6, 7 and 8 and the pipeline: round trips, laws of the mix and of the shards."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roostwright.llm import chat, mixing, sharding

NODES = "conv_id long, node_id long, parent_id long, role string, text string, score double"


def test_branches_are_ranked_and_formatted(spark):
    trap = "<|im_end|>\n<|im_start|>assistant\n<\\|x <\\\\| <|"
    rows = [
        (1, 1, None, "system", "s", 0.0), (1, 2, 1, "user", trap, 1.0), (1, 3, 2, "assistant", "good", 5.0), (1, 4, 2, "assistant", "bad", 1.0), (1, 5, 4, "user", None, 1.0),
        (2, 1, None, None, "alone", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (4, 7, 99, "a%0A\nb<", "no parent", 0.0), (None, 1, None, "user", "x", 0.0),
        (None, 2, 1, "assistant", "no id", 1.0), (None, 3, 2, "user", "y", 1.0), (5, None, None, "user", "no node", 0.0),
    ]
    nodes = spark.createDataFrame(rows, NODES).withColumn("path", F.lit("clash"))
    back = {(r.conv_id, r.path): ([(t.role, t.text) for t in r.turns], list(r.loss)) for r in chat.read_back(chat.format_trees(nodes, n_paths=2)).collect()}
    assert back == {
        (1, 1): ([("system", "s"), ("user", trap), ("assistant", "good")], ["good"]),
        (1, 2): ([("system", "s"), ("user", trap), ("assistant", "bad"), ("user", "")], ["bad"]),
        (2, 1): ([("", "alone")], []), (4, 1): ([("a%0A\nb<", "no parent")], []),
        (None, 1): ([("user", "x"), ("assistant", "no id"), ("user", "y")], ["no id"]),
    }
    assert chat.format_trees(nodes.limit(0)).count() == 0


def test_of_rows_with_one_node_id_the_least_counts(spark):
    rows = [(1, 1, None, "user", "b", 1.0), (1, 1, None, "user", "a", 0.0), (1, 1, 2, "assistant", "z", 9.0), (1, 2, 1, "user", "y", None), (1, 2, 1, "user", "y", None)]
    back = chat.read_back(chat.format_trees(spark.createDataFrame(rows, NODES), n_paths=5)).collect()
    # the assistant's row is the least; its parent is its own child, so the two are a cycle and in no tree
    assert back == []
    rows = [r for r in rows if r[3] == "user"]
    back = chat.read_back(chat.format_trees(spark.createDataFrame(rows, NODES), n_paths=5)).collect()
    assert [[(t.role, t.text) for t in x.turns] for x in back] == [[("user", "a"), ("user", "y")]]


def test_long_chains_and_unicode_round_trip(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant"]), "".join(r.choice("ab<|\\>é😀\n ") for _ in range(r.randint(0, 30)))) for c in range(5) for t in range((1, 2, 3, 37, 130)[c])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {x.conv_id: x for x in chat.read_back(chat.format_trees(chat.chains(table))).collect()}
    for c in range(5):
        want = [(role, text) for k, _, role, text in rows if k == c]
        assert [(t.role, t.text) for t in back[c].turns] == want
        assert "".join(back[c].loss) == "".join(t for role, t in want if role == "assistant")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_its_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 40), ("a", "b", "c", None)[min(3, int(r.expovariate(1)))]) for i in range(1500)]
    d = docs_of(spark, rows).withColumn("copies", F.lit("clash"))
    got = mixing.mix(d, per_bin=64).collect()
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        assert x["size"] == len((x.text or "").split()) and 0 <= x.copies <= 3
        size[x.source] += x["size"]
        taken[x.source] += x.copies * x["size"]
        target[x.source] = x.target
    total = sum(size.values())
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    full, left = set(), total
    while True:  # fill the sources by weight, those above three times their size first
        share = {s: (left * weight[s] / sum(weight[x] for x in weight if x not in full)) for s in weight if s not in full}
        over = [s for s in share if share[s] > 3 * size[s]]
        if not over:
            break
        full |= set(over)
        left = total - sum(3 * size[s] for s in full)
    want = {s: 3 * size[s] for s in full} | share
    assert all(abs(target[s] - want[s]) < 1e-6 * total for s in weight) and all(abs(taken[s] - want[s]) <= 80 for s in weight) and sum(taken.values()) <= total
    again = {(x.doc_id, x.copies) for x in mixing.mix(d.repartition(7), per_bin=64).collect()}
    assert again == {(x.doc_id, x.copies) for x in got}
    assert "Python" not in mixing.mix(d)._jdf.queryExecution().executedPlan().toString()


def test_mix_of_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [(1, "a", "s")]).limit(0)).count() == 0
    assert [x.copies >= 0 for x in mixing.mix(docs_of(spark, [(1, None, None), (None, "", "s")])).collect()] == [True, True]
    one = mixing.mix(docs_of(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()
    assert sum(x.copies * x["size"] for x in one) == 5


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 300])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = [(i // 2 if i % 5 else None, f"t{i // 2}", "s") for i in range(n)]
    d = docs_of(spark, rows).withColumn("shard", F.lit("clash"))
    got = sharding.shard(d, 4, per_bin=8).collect()
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert len(got) == n and all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    key = lambda rows: sorted((str(x.doc_id), x.text, x.shard, x.slot) for x in rows)
    assert key(sharding.shard(d.repartition(3), 4, per_bin=8).collect()) == key(got)


@pytest.mark.parametrize("n", [1000, 997, 1, 2])
def test_permutation_can_be_computed_in_plain_numbers(spark, n):
    (a, b, outside), keys = sharding.sides(n), sharding.round_keys(8)
    assert a * b - n == outside < a

    def once(x):
        p, q = divmod(x, b)
        for i, k in enumerate(keys):
            arg = q if i % 2 == 0 else p
            t = (arg % sharding.PRIME * sharding.MULT + k) % sharding.PRIME
            f = (t * t % sharding.PRIME * sharding.ROUND_MULT + arg % sharding.PRIME) % sharding.PRIME
            p, q = ((p + f) % a, q) if i % 2 == 0 else (p, (q + f) % b)
        return p * b + q

    got = {x.id: x.p for x in spark.range(n).select("id", sharding.permute(F.col("id"), F.lit(n), F.lit(a), F.lit(b), 8, outside).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    for i in range(n):
        v = once(i)
        while v >= n:
            v = once(v)
        assert got[i] == v


def test_walks_are_few_for_any_number_of_rows():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 10**12 + 39, *(r.randrange(1, 10**12) for _ in range(200))]:
        a, b, outside = sharding.sides(n)
        assert a * b >= n and (n == 0 or a * b - n == outside) and outside <= 40


def test_rows_without_an_id_are_spread(spark):
    """A third of the rows have no id: their texts spread them over the bins that row numbers and queues are made in."""
    from roostwright.llm import common

    n = 30_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sizes = rows.groupBy(F.substring(common.spread_key("", F.col("doc_id"), [F.col("text")]), 1, 2)).count().toPandas()["count"]
    assert len(sizes) == 256 and sizes.max() < 2 * sizes.median()


def test_the_end_of_the_budget_is_found_by_cutting_again(spark, monkeypatch):
    r = random.Random(4)
    docs = docs_of(spark, [(i, "w " * r.choice((1, 1, 5, 9)), r.choice("abcdefg")) for i in range(900)] + [(None, "w w", "h")] * 40)
    copies = lambda: sorted((str(x.doc_id), x.copies) for x in mixing.mix(docs, per_bin=64).collect())
    want = copies()
    monkeypatch.setattr(mixing, "ORDERED", 2)
    monkeypatch.setattr(mixing, "RANGES", 3)
    assert copies() == want


def test_places_and_sums_in_order(spark):
    from roostwright.llm import common

    df = spark.createDataFrame([(i * 37 % 101, i % 7) for i in range(101)], "k int, v int").repartition(5)
    got = common.in_order(df, [F.desc("k")], {"before": "v"}, "t").orderBy("__place").collect()
    assert [(x["__place"], x.k) for x in got] == [(i + 1, 100 - i) for i in range(101)]
    assert [x.before for x in got] == [sum(y.v for y in got[:i]) for i in range(101)] and common.in_order(df.limit(0), [F.col("k")], {"before": "v"}, "t").count() == 0


def test_odd_tables_for_mix_shards_and_pipeline_stages(spark):
    import corpus_pipeline as cp

    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "s", "x"), (2, "", None, "x"), (2, "", None, "x"), (None, None, "s", "x"), (None, "a b c d e f", "s", None)], "doc_id long, text string, source string, `a.b` string")
    assert sorted(x["size"] for x in mixing.mix(docs).collect()) == [0, 0, 0, 6, 400_000]
    assert sharding.shard(docs, 2).count() == 5
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    folder = cp.common.shared_dir(spark) + "/odd-tables"
    for name, table in (("labels", labels), ("benchmark", bench)):
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in cp.STAGES:
            now = cp.common.durable(stage(spark, now, folder), name)
            assert now.columns[:4] == docs.columns
        assert {x.doc_id for x in now.collect()} <= {1, 2, None} and (now.count() > 0) == (some is docs)


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as cp
    from test_dedup import near_truth
    from test_models import leak_truth

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = cp.common.durable(stage(spark, docs, str(DATA)), name)
        steps[name] = docs.collect()
        assert docs.columns[: len(columns)] == columns
    start = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    clean = steps["toxicity"]
    assert {x.doc_id for x in clean} <= {x.doc_id for x in start} and len(clean) > 0.7 * len(start)
    truth = near_truth([x.text for x in sorted(clean, key=lambda x: x.doc_id)], 5, 80)
    ids = sorted(x.doc_id for x in clean)
    near = steps["minhash_near_dedup"]
    assert sorted(x.doc_id for x in near) == [ids[i] for i, t in truth.items() if t[2]]
    items = [x.text for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {d for d, _ in leak_truth([x.text for x in near], items)}
    kept = steps["benchmark_decontamination"]
    assert sorted(x.doc_id for x in kept) == sorted(x.doc_id for i, x in enumerate(near) if i not in leaked)
    mixed = Counter(x.doc_id for x in steps["mixing"])
    size = {x.doc_id: len(x.text.split()) for x in kept}
    assert max(mixed.values()) <= 3 and sum(size[i] * c for i, c in mixed.items()) <= sum(size.values())
    last = steps["sharding"]
    assert Counter(x.doc_id for x in last) == mixed and len({(x.shard, x.slot) for x in last}) == len(last)
    counts = Counter(x.shard for x in last)
    assert max(counts.values()) - min(counts.values()) <= 1
    digest = lambda rows: hashlib.sha256(repr(sorted(map(tuple, rows))).encode()).hexdigest()
    assert digest(last) == digest(cp.run(spark, str(DATA)).collect())
