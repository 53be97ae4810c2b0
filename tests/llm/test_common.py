"""What the training operators share: the shared folder, counted tables, and joins of hot keys."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from roostwright.llm import common as C


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    unset = SimpleNamespace(get=lambda key, default=None: default)
    spark = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(spark)


def test_tables_are_counted_and_removed(spark):
    df, n = C.counted(spark.range(1000).filter("id % 3 = 0"), "t")
    path = C._paths[df].removeprefix("file:")
    assert n == df.count() == 334 and os.path.isdir(path)
    C.delete(df)
    assert not os.path.exists(path)
    assert C.counted(spark.range(5).limit(0), "t")[1] == 0
    with C.scratch(spark) as keep:
        gone, kept = C.durable(spark.range(3), "t"), keep(C.durable(spark.range(4), "t"))
        paths = [C._paths[x].removeprefix("file:") for x in (gone, kept)]
    assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 4


def test_two_threads_keep_their_own_scratch(spark):
    from threading import Barrier, Thread

    both, left = Barrier(2), {}

    def work(n):
        with C.scratch(spark) as keep:
            gone, kept = C.durable(spark.range(n), "t"), C.durable(spark.range(n), "t")
            paths = [C._paths[x].removeprefix("file:") for x in (gone, kept)]
            both.wait()
            if n == 1:
                keep(kept)
        if n == 1:
            both.wait()
        left[n] = [os.path.exists(p) for p in paths]
        if n == 2:
            both.wait()

    threads = [Thread(target=work, args=(n,)) for n in (1, 2)]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert left == {1: [False, True], 2: [False, False]}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_join_as_others_do(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(300)], "id long, key string")
    keyed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).filter("key <> 'k7'")
    want = sorted(map(str, rows.join(keyed, "key", how).collect()))
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(C, "HOT_ROWS", 5)
    assert sorted(map(str, C.join_hot(rows, keyed, "key", 40, 300, how).collect())) == want
    if how == "inner":
        salted = C.join_salted(rows, keyed, "key", "id", 300)
        assert sorted(map(str, salted.collect())) == want
        assert salted.select(F.spark_partition_id()).distinct().count() >= 1
