"""Op 11 against a plain version that compares prefixes as tuples, and the radix tree by itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roostwright.llm import prefix_trie as T

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_conversations(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[: 2 * T.WIDTH]
            convs[c].append((turn is not None, turn or 0, tie, (role, text)))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}


def plain_branched(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below = [sums[k] for k in kids[node]]
        sums[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    ends = lambda n: ",".join(map(str, sorted(c for c in members[n] if len(convs[c]) == len(n))))
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *sums[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items()), key=str
    )


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def talk(seed, n, common=0.4, long=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        turns = r.randint(1, 6) if c != 3 else max(1, long)
        for t in range(turns):
            text = "hello" if r.random() < common else f"t{r.randint(0, 3)}" if r.random() < 0.8 else f"é{r.random()}"
            rows.append((c * (3 if c % 7 == 0 else 1), t, ("user", "assistant")[t % 2], text))
    return rows


@pytest.mark.parametrize("limit", [4, 25, 10**6])
def test_nodes_are_those_of_comparing_prefixes(spark, limit):
    rows = talk(1, 150, long=70)
    df = spark.createDataFrame(rows, ROWS).withColumns({"id": F.lit("clash"), "seq": F.lit("clash")}).repartition(5)
    assert found(T.prefix_trie(df, limit)) == plain_trie(plain_conversations(rows))
    assert found(T.trie(T.branched(T.conversations(df)), limit)) == plain_trie(plain_branched(plain_conversations(rows)))


def test_many_equal_conversations(spark, monkeypatch):
    """A third of all conversations are one: its members are listed in pieces, and no group holds them."""
    monkeypatch.setattr(T, "LISTED", 7)
    rows = [(c, 0, "user", "hi" if c % 3 == 0 else f"x{c % 40}") for c in range(300)] + [(c, 1, "user", "bye") for c in range(0, 300, 6)]
    df = spark.createDataFrame(rows, ROWS)
    assert found(T.prefix_trie(df, 20)) == plain_trie(plain_conversations(rows))


def test_odd_conversations(spark):
    rows = [(1, None, "user", "z"), (1, 0, None, "a"), (1, 0, "", "a"), (1, 1, "user", None), (None, 0, "user", "x"), (-7, 2, "u", "b"), (-7, 2, "u", "a"), (5, 0, "a:b", "c"), (6, 0, "a", ":bc"), (7, 0, "x", "y" * 300_000)]
    df = spark.createDataFrame(rows, ROWS)
    assert found(T.prefix_trie(df)) == plain_trie(plain_conversations(rows))
    assert found(T.trie(T.branched(T.conversations(df)))) == plain_trie(plain_branched(plain_conversations(rows)))
    assert found(T.prefix_trie(df.limit(0))) == []


def test_radix_nodes_grow_and_split():
    r = random.Random(2)
    keys = {bytes(r.choice((0, 1, 255)) for _ in range(r.randint(0, 6))) for _ in range(300)} | {bytes([7, i]) for i in range(256)} | {bytes([8, i]) for i in range(40)} | {b"\x07\x05" + b"long" * 9}
    keys = [k for k in keys if k]
    r.shuffle(keys)
    root = T.Node(b"", None, 0)
    for i, k in enumerate(keys):
        T.insert(root, k, i)
    got, rooms, todo = {}, set(), [(root, b"")]
    while todo:
        node, above = todo.pop()
        path = above + node.path
        rooms.add(node.room)
        if node.row is not None:
            got[path] = node.row
        for byte in range(256):
            if (kid := node.child(byte)) is not None:
                todo.append((kid, path + bytes([byte])))
    assert got == {k: i for i, k in enumerate(keys)} and rooms == {4, 16, 48, 256}
    assert T.shared(b"", b"x") == 0 and T.shared(b"abc", b"abd") == 2 and T.shared(b"abc", b"abcd") == 3
