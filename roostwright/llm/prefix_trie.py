"""Conversation prefix trie (op 11): adaptive radix trees over fixed-width turn ids, and what each prefix of turns is shared by.

A turn's id is 16 bytes of a digest, a conversation the string of its ids; equal conversations are counted once, by Spark. Prefixes with more than LIMIT
turns below them are few by their very weight (one in LIMIT of all turns for each depth); what hangs below the deepest of them is cut
into shards of about LIMIT turns, each of whole subtrees, so no first turn, however common, makes a large group. Each shard is an adaptive
radix tree: nodes of 4, 16, 48 or 256 children that grow as needed, with runs of bytes without a branch kept as one path. Nodes are
given out at byte depths that are whole turns. The heavy prefixes above get their subtrees' sums by pointer doubling, log2(depth) joins.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of a turn's id, and turns of a shard.
WIDTH, LIMIT = 16, 8192
#: Ids that one row may list; of more, pieces are listed by range and hashed one after another.
LISTED = 1000

EMPTY = hashlib.sha256(b"").hexdigest()


class Node:
    """`path` leads here after the byte that the parent knows the node by. Up to 16 children are found by their sorted bytes, up to 48 by a table of places, more by a table of nodes."""

    __slots__ = ("index", "kids", "path", "room", "row", "sample")

    def __init__(self, path: bytes, row: int | None, sample: int) -> None:
        self.path, self.row, self.sample = path, row, sample  # row: the key that ends here; sample: a key that comes by
        self.room, self.index, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            return self.kids[self.index[byte] - 1] if self.index[byte] else None
        i = self.index.find(byte)
        return self.kids[i] if i >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Adds a child, or takes another one's place."""
        if self.room == 256:
            self.kids[byte] = node
        elif self.room == 48:
            if self.index[byte]:
                self.kids[self.index[byte] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.index[byte] = len(self.kids)
            else:
                self.kids, self.index, self.room = [self.kids[i - 1] if i else None for i in self.index], bytearray(), 256
                self.kids[byte] = node
        elif (i := self.index.find(byte)) >= 0:
            self.kids[i] = node
        elif len(self.kids) < self.room:
            i = bisect_left(self.index, byte)
            self.index.insert(i, byte)
            self.kids.insert(i, node)
        elif self.room == 4:
            self.room = 16
            self.put(byte, node)
        else:
            places = bytearray(256)
            for i, b in enumerate(self.index):
                places[b] = i + 1
            self.index, self.room = places, 48
            self.put(byte, node)

    def each(self) -> Iterator[Node]:
        return (k for k in self.kids if k is not None)


def shared(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        lo, n = (mid, n) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def insert(root: Node, key: bytes, row: int) -> None:
    """Keys are distinct."""
    node, above, at = root, None, 0
    while True:
        m = shared(node.path, key[at : at + len(node.path)])
        if m < len(node.path):  # the path parts here
            upper = Node(node.path[:m], None, node.sample)
            upper.put(node.path[m], node)
            node.path = node.path[m + 1 :]
            above[0].put(above[1], upper)
            node = upper
        at += m
        if at == len(key):
            node.row = row
            return
        below = node.child(key[at])
        if below is None:
            node.put(key[at], Node(key[at + 1 :], row, row))
            return
        above, node, at = (node, key[at]), below, at + 1


def shard_nodes(keys: list[bytes], sizes: list[list[int]], n: list[int], low: list[int], cut: list[int], ends: list[bytes]) -> dict[str, list]:
    """The nodes of a shard below the heavy prefixes that the keys' first WIDTH bytes stand for.

    Row i is n[i] equal conversations, the smallest low[i], whose turns after the first cut[i] follow in keys[i] and have sizes[i] bytes of text.
    """
    root = Node(b"", None, 0)
    for i, key in enumerate(keys):
        insert(root, key, i)
    walk, at = [(root, 0, 0, -1)], 0  # node, byte depth at which its edge starts and ends, place of its parent
    while at < len(walk):
        node, _, end, _ = walk[at]
        walk += [(k, end, end + 1 + len(k.path), at) for k in node.each()]
        at += 1
    out: dict[str, list] = {c: [] for c in ("conv_id", "depth", "parent_conv_id", "top", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq")}
    # of each place, what is below: conversations, their smallest id, leaves, tokens saved, nodes without a parent yet
    sums = [[0, None, 0, 0, []] for _ in walk]
    for place in range(len(walk) - 1, 0, -1):
        (node, start, end, parent), (count, least, leaves, saved, open_) = walk[place], sums[place]
        if node.row is not None:
            count, least = count + n[node.row], low[node.row] if least is None else min(least, low[node.row])
        turn = end - end % WIDTH
        while turn > max(start, WIDTH):
            j = turn // WIDTH - 1
            for k in open_:
                out["parent_conv_id"][k] = least
            saved += (count - 1) * sizes[node.sample][j - 1]
            leaves = leaves or 1
            values = (least, cut[node.sample] + j, None, None, count, len(open_), leaves, saved, ends[node.row] if turn == end and node.row is not None else None)
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
            open_, turn = [len(out["depth"]) - 1], turn - WIDTH
        if start < WIDTH <= end:  # the heavy prefix itself
            for k in open_:
                out["top"][k] = keys[node.sample][:WIDTH]
            continue
        up = sums[parent]
        up[0], up[1], up[2], up[3] = up[0] + count, least if up[1] is None else min(up[1], least), up[2] + leaves, up[3] + saved
        up[4] += open_
    return out


def turn_id() -> Column:
    """WIDTH bytes of the digest of role and text; the role's length stands before it, so no other pair reads alike."""
    role, text = C.text_or_empty("role"), C.text_or_empty("text")
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (id, size) in order: by turn, null first, then by id. Only ids and sizes are shuffled, not texts."""
    slim = rows.filter("conv_id is not null").select("conv_id", F.struct(F.col("turn"), turn_id().alias("id"), F.octet_length(C.text_or_empty("text")).cast("long").alias("size")).alias("t"))
    turns = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def branched(convs: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % group in place of its own first h; h = crc32 of its decimal id, modulo heads."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    first = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    joined = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h}).join(first, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def prefixes(distinct: DataFrame) -> DataFrame:
    """A row for each prefix of each sequence: seq, depth, prefix and parent (chained digests), size of its last turn, below (turns from it on, and the end), n, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("seq", "depth", "prefix", "parent", "size", "below", "n", "low")}
            for seq, n, low, ids, sizes in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                parent, prefix = None, bytes(WIDTH)
                for d in range(len(ids) + 1):
                    if d:
                        parent, prefix = prefix, hashlib.sha256(prefix + ids[d - 1]).digest()[:WIDTH]
                    for c, v in zip(out, (seq, d, prefix, parent, sizes[d - 1] if d else 0, len(ids) - d + 1, n, low), strict=True):
                        out[c].append(v)
                if len(out["seq"]) >= 1 << 14:
                    yield pa.RecordBatch.from_pydict(out, kinds)
                    out = {c: [] for c in out}
            yield pa.RecordBatch.from_pydict(out, kinds)

    kinds = pa.schema([("seq", pa.binary()), ("depth", pa.int32()), ("prefix", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("below", pa.int32()), ("n", pa.int64()), ("low", pa.int64())])
    return distinct.select("seq", "n", "low", "turns.id", "turns.size").mapInArrow(run, "seq binary, depth int, prefix binary, parent binary, size long, below int, n long, low long")


def light_nodes(shards: DataFrame) -> DataFrame:
    """The nodes below the heavy prefixes; those right below one have it in `top`, the others know their parent_conv_id."""
    kinds = pa.schema([*((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id")), ("top", pa.binary()), *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ("seq", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        col = {c: t[c].to_pylist() for c in t.column_names}
        keys = [top + b"".join(ids[cut:]) for top, ids, cut in zip(col["top"], col["id"], col["cut"], strict=True)]
        tails = [sizes[cut:] for sizes, cut in zip(col["size"], col["cut"], strict=True)]
        return pa.table(shard_nodes(keys, tails, col["n"], col["low"], col["cut"], col["seq"]), kinds)

    return shards.groupBy("shard").applyInArrow(run, "conv_id long, depth long, parent_conv_id long, top binary, n_convs long, n_children long, n_leaves long, saved_tokens long, seq binary")


def rolled_up(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """nodes (prefix, parent, leaves, saved) with leaves and saved summed over their subtrees: each round doubles how far down the sums reach."""
    now = nodes.select("prefix", F.col("parent").alias("up"), "leaves", "saved")
    while not now.filter("up is not null").isEmpty():
        kids = C.durable(now.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s")), "trie-kids")
        more = C.small(kids.select(F.col("up").alias("prefix"), "l", "s"), n_nodes)
        summed = now.join(more, "prefix", "left").select("prefix", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        next_up = kids.select("up", "n").join(C.small(now.select(F.col("prefix").alias("up"), F.col("up").alias("next")), n_nodes), "up")
        now = C.durable(C.join_hot(summed, next_up, "up", n_nodes, n_nodes, "left").select("prefix", F.col("next").alias("up"), "leaves", "saved"), "trie-up")
    return now.drop("up")


def ends_digests(members: DataFrame, distinct: DataFrame) -> DataFrame:
    """seq, ends_sha256: the digest of the decimal ids of its members (seq, conv_id), ascending and joined by commas."""
    many = F.broadcast(distinct.filter(F.col("n") > LISTED).select("seq"))  # one in LISTED conversations at most
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    few = members.join(many, "seq", "left_anti").groupBy("seq").agg(F.sha2(F.array_join(ids, ","), 256).alias("ends_sha256"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for seq, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not out or out[-1][0] != seq or len(out[-1][2]) >= LISTED:
                    out.append((seq, c, []))
                out[-1][2].append(str(c))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([",".join(x[2]) for x in out], pa.string())], ["seq", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])
        for b in batches:
            for seq, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if seq == last:
                    state.update(b"," + piece.encode())
                    continue
                if last is not None:
                    yield done()
                last, state = seq, hashlib.sha256(piece.encode())
        if last is not None:
            yield done()

    listed = members.join(many, "seq").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(pieces, "seq binary, first long, piece string")
    rest = listed.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq binary, ends_sha256 string")
    return few.unionByName(rest)


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of convs (conv_id, turns: id and size): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of a conversation's first turns, the root being the empty one; a conversation without turns ends there. No
    conversations give no nodes. One conversation's ids (24 bytes a turn) have to fit a task.
    """
    seq = F.unhex(F.substring(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""), 256), 1, 2 * WIDTH))
    members = C.durable(convs.select("conv_id", seq.alias("seq"), "turns"), "trie-conversations")
    distinct, n_distinct = C.counted(members.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.first("turns").alias("turns")), "trie-sequences")
    every, n_rows = C.counted(prefixes(distinct), "trie-prefixes")
    ends = F.max(F.when(F.col("below") == 1, F.col("seq"))).alias("seq")
    per = every.groupBy("prefix").agg(F.sum("below").alias("weight"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("size").alias("size"), ends)
    heavy, n_heavy = C.counted(per.filter((F.col("weight") > limit) | (F.col("depth") == 0)).drop("weight"), "trie-heavy")

    marked = C.join_hot(every.select("seq", "depth", "prefix", "parent"), heavy.select("prefix", "rows", F.lit(True).alias("heavy")), "prefix", n_heavy, n_rows, "left", times="rows")
    light = F.col("heavy").isNull()
    cuts = marked.groupBy("seq").agg(F.max(F.when(~light, F.col("depth"))).alias("cut"), F.min(F.when(light, F.struct("depth", "prefix", "parent"))).alias("root")).filter("root is not null")
    shard = F.pmod(F.xxhash64("root.prefix"), F.lit(max(1, -(-n_rows // limit)))).alias("shard")
    shards = distinct.join(cuts, "seq").select(shard, "seq", "n", "low", "cut", F.col("root.parent").alias("top"), F.col("turns.id").alias("id"), F.col("turns.size").alias("size"))
    nodes = C.durable(light_nodes(shards), "trie-nodes")

    below = nodes.filter("top is not null").groupBy(F.col("top").alias("prefix")).agg(F.count(F.lit(1)).alias("n_light"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    above = heavy.filter("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_heavy"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    tops = heavy.join(C.small(below, n_heavy), "prefix", "left").join(C.small(above, n_heavy), "prefix", "left")
    tops = tops.withColumns({"n_light": zero("n_light"), "n_heavy": zero("n_heavy"), "leaves": F.greatest(zero("l"), (zero("n_light") + zero("n_heavy") == 0).cast("long")), "saved": (F.col("n_convs") - 1) * F.col("size") + zero("s")})
    tops = C.durable(tops.drop("l", "s"), "trie-tops")
    sums = rolled_up(tops, n_heavy)
    lows = tops.select(F.col("prefix").alias("top"), F.col("conv_id").alias("top_low"), "n_light", "n_heavy")
    done = C.join_hot(tops.drop("leaves", "saved", "rows").withColumnsRenamed({"parent": "top", "n_light": "own_light", "n_heavy": "own_heavy"}), lows, "top", n_heavy, n_heavy, "left", times="n_heavy").join(C.small(sums, n_heavy), "prefix")
    done = done.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("top_low").alias("parent_conv_id"), "n_convs", (F.col("own_light") + F.col("own_heavy")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "seq")
    inner = C.join_hot(nodes.filter("top is not null"), lows, "top", n_heavy, n_rows, "left", times="n_light").withColumn("parent_conv_id", F.col("top_low"))
    all_nodes = done.unionByName(inner.select(*done.columns)).unionByName(nodes.filter("top is null").select(*done.columns))
    digests = ends_digests(members.select("seq", "conv_id"), distinct)
    last = all_nodes.filter("seq is not null").join(digests, "seq").drop("seq")
    return last.unionByName(all_nodes.filter("seq is null").drop("seq").withColumn("ends_sha256", F.lit(EMPTY)))


def prefix_trie(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of the conversations as they are: rows are conv_id, turn, role, text in any order.

    Turns go by turn, null first, and those of one number by their id's bytes; equal rows are turns of their own. A null role or text is empty;
    rows without a conv_id belong to no conversation. Other columns are ignored.
    """
    return trie(conversations(rows), limit)


def op11_radix_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(branched(conversations(C.table(spark, sf_dir, "conversations"))))
