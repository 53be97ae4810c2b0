"""DuckDB SQL for the queries that SQL can express. Each is written from the contract, not from the Spark plan."""

from __future__ import annotations

from . import sharding

WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP2 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM h) WHERE c > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
k AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE
    (SELECT string_agg(u.word, ' ' ORDER BY u.p) FROM (SELECT unnest(w.w) AS word, unnest(range(1, len(w.w) + 1)) AS p) u WHERE NOT list_contains(gone, u.p)) END, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP3 = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, i, l[i] AS line, ('0x' || substr(md5(l[i]), 1, 7))::BIGINT AS h, len(l) AS n FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)),
e AS (
  SELECT *, CASE WHEN h = lag(h) OVER w AND h = lag(h, 2) OVER w THEN i % 2 = 0
    ELSE (h + 31 * coalesce(lag(h) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 1000003 % 4 = 0 END OR i = n AS ends FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM e),
k AS (SELECT doc_id, nth, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM c GROUP BY doc_id, nth),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, chunk ORDER BY doc_id, nth) > 1 AS gone FROM k)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed, count(*) AS n_chunks,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

OP6 = r"""
WITH trap AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', text FROM trap UNION ALL SELECT -1, 1, 'assistant', text FROM trap
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 12 + 1 + 10 + 1)::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

OP7_QUEUES = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(md5(coalesce(text, '')))) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][(source_rank - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_before,
    sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight_left,
    sum(source_size) OVER ()::BIGINT AS budget
  FROM w
), g AS (SELECT *, cap::DOUBLE * weight_left <= (budget - full_before) * weight AS is_full FROM f),
t AS (
  SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE
    (budget - coalesce(sum(cap::DOUBLE) FILTER (is_full) OVER (), 0.0)) * weight::DOUBLE / sum(weight::DOUBLE) FILTER (NOT is_full) OVER () END AS target FROM g
), c AS (
  SELECT d.doc_id, d.size, d.k, t.source_size, t.source_rank, t.target, t.budget, sum(d.size) OVER (PARTITION BY t.source_rank ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), v AS (
  SELECT *, CASE WHEN target > 0 THEN (e * source_size + cum)::DOUBLE / target ELSE 0.0 END AS v FROM c, (VALUES (0), (1), (2)) x(e)
), r AS (SELECT *, sum(size) OVER (ORDER BY v, source_rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM v),
c0 AS (
  SELECT doc_id, k, size, source_rank, source_size, target, count(*) FILTER (total <= budget AND v <= 1) AS copies FROM r GROUP BY ALL
)"""


def op7_sql(fills: int = 3, max_epochs: int = 3) -> str:
    """The queues up to time 1, then for each source the longest document that fits, `fills` times."""
    sql = OP7_QUEUES
    for i in range(fills):
        sql += f""", f{i} AS (
  SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY size > 0 AND size <= room AND copies < {max_epochs} DESC, size DESC, k DESC, doc_id DESC NULLS LAST) = 1
    AND size > 0 AND size <= room AND copies < {max_epochs} AS best
  FROM (SELECT *, target - sum(copies * size) OVER (PARTITION BY source_rank) AS room FROM c{i})
), c{i + 1} AS (SELECT * EXCLUDE (room, best) REPLACE (copies + best::INT AS copies) FROM f{i})"""
    return sql + f" SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c{fills}"


def op8_sql(n_shards: int = 16, seed: int = 8, walks: int = 12) -> str:
    """The permutation round by round; the law, sizes and slots need no more than the row numbers. `walks` passes are written out; a table that would need more is an error."""

    def rounds(x: str, stage: str) -> str:
        out = f", {stage}0 AS (SELECT *, {x} // b AS p, {x} % b AS q FROM {stage}in)"
        for i, key in enumerate(sharding.round_keys(seed)):
            arg = "q" if i % 2 == 0 else "p"
            t = f"(({arg} % {sharding.PRIME} * {sharding.MULT} + {key}) % {sharding.PRIME})"
            mixed = f"(({t} * {t} % {sharding.PRIME} * {sharding.ROUND_MULT} + {arg} % {sharding.PRIME}) % {sharding.PRIME})"
            new = f"(p + {mixed}) % a AS p, q" if i % 2 == 0 else f"p, (q + {mixed}) % b AS q"
            out += f", {stage}{i + 1} AS (SELECT * EXCLUDE (p, q), {new} FROM {stage}{i})"
        return out

    sql = """WITH n AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, coalesce(text, '') AS text,
  row_number() OVER (ORDER BY md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(md5(coalesce(text, '')))), doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
root AS (SELECT DISTINCT n AS m, ceil(sqrt(n::DOUBLE))::BIGINT AS r FROM n),
least AS (SELECT arg_min(a, (((m + a - 1) // a) * a - m, a)) AS a FROM (SELECT m, unnest(range(r, 2 * r + 1)) AS a FROM root)),
side AS (SELECT n.*, a FROM n, least), w0 AS (SELECT *, (n + a - 1) // a AS b, false AS ok FROM side)"""
    last = len(sharding.round_keys(seed))
    for i in range(walks):
        sql += f", s{i}_in AS (SELECT * FROM w{i})" + rounds("x", f"s{i}_")
        sql += f", w{i + 1} AS (SELECT * EXCLUDE (x, ok, p, q), CASE WHEN ok THEN x ELSE p * b + q END AS x, ok OR p * b + q < n AS ok FROM s{i}_{last})"
    return sql + f" SELECT doc_id, CASE WHEN ok THEN x ELSE error('more walks are needed')::BIGINT END AS x, size, text, ok, (x % {n_shards})::INTEGER AS shard, x // {n_shards} AS slot FROM w{walks}"



SQL = {"op1_fuse_exact_dedup": OP1, "op2_fm_substring_dedup": OP2, "op3_chunked_line_dedup": OP3, "op4_superminhash_near_dedup": OP4, "op6_reply_tree_chat": OP6, "op7_weighted_mix": op7_sql()}


def op8_full_sql() -> str:
    """op 8's contract columns; DuckDB has no CRC-32, so it is folded over the bytes with a table made from the reversed polynomial 3988292384."""
    return f"""SELECT doc_id, size, (xor(list_reduce(list_transform(range(strlen(text)), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295))::BIGINT AS text_crc32,
  'rows' AS law, shard, slot, NULL::INTEGER AS grown_shard
FROM (SELECT *, hex(encode(text)) AS hx FROM ({op8_sql()})), (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i))
)"""


SQL["op8_feistel_sharding"] = op8_full_sql()

#: For items of five words and more, as all of the driver's are.
SQL["op9_simhash_decontamination"] = rf"""
WITH low AS (SELECT 'd' AS t, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT t, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM low),
s AS MATERIALIZED (SELECT t, id, len(w) AS n, p, array_to_string(w[p:p + 4], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
i AS MATERIALIZED (SELECT id AS item_id, n AS l, sh, count(*) AS c FROM s WHERE t = 'i' GROUP BY ALL),
h AS (SELECT DISTINCT s.id AS doc_id, s.n, i.item_id, i.l, unnest(range(greatest(1, s.p - i.l + 5), least(s.p, greatest(1, s.n - i.l + 1)) + 1)) AS a FROM s JOIN i ON s.sh = i.sh WHERE s.t = 'd'),
m AS (SELECT h.*, s.sh, count(*) AS c FROM h JOIN s ON s.t = 'd' AND s.id = h.doc_id AND s.p BETWEEN h.a AND h.a + least(h.l, h.n) - 5 GROUP BY ALL),
b AS (SELECT m.doc_id, m.item_id, m.a, m.l, m.n, sum(least(m.c, i.c))::BIGINT AS shared FROM m JOIN i ON m.item_id = i.item_id AND m.sh = i.sh GROUP BY ALL),
v AS (SELECT *, shared::DOUBLE / (least(l, n) - 4 + l - 4 - shared) AS similarity FROM b)
SELECT doc_id, item_id, (a - 1)::INTEGER AS start, least(l, n)::INTEGER AS n_words, similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) AS r FROM v WHERE similarity >= 0.8) WHERE r = 1
"""

SQL["op13_pivot_top_k"] = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""

CRC_TABLE = """(SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i)))"""

#: Prefixes are named by a digest of their turns' digests; a subtree is every node whose first member has the prefix at its depth.
SQL["op11_radix_prefix_trie"] = f"""
WITH rows_ AS (
  SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS id, strlen(text)::BIGINT AS size
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(size ORDER BY turn NULLS FIRST, id) AS sizes, hex(encode(conv_id::VARCHAR)) AS hx FROM rows_ GROUP BY conv_id),
own_h AS (
  SELECT own.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM own, {CRC_TABLE}
), seqs AS (
  SELECT a.conv_id AS c, list_concat(coalesce(b.ids[1:a.h], []), a.ids[a.h + 1:]) AS ids, list_concat(coalesce(b.sizes[1:a.h], []), a.sizes[a.h + 1:]) AS sizes
  FROM own_h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), p AS MATERIALIZED (
  SELECT c, len(ids) AS n, d, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, md5(coalesce(array_to_string(ids[1:d], ','), '')) AS node,
    CASE WHEN d > 0 THEN md5(coalesce(array_to_string(ids[1:d - 1], ','), '')) END AS up
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM seqs)
), v AS MATERIALIZED (
  SELECT node, any_value(up) AS up, any_value(d) AS depth, min(c) AS low, count(*) AS n_convs, any_value(size) AS size, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM p GROUP BY node
), k AS (SELECT up, count(*) AS kids FROM v WHERE up IS NOT NULL GROUP BY up),
s AS (
  SELECT p.node, count(*) FILTER (k.kids IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.size)::BIGINT AS saved_tokens
  FROM v LEFT JOIN k ON k.up = v.node JOIN p ON p.c = v.low AND p.d <= v.depth GROUP BY p.node
)
SELECT v.low AS conv_id, v.depth, a.low AS parent_conv_id, v.n_convs, coalesce(k.kids, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s USING (node) LEFT JOIN k ON k.up = v.node LEFT JOIN v a ON a.node = v.up
"""
