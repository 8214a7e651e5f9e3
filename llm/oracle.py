"""DuckDB SQL of the queries that it can express over the whole tables."""

from __future__ import annotations

# Floors of 64 x are integers, so the products are exact; ties go to the smaller id.
OP1 = """
WITH v AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    GROUP BY vec_id),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

# Equal payloads of at least 100 bytes: the smallest page_id (null last) is the response, one row of it.
OP4 = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 OR payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 AND payload_bytes >= 100 THEN first END AS refers_to,
       CASE WHEN n = 1 OR payload_bytes < 100 THEN true END AS intact
FROM r
"""

# The host lies after the first "://" up to one of /?# and the path after it up to ? or #. A rule fits a host
# that is its own or ends with a dot and its own, and a path that starts with its own.
OP11 = r"""
WITH rules(host, path, verdict) AS (VALUES
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
urls AS (
    SELECT row_number() OVER () AS n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM hosts),
fit AS (
    SELECT u.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
    GROUP BY u.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fit USING (n)
"""


def _crc_table() -> str:
    """The 256 entries of the CRC-32 step, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(str(c))
    return "[" + ", ".join(out) + "]::BIGINT[]"


# Prefixes are named by a chain of digests over the turns; the sums over a subtree go up level by level
# through pairs of a node and each prefix of it.
OP12 = f"""
WITH RECURSIVE digests AS (
    SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
           left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS d
    FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
    SELECT conv_id, d, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM digests),
ids AS (SELECT DISTINCT conv_id FROM numbered),
crcs AS (
    SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda a, b: xor(a >> 8, list_extract({_crc_table()}, 1 + (xor(a, b) & 255)))), 4294967295::BIGINT) % 6 AS h
    FROM ids),
convs AS (SELECT conv_id, h, conv_id - conv_id % 100 AS base FROM crcs),
heads AS (SELECT c.conv_id, b.pos, b.d, b.chars FROM convs c JOIN numbered b ON b.conv_id = c.base AND b.pos <= c.h),
taken AS (SELECT c.conv_id, count(h.pos) AS n FROM convs c LEFT JOIN heads h USING (conv_id) GROUP BY 1),
turns AS (
    SELECT conv_id, pos AS depth, d, chars FROM heads
    UNION ALL SELECT o.conv_id, o.pos - c.h + t.n, o.d, o.chars FROM numbered o JOIN convs c USING (conv_id) JOIN taken t USING (conv_id) WHERE o.pos > c.h),
steps AS (
    SELECT conv_id, depth, chars, md5(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
above AS (SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS size FROM steps),
nodes AS (
    SELECT name, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * any_value(chars) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256
    FROM above GROUP BY name),
children AS (SELECT parent AS name, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
pairs AS (SELECT DISTINCT a.name AS top, b.name AS below FROM above a JOIN above b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
    SELECT p.top AS name, sum(n.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM pairs p JOIN nodes n ON n.name = p.below LEFT JOIN children c ON c.name = p.below GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (name) LEFT JOIN children c ON c.name = n.name LEFT JOIN nodes p ON p.name = n.parent
"""


def _rounds(rounds: int) -> str:
    """Lloyd's rounds over (n, dim, x) and (c, dim, x) rows, a pair of tables each."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
far{r} AS MATERIALIZED (
    SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT v.n, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM cells v JOIN cent{r} k USING (dim) GROUP BY 1, 2) GROUP BY 1)""")
        if r < rounds:
            out.append(f"""
cent{r + 1} AS MATERIALIZED (
    SELECT k.c, k.dim, coalesce(m.x, k.x) AS x
    FROM cent{r} k LEFT JOIN (
        SELECT f.c, v.dim, CASE WHEN sum(v.x) >= 0 THEN sum(v.x)::HUGEINT // count(*) ELSE -((-sum(v.x)::HUGEINT + count(*) - 1) // count(*)) END::BIGINT AS x
        FROM cells v JOIN far{r} f USING (n) GROUP BY 1, 2) m USING (c, dim))""")
    return ",".join(out)


OP13 = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
cells AS MATERIALIZED (SELECT n, unnest(generate_series(1, 64)) AS dim, unnest(v) AS x FROM kept),
chosen AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c FROM kept),
cent0 AS MATERIALIZED (SELECT c, unnest(generate_series(1, 64)) AS dim, unnest(v) AS x FROM chosen WHERE c < 8),{_rounds(10)},
shas AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS sha FROM cent10 GROUP BY 1)
SELECT k.vec_id, f.c::INTEGER AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia,
       (sum(f.d) OVER ())::BIGINT AS inertia, s.sha AS centroid_sha256
FROM kept k JOIN far10 f USING (n) JOIN shas s ON s.c = f.c
"""

# Windows of three lines (all lines of a shorter text) with a letter or digit; every occurrence but the first, by
# document, text hash and position, covers its lines. Texts that share an id are rare and ordered by Spark's hash of
# them, which SQL lacks: there are none in the tables, so the id alone decides.
OP6 = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS lines FROM d),
w AS (
    SELECT doc_id, text, least(len(lines), 3) AS size, pos, array_to_string(lines[pos + 1:pos + 3], chr(10)) AS body
    FROM (SELECT *, unnest(generate_series(0, greatest(len(lines) - 3, 0))) AS pos FROM l)),
n AS (
    SELECT *, row_number() OVER (PARTITION BY size, body ORDER BY doc_id NULLS FIRST, text, pos) AS nth
    FROM w WHERE regexp_matches(body, '[\p{L}\p{N}]')),
gone AS (
    SELECT doc_id, text, list_sort(list_distinct(flatten(list(generate_series(pos, pos + size - 1))))) AS places FROM n WHERE nth > 1 GROUP BY 1, 2),
kept AS (
    SELECT o.doc_id, o.text AS whole, coalesce(len(g.places), 0)::INTEGER AS n_removed,
           CASE WHEN g.places IS NULL THEN o.text ELSE array_to_string(list_transform(list_filter(list_zip(string_split(o.text, chr(10)),
                generate_series(0, len(string_split(o.text, chr(10))) - 1)), lambda x: NOT list_contains(g.places, x[2])), lambda x: x[1]), chr(10)) END AS text
    FROM documents o LEFT JOIN gone g ON o.doc_id IS NOT DISTINCT FROM g.doc_id AND o.text = g.text)
SELECT doc_id, n_removed, sha256(text) AS text_sha256, length(text)::BIGINT AS n_chars FROM kept
"""

# Pairs of documents with a common shingle, then the smallest id reachable over near pairs.
OP7 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words),
alike AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
parts AS MATERIALIZED (SELECT rep, n, hash(unnest(s)) AS h FROM alike),
counted AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY h) AS f FROM parts),
early AS MATERIALIZED (
    SELECT rep, n, h FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY f, h) AS i FROM counted) WHERE i <= n - (85 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM early a JOIN early b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS MATERIALIZED (
    SELECT m.a, m.b FROM met m JOIN alike x ON x.rep = m.a JOIN alike y ON y.rep = m.b
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM alike UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
groups AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY 1)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(g.component_id, t.doc_id) AS component_id, coalesce(g.component_id, t.doc_id) = t.doc_id AS kept
FROM sets t LEFT JOIN alike c ON len(t.s) > 0 AND list_sort(t.s) = c.s LEFT JOIN groups g ON g.rep = c.rep
"""

# Cosines of all pairs; what the audit reports where every link is found.
OP8 = """
WITH RECURSIVE v AS MATERIALIZED (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b, a.x <> b.x AS differ
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
groups AS (SELECT a AS vec_id, min(b) AS component FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(g.component, e.vec_id) AS component_id,
       coalesce(g.component, e.vec_id) = e.vec_id AS kept, (SELECT CASE WHEN bool_or(differ) THEN 1 END FROM links)::DOUBLE AS audited_recall
FROM embeddings e LEFT JOIN groups g USING (vec_id) LEFT JOIN counts c USING (vec_id)
"""

ORACLE: dict[str, str] = {"op1_ball_tree": OP1, "op4_warc": OP4, "op6_line_dedup": OP6, "op7_lsh_forest": OP7, "op8_flat_graph": OP8,
                          "op11_bloom_cascade": OP11, "op12_prefix_trie": OP12, "op13_threshold_kmeans": OP13}
