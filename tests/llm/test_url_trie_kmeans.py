"""URL rules, conversation trie and k-means against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import bloom_cascade, prefix_trie, queries, threshold_kmeans
from llm.ship import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# -- 11

RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.b.com", "", "block"), ("net", "/x", "allow"), ("net", "/x", "block"), ("bad", "x", "block"),
         (None, "/", "block"), ("net", None, "block")]
URLS = [None, "", "no scheme example.org/es/", "http://", "http://example.org", "http://EXAMPLE.org/es/1", "https://www.example.org/es",
        "ftp://x.example.org/en/123?x#y", "http://notexample.org/es/", "http://example.org./es/", "http://a.com/fr/#", "http://a.com?/fr/",
        "http://a.com/FR/", "http://a.b.com", "http://z.a.b.com/de/fr/", "http://ab.com/de/", "a://net/x/y://org/", "http://u:p@net:80/x",
        "http://x.net/xyz", "http://bad/x", "http://badx", "http://org/" + "long/" * 20_000, "http://" + "a." * 5_000 + "com/de/", "http://com/de/\nline"]


def brute_verdict(url, rules):
    rest = (url or "").partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v, h.lower() + p) for h, p, v in rules
           if h is not None and p is not None and p[:1] in ("", "/") and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("max_bytes", [1 << 20, 4])
def test_verdicts_against_brute_force(spark, max_bytes):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "r"), (None, URLS[5], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = bloom_cascade.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), max_bytes=max_bytes)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((i, *brute_verdict(u, RULES)) for i, u, *_ in rows)


def test_verdicts_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert bloom_cascade.judge(pages.where("false"), rules).count() == 0
    assert bloom_cascade.judge(pages, rules.where("false"), default="block").collect()[0][1:] == ("a.org", "/x", None, "block")


def test_cascade_is_exact_over_a_large_universe(spark):
    keys = spark.range(40_000).selectExpr("xxhash64(id) as h1", "xxhash64(1, id) as h2", "id % 37 = 0 as listed").cache()
    cascade = bloom_cascade.build(keys)
    rows = keys.toPandas()
    assert (cascade.member(rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all()
    listed = int(rows.listed.sum())
    assert len(cascade.levels) > 3 and cascade.nbytes * 8 < listed * (1.5 * np.log2(36) + 10)
    assert bloom_cascade.build(keys.where("not listed")).member(rows.h1.to_numpy(), rows.h2.to_numpy()).sum() == 0


# -- 12

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn), d, (role, text)))
    turns = {c: [t for _, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children, below = Counter(n[:-1] for n in members if n), defaultdict(list)
    for n in members:
        for d in range(len(n) + 1):
            below[n[:d]].append(n)
    out = Counter()
    for n, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(rebuilt[c]) == len(n))
        out[cs[0], len(n), members[n[:-1]][0] if n else None, len(cs), children[n], sum(not children[b] for b in below[n]),
            sum((len(members[b]) - 1) * len(b[-1][1]) for b in below[n] if b), hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(seed, n, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 3 * n), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "é", None]), rng.choice(words)))
    return rows


CASES = {
    "mixed": conversations(1, 150, ["a", "", None, "bcd\ud7ff", "long " * 300], 9) + [(None, 1, "user", "x"), (7, None, "user", "null turn"), (7, 1, "b", "tie"), (7, 1, "a", "tie")],
    "copies": [(c, t, "user", f"turn {t}") for c in range(1, 1400) for t in range(4)] + conversations(2, 40, ["turn 0", "turn 1"], 5),
    "deep": [(c, t, "user", "same" if t < 5 + 4 * c else f"{c}-{t}") for c in range(12) for t in range(40)]
    + [(c, t, "user", "same") for c in range(200, 203) for t in range(12)] + [(300, t, "user", "same") for t in range(16)],
    "turnless": [(c, 0, "user", "x") for c in range(101, 130)],
}


@pytest.mark.parametrize("case", list(CASES))
@pytest.mark.parametrize("segment,rows,weight", [(256, 16_384, 262_144), (4, 7, 20)])
def test_trie_against_brute_force(spark, monkeypatch, case, segment, rows, weight):
    if rows == 7 and case == "copies":
        rows, weight = 500, 10_000
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", rows)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", weight)
    data = CASES[case]
    df = spark.createDataFrame([(*r, 1, "x") for r in data + data[:1]], "conv_id long, turn long, role string, text string, depth int, key string")
    got = prefix_trie.prefix_trie(df.repartition(5), segment=segment)
    assert got.columns == list(prefix_trie._RESULT)
    assert Counter(map(tuple, got.collect())) == brute_trie(data + data[:1])


def test_trie_of_an_empty_table(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0


# -- 13

def test_threshold_walk_finds_the_nearest_and_stops_early():
    rng = np.random.default_rng(5)
    for k, dims, spread in ((8, 64, 50), (8, 2, 4), (40, 2, 1000), (1, 3, 9), (60, 1, 10_000)):
        centroids, x = rng.integers(-spread, spread, (k, dims)), rng.integers(-spread, spread, (700, dims))
        x[:k] = centroids  # ties and exact hits
        far = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        own, best, computed = threshold_kmeans.Lists(centroids).walk(x)
        assert (own == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
        if k >= 40:
            assert computed.mean() < k / 3


def brute_kmeans(rows, k, rounds, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in map(float, v)]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, vs in groups.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in got:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in got)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(9)
    good = [(i, (rng.normal(size=64) + 4 * (i % 3)).round(2).tolist()) for i in range(120)]
    bad = [(500, None), (501, [1.0] * 63), (502, [float("nan")] * 64), (503, [None] + [1.0] * 63), (504, [float("inf")] * 64), (505, [])]
    rows = good + bad + good[:3] + [(1, [0.5] * 64), (None, [0.25] * 64)] + [(i, [0.0] * 64) for i in range(600, 620)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int")
    got = threshold_kmeans.cluster(df.repartition(3))
    assert Counter(map(tuple, got.collect())) == brute_kmeans(rows, 8, 10, 1024)


def test_clusters_of_few_vectors_and_of_none(spark):
    rows = [(1, [1.0] * 64), (2, [-1.0] * 64), (None, [3.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(map(tuple, threshold_kmeans.cluster(df).collect())) == brute_kmeans(rows, 8, 10, 1024)
    assert threshold_kmeans.cluster(df.where("false")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        threshold_kmeans.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


# -- the queries

@pytest.mark.parametrize("name", ["op11_bloom_cascade", "op12_prefix_trie", "op13_threshold_kmeans"])
def test_queries_equal_sql(spark, name):
    import oracle_check

    sf = "/root/testdata/sf0.001"
    got = oracle_check.compare(spark, oracle_check.duck(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert got["ok"] and got["rows"][0] > 0
