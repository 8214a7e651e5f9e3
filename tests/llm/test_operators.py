"""Operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import glob
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import ball_tree, bfd_output, bpe, flat_graph, line_dedup, lsh_forest, ngram_trie, nnls_pack, queries, toxicity, warc
from llm.common import _CLEAN_UP, materialise
from llm.elias_fano import EliasFano
from llm.ship import ship
from llm_samples import DOCS, EMPTY, brute_groups, words_of


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty and long texts, copies, a repeated row, and extra columns with clashing names."""
    return spark.createDataFrame(DOCS, "doc_id long, text string, id long, n long, words string, step int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EMPTY)


@pytest.fixture(scope="module")
def source():
    return queries.tokenizer_source()


# -- 1

def brute_top(rows, k):
    best = {i: np.floor(64 * np.array(v, float)) for i, v in rows}
    out = {}
    for q in best:
        if q % 20 == 0:
            s = sorted(((-int(best[q] @ best[i]), i) for i in best if i != q and len(best[i]) == len(best[q])))[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def test_top_k_with_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 50)
    monkeypatch.setattr(ball_tree, "LEAF", 8)
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(i, good_copy) for i in range(300, 320) for good_copy in [[0.5] * 6]]
    bad = [(1000, None), (1020, [None] + [1.0] * 5), (1040, [float("nan")] * 6), (1060, []), (None, [1.0] * 6), (1080, [float("inf")] * 6)]
    df = spark.createDataFrame(good + bad + [good[20]], "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("vec", F.lit(2))
    got = defaultdict(list)
    for r in ball_tree.top_k(df, F.col("id") % 20 == 0, k=7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_top(good, 7)
    assert set(got) == set(want)
    for q in want:
        assert [(i, s) for _, i, s in sorted(got[q])] == want[q] and sorted(x[0] for x in got[q]) == list(range(1, 8))


def test_top_k_large_numbers_are_exact(spark):
    rows = [(i, [float(2**28 + i), float(2**27 - i)]) for i in range(30)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ball_tree.top_k(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=3, scale=1.0).collect()}
    for q in (0, 20):
        s = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -x) for x, i in s]


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_tree.top_k(df, F.col("id") % 20 == 0).count() == 0
    assert flat_graph.near_vectors(df).count() == 0


# -- 2

def test_ball_tree_of_many_levels_prunes_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF", 8)  # the tree is built in this process
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 12)) * 400
    x = np.floor(centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 12)) * 20)
    x[100:110] = x[100]  # ties
    ids = rng.permutation(5000)[:1500]
    tree = ball_tree.BallTree.load(ball_tree.BallTree(ids, x).dump())
    depth = {0: 1}
    for i in np.flatnonzero(tree.child):
        depth[tree.child[i]] = depth[tree.child[i] + 1] = depth[i] + 1
    assert max(depth.values()) >= 8
    seen, real = [], ball_tree.products
    monkeypatch.setattr(ball_tree, "products", lambda q, p: seen.append(len(q) * len(p)) or real(q, p))
    for known in (False, True):
        want = []
        for q, v in zip(ids[:60], x[:60]):
            s = sorted((-int(v @ w), int(i)) for i, w in zip(ids, x) if i != q)[:5]
            want.append([(i, -n) for n, i in s])
        kth = np.array([w[-1][1] if known else ball_tree._NONE for w in want])
        scores, found = tree.search(ids[:60], x[:60], 5, kth)
        assert [list(zip(f.tolist(), s.tolist())) for f, s in zip(found, scores)] == want
    assert sum(seen) < 60 * 1500  # both searches together need fewer products than one scan


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (1000, 1 << 40), (5000, 6000), (0, 1), (70000, 1 << 61), (3000, 1 << 20)):
        v = np.unique(rng.integers(0, top, n))
        q = np.concatenate([v, rng.integers(0, top, 500)])
        at = {int(x): i for i, x in enumerate(v)}
        e = EliasFano.of(EliasFano.build(v).parts())
        want = [at.get(int(x), -1) for x in q]
        assert e.find(q).tolist() == want
        assert e.at(np.arange(len(v))).tolist() == v.tolist()
        assert [int(e.find(q[k:k + 1])[0]) for k in range(0, len(q), 400)] == want[::400]


@pytest.mark.parametrize("chunk,shard", [(1_500_000, 1_200_000), (300, 60), (5000, 15)])
def test_scores_against_brute_force(spark, docs, monkeypatch, chunk, shard):
    monkeypatch.setattr(ngram_trie, "CHUNK", chunk)
    monkeypatch.setattr(ngram_trie, "SHARD", shard)  # the smaller sizes split frequent words over shards
    df = docs.withColumn("train", F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2)
    got = ngram_trie.score(df).collect()
    rows = [(i, [*words_of(t), 0], (i or 0) % 7 != 2) for i, t, *_ in DOCS]
    c1, c2, c3, t1, t2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, ws, train in rows:
        u = v = 1
        for w in ws if train else ():
            c1[w] += 1; c2[v, w] += 1; c3[u, v, w] += 1; t1[v] += 1; t2[u, v] += 1  # noqa: E702
            u, v = v, w
    n, vocabulary, want = sum(c1.values()), len(c1), Counter()
    m2, m3 = ngram_trie.M2, ngram_trie.M3
    for i, ws, train in rows:
        base = score = 0.0
        u = v = 1
        for w in ws:
            p1 = (c1[w] + 1) / (n + vocabulary + 1)
            p2 = (c2[v, w] + m2 * p1) / (t1[v] + m2)
            base += np.log10(p1)
            score += np.log10((c3[u, v, w] + m3 * p2) / (t2[u, v] + m3))
            u, v = v, w
        want[i, train, len(ws), sum(c1[w] > 0 for w in ws), n, round(base, 6)] += 1
        assert any(r.doc_id == i and abs(r.score - score) <= 0.03 * len(ws) for r in got)
    assert Counter((r.doc_id, r.trained, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


@pytest.mark.parametrize("shard", [1_200_000, 60])
def test_stored_model_scores_as_the_run_that_made_it(spark, docs, empty, monkeypatch, scratch, shard):
    monkeypatch.setattr(ngram_trie, "CHUNK", 300)
    monkeypatch.setattr(ngram_trie, "SHARD", shard)
    df = docs.withColumn("train", F.col("doc_id") % 7 != 2)
    want = ngram_trie.score(df, keep=scratch).drop("trained").collect()
    monkeypatch.setattr(ngram_trie, "CHUNK", 5000)
    key = lambda r: (r.doc_id or 0, r.n_tokens, round(r.base_score, 6), round(r.score, 6), r.n_known, r.train_tokens)
    got = ngram_trie.score_with(docs, scratch)
    assert Counter(map(key, want)) == Counter(map(key, got.collect())) and got.where("trained").count() == 0
    new = spark.createDataFrame([(1, "zzyzx quux unheard"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_known) for r in ngram_trie.score_with(new, scratch).orderBy("doc_id").collect()] == [(1, 1), (2, 1)]
    assert ngram_trie.score_with(empty, scratch).count() == 0


def test_a_shard_holds_smoothed_values_of_neighbouring_words():
    words = np.array([5, (7 << 32) + 4, (7 << 32) + 5])
    setting = ngram_trie.Setting.of(4, 1, 3, 1, {})
    block = ngram_trie.dump(*(
        np.array(x, np.uint64) for x in (np.diff(words, prepend=0), [4, 3, 1], [0], [2], [1], [1, 1], [0], [2], [0, 1], [3, 1])))
    (answer,), trie = ngram_trie.serve_shard([block], setting)
    total, code2, _, code3 = ngram_trie.load(answer)
    p1 = setting.unigram(np.array([3, 1]))
    p2 = (np.array([3, 1]) + ngram_trie.M2 * p1) / (4 + ngram_trie.M2)
    p3 = (np.array([3, 1]) + ngram_trie.M3 * p2) / (4 + ngram_trie.M3)
    assert total.tolist() == [4] and code2.tolist() == ngram_trie.quantise(p2).tolist() and code3.tolist() == ngram_trie.quantise(p3).tolist()
    again, _ = ngram_trie.serve_shard([block], setting, ngram_trie.Trie.load(trie.dump()))
    assert again == [answer]


def test_scores_without_training_rows_or_rows(spark, docs, empty):
    got = ngram_trie.score(docs.withColumn("train", F.lit(False))).collect()
    assert len(got) == len(DOCS) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert ngram_trie.score(empty.withColumn("train", F.lit(True))).count() == 0


# -- 3

def test_toxicity_learns_planted_words_in_long_texts_too(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_SLICE", 500)
    rng = np.random.default_rng(1)
    plain = ["lamp", "river", "stone", "walks", "green", "house", "over", "under", "seven", "boats"]
    rows = []
    for i in range(400):
        ws = rng.choice(plain, rng.integers(5, 400)).tolist()
        if i % 4 == 0:
            ws.insert(int(rng.integers(0, len(ws))), "grobnik")
        rows.append((i, " ".join(ws), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.where("doc_id < 300"), df.select("doc_id", "label"))
    extra = spark.createDataFrame([(900, None, None), (901, "", None)], df.schema)
    got = {r.doc_id: r.s for r in df.union(extra).withColumn("s", toxicity.score_column(df, model)).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 300)
    assert got[900] == got[901] and 0 <= got[900] < 0.5


def test_toxicity_counts_all_labels_and_keeps_their_share(spark):
    rng = np.random.default_rng(3)
    plain = ["lamp", "river", "stone", "walks", "green", "house", "over", "under", "seven", "boats"]
    rows = [(i, " ".join([*rng.choice(plain, 6), *["zyzzyva"] * (i % 10 == 0 and i % 100 < 20)]), int(i % 10 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df.select("doc_id", "label"), max_train=40)  # 20 of either class
    assert len(model.buckets)  # 20 of 100 toxic texts have the word: far too few in the sample
    got = {r.doc_id: r.s for r in df.withColumn("s", toxicity.score_column(df, model)).collect()}
    bare = [got[i] for i, t, _ in rows if "zyzzyva" not in t]
    assert max(bare) < 0.3 and abs(np.mean(bare) - 0.1) < 0.05
    everything = toxicity.fit(df, df.select("doc_id", "label"))
    assert (everything.buckets == model.buckets).all()


def test_toxicity_features_of_a_batch_stay_with_their_texts(spark):
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefgh "), toxicity._SLICE + 1000))
    texts = ["first short text", None, long, "another one", long[:40]]
    found = np.concatenate(list(toxicity.ngram_buckets(texts)))
    assert (np.diff(found) > 0).all()
    for i, text in enumerate(texts):
        alone = np.concatenate([np.zeros(0, np.int64), *toxicity.ngram_buckets([text])])
        assert (found[found >> toxicity.BUCKET_BITS == i] & (toxicity.BUCKETS - 1) == alone).all()
    rows = [(i, "grobnik" if i % 2 else "lamp", i % 2) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, long, 0)], "doc_id long, text string, label int").coalesce(1)
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "_logistic", lambda kept, r, y: (seen.append(sorted((int(v), len(x)) for x, v in zip(kept, y))), (np.zeros(len(r)), 0.0))[1])
        toxicity.fit(df, df.select("doc_id", "label"))
    assert Counter(seen[0])[0, 0] <= 1 and Counter(n for v, n in seen[0] if v)[0] == 0


def test_toxicity_without_two_classes(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert max(r.s for r in docs.select(toxicity.score_column(docs, toxicity.fit(docs, none)).alias("s")).collect()) < 1e-9
    assert toxicity.fit(empty, none).bias < 0


# -- 4

def test_warc_round_trip(spark, scratch):
    same = "x" * 150
    pages = [(1, "http://a/b?q=1", "é" * 60), (2, "http://a/c d", same), (3, None, same), (4, "u", ""), (5, "http://z", None), (6, "http://z", "x" * 99),
             (7, "http://z", "x" * 99), (8, "http://q", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc" * 9), (9, "http://q", same), (9, "http://q", same), (None, "http://n", same)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("type", F.lit("t")).withColumn("key", F.lit(1))
    warc.write(df, scratch)
    found = warc.records(spark, scratch)
    rows = warc.page_table(found).collect()
    assert len(rows) == len(pages) and [r.record_type for r in rows if r.page_id == 9] == ["revisit"] * 2
    got = {r.page_id: r for r in rows}
    for i, _, html in pages:
        data = (html or "").encode()
        again = html == same and i != 2
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 2) if again else ("response", None))
        assert again or got[i].intact
    whole = {r.metadata["fields"]["page_id"]: r for r in warc.assemble(found).collect()}
    assert bytes(whole["8"].response.payload) == pages[7][2].encode() and whole["1"].request is not None


@pytest.mark.parametrize("limit", [200_000, 0])
def test_repeated_pages_are_captures_of_their_own(spark, scratch, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    pages = [(1, "u", "long " * 40)] * 3 + [(2, "u", "short")] * 2 + [(3, "v", "long " * 40), (4, "w", "other " * 40), (4, "w", "other " * 40), (None, None, None), (None, None, None)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), scratch)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.page_table(warc.records(spark, scratch)).collect())
    assert got == sorted([(1, 200, "response", 0), (1, 200, "revisit", 1), (1, 200, "revisit", 1), (2, 5, "response", 0), (2, 5, "response", 0),
                          (3, 200, "revisit", 1), (4, 240, "response", 0), (4, 240, "revisit", 4), (0, 0, "response", 0), (0, 0, "response", 0)])


def test_warc_of_no_pages(spark, scratch):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), scratch)
    assert warc.page_table(warc.records(spark, scratch)).count() == 0


# -- 5

def test_bpe_equals_the_library(spark, docs, source):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(source)
    odd = ["", " ", "a<|endoftext|>b <|ENDOFTEXT|>", "it's don't I'LL --'s 123 4½", "ΟΔΟΣ Σ İ ẞ ﬁ é \u0085x y\x1cz", "日本 한국 🙂🙂 a\x00b", "A" * 500, "ab" * 300 + "!" * 77]
    rows = [(i, t) for i, t, *_ in DOCS] + [(1000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))
    got = bpe.encode(df, source).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    by = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df, source).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert by == {(r.doc_id, len(r.token_ids), sha(" ".join(map(str, r.token_ids))), sha(r.decoded)) for r in got}


# -- 6

def brute_lines(rows, width=3):
    seen, gone = {}, defaultdict(set)
    for i, t in rows:
        lines = (t or "").split("\n") if t else []
        for p in range(max(0, len(lines) - width) + 1 if lines else 0):
            w = tuple(x.rstrip("\r") if k < len(lines) - 1 else x for k, x in enumerate(lines))[p:p + width]
            if any(re.search(r"[^\W_]", x) for x in w):
                if w in seen:
                    gone[i].update(range(p, p + len(w)))
                seen.setdefault(w, i)
    return {i: t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_against_brute_force(docs):
    want = brute_lines([(None, r[1]) for r in DOCS if r[0] is None] + distinct_docs_without_null())  # null ids come first
    out = line_dedup.line_dedup(docs, removed_col="gone").collect()
    assert len(out) == len(DOCS)
    for r in out:
        assert r.text == want[r.doc_id]
    assert sum(r.gone for r in out) > 0


def distinct_docs_without_null():
    return sorted({(r[0], r[1]) for r in DOCS if r[0] is not None})


def test_line_dedup_of_an_empty_table(empty):
    assert line_dedup.line_dedup(empty).count() == 0


# -- 7

@pytest.mark.parametrize("threshold,width", [(0.85, 3), (0.8, 5)])
def test_near_duplicates_against_brute_force(docs, threshold, width):
    sizes, group = brute_groups(distinct_docs_without_null(), threshold, width)
    out = lsh_forest.near_duplicates(docs, threshold, width).collect()
    assert len(out) == len(DOCS)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], group[r.doc_id], group[r.doc_id] == r.doc_id)
        else:
            assert r.kept


def test_near_duplicates_of_an_empty_table(empty):
    assert lsh_forest.near_duplicates(empty).count() == 0


# -- 8

def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "CLUSTER_ROWS", 60)
    monkeypatch.setattr(flat_graph, "PART_ROWS", 100)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    good = [(i, (centres[i % 60] + rng.normal(size=16) * 0.05 * (i % 60 < 20)).tolist()) for i in range(600)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [None] * 16), (1003, [float("nan")] * 16), (None, [1.0] * 16), (1004, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("vec", F.lit(1))
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    out = {r.vec_id: r for r in flat_graph.near_vectors(df).collect()}
    assert len(out) == len(good) + len(bad)
    for i in range(600):
        assert out[i].n_links == near[i].sum() - 1 and out[i].component_id == int(np.flatnonzero(near[i])[0])
    assert all(out[i].n_links == 0 and out[i].kept for i in (1000, 1001, 1002, 1003, 1004, None))
    assert out[0].audited_recall == 1.0


def test_dense_groups_are_walked_without_pair_sets():
    rng = np.random.default_rng(4)
    x = flat_graph.unit(np.concatenate([rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.2, rng.normal(size=(300, 32))]))
    lists = flat_graph.build_graph(x)
    graph = np.full((len(x), max(map(len, lists))), -1)
    for i, to in enumerate(lists):
        graph[i, :len(to)] = to
    links = flat_graph.Links(len(x))
    for q, r in flat_graph.search(x, graph, x, 0.9):
        ok = (q != r) & flat_graph._in_range(x, q, x, r, 0.9)
        links.add(q[ok], r[ok])
    links.both_ways()
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    weight = rng.integers(1, 9, len(x))
    found, met = links.sums(weight)
    assert (met == near.sum(axis=1)).all() and (found == near @ weight).all() and met.sum() > 400_000
    u, v = links.forest()
    assert near[u, v].all() and len(set(v)) == len(v) == (met > 0).sum() - 1
    assert flat_graph.Links(0).forest() == ([], [])


def test_near_vectors_credit_both_ends_at_cluster_borders(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "CLUSTER_ROWS", 20)
    monkeypatch.setattr(flat_graph, "OVERLAP", 2)
    monkeypatch.setattr(flat_graph, "RECALL", 0.0)
    real = flat_graph._recall
    monkeypatch.setattr(flat_graph, "_recall", lambda *a: max(real(*a), 0.9))  # links may be lost here, but not one-sided
    rng = np.random.default_rng(8)
    one = rng.normal(size=(400, 8))
    x = np.concatenate([one, one + rng.normal(size=(400, 8)) * 0.25])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for part_rows in (10_000, 30):  # the second splits clusters
        monkeypatch.setattr(flat_graph, "PART_ROWS", part_rows)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        out = flat_graph.near_vectors(df).collect()
        size = Counter(r.component_id for r in out)
        near = (x @ x.T >= 0.9).sum(axis=1) - 1
        assert all((r.n_links > 0) == (size[r.component_id] > 1) and r.n_links <= near[r.vec_id] for r in out)
        assert sum(r.n_links for r in out) % 2 == 0 and sum(n > 1 for n in size.values()) > 50


def test_recall_audit_sees_small_groups_and_raises(spark, monkeypatch):
    rng = np.random.default_rng(12)
    hot = rng.normal(size=16) + rng.normal(size=(60, 16)) * 0.01
    one = rng.normal(size=(10, 16)) * 3
    x = np.concatenate([hot, one, one + 0.01])
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep long, n long, vec array<double>")
    links = spark.createDataFrame([(i, 59, 59, None, None) for i in range(60)], "rep long, found long, met long, u long, v long")
    assert abs(flat_graph._recall(classes, links, 0.9) - 60 / 80) < 1e-9  # pooled: 3,540 of 3,560 links
    monkeypatch.setattr(flat_graph, "_links", lambda *a: links.limit(0))
    with pytest.raises(RuntimeError, match="recall"):
        flat_graph.near_vectors(classes.toDF("vec_id", "n", "embedding"))


# -- 9 and 10

def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 65, 500).tolist()
    bins = bfd_output.best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sum(lengths[i] for i in b) for b in bins) <= 64
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
        room.append((min(fit) if fit else 64) - n)
    assert len(room) == len(bins)


def test_packed_output_is_lossless(docs, source):
    want = ids_of(docs, source)
    got = defaultdict(list)
    for r in bfd_output.pack(docs, source, 1, window=64).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and not ids[r.n_tokens:].any() and r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.docs, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got[doc].append((start, ids[a:b].tolist()))
    for doc, texts in want.items():
        assert sum(len(x) for _, x in got[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            assert [i for _, x in sorted(got[doc]) for i in x] == texts[0]


def ids_of(docs, source):
    out = defaultdict(list)
    for r in bpe.encode(docs, source).collect():
        out[r.doc_id].append([*r.token_ids, 1])
    return out


def test_nnls_packing_places_each_id_once(docs, source, monkeypatch):
    monkeypatch.setattr(nnls_pack, "RANKED", 3)
    want = ids_of(docs, source)
    rows = nnls_pack.pack(docs, source, 1, window=64).collect()
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 64
    for doc, texts in want.items():
        pieces = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc])
        assert pieces == Counter((s, len(t[s:s + 64]), zlib.crc32(np.array(t[s:s + 64], "<u4").tobytes()), len(t)) for t in texts for s in range(0, len(t), 64))


def test_nnls_plan_uses_each_piece_and_pads_little():
    rng = np.random.default_rng(5)
    steps, n = np.unique(rng.integers(1, 257, 50_000), return_counts=True)
    histogram = dict(zip(steps.tolist(), n.tolist()))
    plan, used = nnls_pack.plan_of(histogram), Counter()
    for parts, times in plan:
        assert sum(parts) <= 256 and times > 0
        for p in parts:
            used[p] += times
    assert used == histogram
    assert sum(t * (256 - sum(p)) for p, t in plan) < 0.01 * 256 * sum(t for _, t in plan)
    a, b = np.array([[2.0, 0, 1], [0, 1, 1]]), np.array([4.0, 1.0])
    assert np.allclose(a @ nnls_pack.nnls(a, b), b) and nnls_pack.plan_of({}) == []


def test_packing_empty_tables(empty, source):
    assert nnls_pack.pack(empty, source, 1).count() == 0 and bfd_output.pack(empty, source, 1).count() == 0


def test_encoder_keeps_a_large_vocabulary_from_batch_to_batch():
    encoder, sent = bpe.WordBpe(queries.tokenizer_source()), []
    encode_words = encoder.encode_words

    def watched(words):
        words = list(words)
        sent.append(len(words))
        return encode_words(words)

    encoder.encode_words = watched
    letters = "abcdefghij"
    text = " ".join("".join(letters[int(d)] for d in str(n)) for n in range(250_000))
    split, of = encoder.encode_batch([text])
    before = [of(w) for w in split[0]]
    split, of = encoder.encode_batch([text, None, "zz. zz"])
    assert [of(w) for w in split[0]] == before and split[1] == []
    assert sent == [250_000, 2]


def test_packed_texts_are_cut_by_arrow_as_the_library_does(source):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_str(source), bpe.WordBpe(source, lambda ids: np.array(ids, "<u4").tobytes(), b"".join)
    signs = [*"aAzé ß.,'_-#19½ª²", "'S", "'ll", "Ⱥ", "İ", "İ,", "\u00a0", "\u0085", "\x1c", "\x1f", "\x00", "\t", "\n", "\r\n", "\x0b", " ", "  ", "×", "µ", "<", "Σ", "日", "e\u0301", "<|endoftext|>"]
    rng = np.random.default_rng(8)
    texts = ["".join(signs[i] for i in rng.integers(0, len(signs) - far, rng.integers(0, 30))) for far in (0, 4) for _ in range(400)]
    texts += [None, "", " ", " tree, tree;Tree! (tree) tree's\n", "<|ENDOFTEXT|> a<|endoftext|>b", "x" * 300 + "."]
    for _ in range(2):  # the second time all are known, or were passing
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_texts(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.encode_texts([]) == [] and encoder.encode_texts([None, " "]) == [b"", b""]


def test_packed_texts_look_up_a_batchs_distinct_words_only(source):
    class Kept(dict):
        looked = 0

        def __contains__(self, word):
            self.looked += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            self.looked += 1
            return super().__getitem__(word)

    encoder = bpe.WordBpe(source, lambda ids: np.array(ids, "<u4").tobytes(), b"".join)
    encoder.kept = Kept()
    few, many = encoder.encode_texts(["elm, oak; elm. Oak elm! ", "Elm, oak; elm. Oak elm! " * 5000])
    assert many == few * 5000 and encoder.kept.looked < 100
    assert set(encoder.kept) == {"elm", "oak", ",", ";", ".", "!"}


def test_a_written_tables_shuffles_leave_no_files(spark):
    env = spark._jsc.sc().env()
    folders = [str(d) for d in env.blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    rows = spark.range(1000).repartition(3)
    before = files()
    rows.write.format("noop").mode("overwrite").save()
    counted = files()
    assert counted - before  # other queries leave them until the driver collects garbage
    written = materialise(rows, "no-files")
    assert not files() - counted
    assert written.count() == 1000 and spark.conf.get(_CLEAN_UP, None) is None
