"""Near-duplicates in a region where everything resembles everything, against all intersections."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import lsh_forest
from llm.ship import ship
from llm_samples import words_of


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def region(n, planted, changes, seed=3):
    """Texts with ``changes`` words of one template changed, and for some a partner with three more changes."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(n):
        ws = list(template)
        for at in rng.sample(range(2, 118), changes):
            ws[at] = f"u{i}x{at}"
        texts.append(ws)
    for i in range(planted):
        ws = list(texts[i])
        for at in (10 + i % 20, 50 + i % 20, 90 + i % 20):
            ws[at] = f"p{i}x{at}"
        texts.append(ws)
    rng.shuffle(texts)
    return [" ".join(ws) for ws in texts]


def groups_of(texts, percent, width):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)})
    seen = Counter(x for s in sets for x in s)
    place = {x: i for i, x in enumerate(x for x, c in seen.items() if c > 1)}
    m = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s if x in place]] = 1
    size, group, links = np.array([len(s) for s in sets]), list(range(len(sets))), 0

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        both = m[i] @ m.T
        both[i] = size[i]
        near = np.flatnonzero(100 * both >= percent * (size[i] + size - both))
        links += len(near) - 1
        for j in near:
            a, b = root(i), root(int(j))
            group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))], links // 2


@pytest.mark.parametrize("n, planted, changes", [(2500, 120, 4), (1200, 60, 2)])
def test_no_link_is_lost_in_a_dense_region(spark, n, planted, changes):
    texts = region(n, planted, changes)
    want, links = groups_of(texts, 85, 3)
    assert links >= planted
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = dict(lsh_forest.near_duplicates(df, 0.85, 3).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want


def test_dense_pairs_alone_find_every_pair_of_different_groups(spark):
    texts = region(300, 30, 4, seed=5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = df.select(F.col("doc_id").alias("rep"))
    sets = lsh_forest._sets_of(df, reps, 3, "doc_id", "text")
    groups = spark.createDataFrame([], "node long, component long")
    pairs = lsh_forest.confirm(lsh_forest.dense_pairs(reps, groups, sets, 0.85), sets, 0.85)
    assert pairs.count() == pairs.distinct().count() == groups_of(texts, 85, 3)[1] == 30
