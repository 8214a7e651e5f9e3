"""URL rules by a cascade of Bloom filters: exact membership of a list in a known universe of keys, without joins.

A url's candidate keys are the pairs of a host suffix (whole labels) and a
path prefix that have the shape (labels, path characters) of some rule. The
key universe is every candidate of the whole corpus together with the
list. Level 0 of a cascade is a Bloom filter of the listed keys; level 1
holds those unlisted keys of the universe that level 0 lets through; level 2
the listed keys that level 1 lets through; and so on until no key is
misjudged. The first level that lacks a key then decides about it, rightly
for every key of the universe. A second cascade tells blocked from allowed
keys within the list. Filters are built by Spark (bits united by a grouped
``bit_or``) and sent to the tasks, which read the urls alone.

The first filter's rate is listed / (sqrt 2 * unlisted), so that the later
ones hold about as many keys as the list: a cascade takes some
1.5 * log2(unlisted / listed) + 6 bits per rule, whatever the corpus' size.
A list whose filters would pass ``max_bytes`` is dealt over shards by key
hash, each with its own cascade, and the urls go through them one after the
other.

Defined cases: a null url, or one without ``://``, has an empty host and
path, and no rule fits it but one for the empty host without path. A rule
with a null field or a path that is neither empty nor starts with ``/``
fits nothing. Of rules with one key, block wins. Of fitting rules of one
length, that with the longer host wins. Rows are kept as they come,
repeated ones too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialise, mix

#: Bytes of filters that are sent to the tasks at a time, at most.
MAX_BYTES = 32 << 20
MAX_LEVELS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ filters

def size_of(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions of a Bloom filter of n keys."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // 64) * 64
    return bits, max(1, round(bits / max(n, 1) * math.log(2))) if n * 40 > bits else 8


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """The bits of each key in a level's filter, a row per key."""
    salt = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64)
    a, b = mix(h1.view(np.uint64) ^ salt), mix(h2.view(np.uint64) + salt) | np.uint64(1)
    return ((a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """The levels ``(bits, hashes, words)`` of one cascade."""

    def __init__(self, levels: Sequence[tuple[int, int, np.ndarray]] = ()):
        self.levels = list(levels)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, hashes, words = self.levels[level]
        at = places(h1, h2, level, bits, hashes)
        return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed: the first level without the key decides."""
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        todo = np.arange(len(h1))
        for level in range(len(self.levels)):
            there = self.passes(level, h1[todo], h2[todo])
            out[todo[~there]] = level % 2 == 1
            todo = todo[there]
        return out

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for _, _, w in self.levels)


def _filter_of(keys: DataFrame, n: int, level: int, rate: float) -> tuple[int, int, np.ndarray]:
    """The Bloom filter of ``keys`` (h1, h2): a task unites the bits of its keys, Spark those of the tasks."""
    bits, hashes = size_of(n, rate)

    def set_bits(batches):
        words = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            at = places(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), level, bits, hashes).ravel()
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some].view(np.int64))], ["word", "bits"])

    found = keys.select("h1", "h2").mapInArrow(set_bits, "word long, bits long") \
        .groupBy("word").agg(F.expr("bit_or(bits) as bits")).toPandas()  # at most a row for each 8 bytes of the filter
    words = np.zeros(bits >> 6, np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits, hashes, words


def build(keys: DataFrame) -> Cascade:
    """The cascade of a table ``(h1, h2, listed)``: every key of the universe once, with whether it is listed.

    Each level is one pass over the keys that the last level misjudges; these are halved by every level.
    """
    counts = {r.listed: r.n for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n, others = counts.get(True, 0), counts.get(False, 0)
    cascade, own, rest = Cascade(), keys.where("listed"), keys.where("not listed")
    if not n:
        return cascade
    rate = min(0.5, n / (math.sqrt(2) * others)) if others else 0.5
    spark = keys.sparkSession
    for level in range(MAX_LEVELS):
        cascade.levels.append(_filter_of(own, n, level, rate))
        sent = spark.sparkContext.broadcast(cascade.levels[-1])

        def through(batches, level=level, sent=sent):
            alone = Cascade([(64, 1, None)] * level + [sent.value])
            for batch in batches:
                yield batch.filter(pa.array(alone.passes(level, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())))

        wrong = materialise(rest.select("h1", "h2").mapInArrow(through, "h1 long, h2 long"), "cascade")
        n, rate = wrong.count(), 0.5
        if not n:
            return cascade
        own, rest = wrong, own
    raise RuntimeError("two keys of the universe have the same 128 bits of hash")


# --------------------------------------------------------------------- urls

def parts(pages: DataFrame, url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` with ``host`` (after the first ``://``, A-Z lower-cased) and ``path`` of each url."""
    rest = f"if(instr(`{url_col}`, '://') > 0, substring(`{url_col}`, instr(`{url_col}`, '://') + 3), '')"
    out = pages.selectExpr(*[f"`{c}`" for c in keep], f"coalesce({rest}, '') as _rest") \
        .withColumn("_host", F.expr("regexp_extract(_rest, '^[^/?#]*', 0)"))
    return out.selectExpr(*[f"`{c}`" for c in keep], f"translate(_host, '{_UPPER}', '{_LOWER}') as host",
                          "regexp_extract(substring(_rest, length(_host) + 1), '^[^?#]*', 0) as path")


def rule_table(rules: DataFrame) -> DataFrame:
    """``(host, path, verdict)`` -> ``(labels, chars, key, block)``, a row per key."""
    fine = rules.where("host is not null and path is not null and verdict is not null and (path = '' or startswith(path, '/'))") \
        .selectExpr(f"translate(host, '{_UPPER}', '{_LOWER}') as host", "path", "verdict = 'block' as block")
    return fine.selectExpr("size(split(host, '[.]', -1)) as labels", "length(path) as chars", "concat(host, path) as key", "block") \
        .groupBy("labels", "chars", "key").agg(F.max("block").alias("block"))


def _candidates(shapes: Sequence[tuple[int, int]]) -> str:
    """SQL of a url's candidate keys, longest first: ``(length, longer host, key, h1, h2)`` each."""
    if not shapes:
        return "cast(array() as array<struct<size:int,labels:int,key:string,h1:bigint,h2:bigint>>)"
    literal = ", ".join(f"struct({n} as n, {p} as p)" for n, p in shapes)
    fitting = f"filter(array({literal}), s -> s.p <= length(path) and s.n <= size(split(host, '[.]', -1)))"
    keys = f"transform({fitting}, s -> struct(s.n as n, concat(substring_index(host, '.', -s.n), left(path, s.p)) as key))"
    made = f"transform({keys}, c -> struct(-length(c.key) as size, -c.n as labels, c.key as key, xxhash64(c.key) as h1, xxhash64(1, c.key) as h2))"
    return f"array_sort({made})"


def _lookup(sent, shard: int, shards: int):
    """An Arrow function: lists of key hashes -> 2 * (place of the first listed key) + blocked, or 0."""
    def run(batch: pa.Array) -> pa.Array:
        listed, block = sent.value
        lists = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
        sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
        flat = lists.flatten()
        h1, h2 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2"))
        hit = np.zeros(len(h1), bool)
        own = np.flatnonzero(h1.view(np.uint64) % np.uint64(shards) == shard)
        hit[own] = listed.member(h1[own], h2[own])
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(hit)
        which, first = np.unique(row[at], return_index=True)
        at = at[first]
        out = np.zeros(len(sizes), np.int32)
        start = np.cumsum(sizes) - sizes
        out[which] = 2 * (at - start[which] + 1) + block.member(h1[at], h2[at])
        return pa.array(out)

    return run


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: Sequence[str] = ("page_id",),
          default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(*keep, host, path, rule, verdict)`` of every row of ``pages``.

    ``rules``: ``(host, path, verdict)`` with verdict ``allow`` or ``block``. A rule fits its host and all
    subdomains where the url's path starts with the rule's; the longest one decides, ``default`` where none fits.
    """
    spark = pages.sparkSession
    rules = materialise(rule_table(rules), "url-rules")
    shapes = sorted(tuple(r) for r in rules.select("labels", "chars").distinct().collect())
    urls = parts(pages, url_col, keep).withColumn("_keys", F.expr(_candidates(shapes)))
    # the universe, each key once: 0 corpus, 1 allow, 2 block
    corpus = urls.select(F.explode("_keys").alias("k")).selectExpr("k.key as key", "0 as tag").distinct()
    tagged = corpus.union(rules.selectExpr("key", "if(block, 2, 1) as tag")).groupBy("key").agg(F.max("tag").alias("tag"))
    universe = materialise(tagged.selectExpr("xxhash64(key) as h1", "xxhash64(1, key) as h2", "tag"), "url-universe")
    n, total = rules.count(), universe.count()
    need = n * (1.5 * math.log2(max(2.0, total / max(n, 1))) + 8) / 8
    shards = max(1, math.ceil(need / max_bytes))
    for shard in range(shards):
        own = universe if shards == 1 else universe.where(
            f"cast(pmod(cast(h1 as decimal(20)) + if(h1 < 0, 18446744073709551616, 0), {shards}) as int) = {shard}")
        listed = build(own.selectExpr("h1", "h2", "tag > 0 as listed"))
        block = build(own.where("tag > 0").selectExpr("h1", "h2", "tag = 2 as listed"))
        sent = spark.sparkContext.broadcast((listed, block))

        code = F.arrow_udf(_lookup(sent, shard, shards), "int")(F.expr("transform(_keys, k -> struct(k.h1 as h1, k.h2 as h2))"))
        urls = urls.withColumn("_code", code if shard == 0 else _nearer(F.col("_code"), code))
        if shard + 1 < shards:  # one shard's filters at a time in a worker
            urls = materialise(urls, "url-pass")
    rule = "if(_code = 0, null, element_at(_keys, cast(_code div 2 as int)).key)"
    verdict = f"case when _code = 0 then '{default}' when _code % 2 = 1 then 'block' else 'allow' end"
    return urls.selectExpr(*[f"`{c}`" for c in keep], "host", "path", f"{rule} as rule", f"{verdict} as verdict")


def _nearer(a, b):
    """Of two codes the one of the longer key (the smaller place); 0 is none."""
    return F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b))
