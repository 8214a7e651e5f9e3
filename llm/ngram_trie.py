"""Language-model scores from an Elias-Fano trigram trie with quantised smoothed probabilities.

Texts become word hashes in chunks of about ``CHUNK`` tokens (a text's end
is a token too). The chunks' words are counted in shards of the word, and
each chunk gets its words' counts back. Then each chunk counts its training
trigrams and sends its distinct n-grams, packed, to shards of the middle
word; a shard adds up the chunks' counts, builds its part of the trie in a
memory-mapped file, and answers every chunk from it. The chunks then add up
their documents' scores. The shards' tries can be stored, and later texts
scored from them (``score_with``).

Trie of a shard, as Elias-Fano sequences: the shard's words; contexts v;
their successors w, each after its context's offset (so the level is one
monotone sequence, and a word is its place among the shard's words); monotone
pointers to where each context's successors begin; the longer contexts
(v, u); and below them the trigrams, where w is not a word but its rank
among the successors of the shorter context v. A lookup searches the
successor within the context, takes its rank from the context's pointer, then
searches that rank within the longer context. Pairs and trigrams hold their smoothed
probabilities, quantised in steps of a twentieth in log10 (8 bits).

Smoothing interpolates with Dirichlet priors: p(w|uv) = c(uvw) / (c(uv) + m3)
+ m3 / (c(uv) + m3) * p(w|v), likewise p(w|v) with m2 and the add-one unigram,
so probabilities of all words and the end sum to one but for quantisation.

Words with a shard's worth of training tokens or more (by the counts over all
chunks; the start mark too) are split over shards of their own by successor. A part's
trigrams are relative to its own share of a longer context (u, v); the
chunks rescale them to the total, which is the count of the pair u, v. What
reaches the driver is that list (at most n / ``SHARD`` words of n tokens, as many as there
are shards), token totals and vocabulary size. A chunk sends one row to each shard that it has
n-grams for, so never more rows than n-grams.

Words are told apart by 64-bit hashes when they are counted; from then on by ids, their shard
and rank among its known words, so no two successors of a context are taken for one.
Null and empty texts are a lone end. Rows repeat as they come. Without
training rows every probability is the unigram's 1 / (0 + 1 * (0 + 1)).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import discard, fresh, materialise, mix, release, text_buffers, word_hashes
from llm.elias_fano import EliasFano

CHUNK = 1_000_000
#: Tokens whose n-grams a shard gathers, about.
SHARD = 800_000
M2, M3 = 200.0, 20.0
END, START = (int(x) for x in mix(np.array([101, 102], np.uint64)))
#: The start mark's id; words' ids are larger.
START_ID = 1
_STEPS = 20
_NONE = 255


# -- packed arrays

def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, each in the smallest type that holds it."""
    head, body = [], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(k for k, most in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if top < most)
        head.append(f"{kind}:{len(a)}")
        a = a.astype(kind)
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())  # byte by byte: equal high bytes compress
    head = " ".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(body))


def load(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for field in data[4:at].decode().split():
        kind, n = field.split(":")
        size = int(n) * np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, size, at).reshape(-1, int(n)) if size else None
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if size else np.zeros(0, kind))
        at += size
    return out


def steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """32-bit differences within runs of the given sizes; the first of a run stands as it is."""
    out = values.astype(np.uint32)
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[1:] -= values[:-1].astype(np.uint32)
    out[firsts] = values[firsts]
    return out


def from_steps(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sizes = sizes[sizes > 0].astype(np.int64)
    total = np.cumsum(d.astype(np.uint32), dtype=np.uint32)
    firsts = np.cumsum(sizes) - sizes
    return total - np.repeat(total[firsts] - d[firsts].astype(np.uint32), sizes)


def dump_words(words: np.ndarray) -> bytes:
    """Ascending 64-bit hashes."""
    return dump(np.diff(words, prepend=np.uint64(0)))


def load_words(data: bytes) -> np.ndarray:
    return np.cumsum(load(data)[0].astype(np.uint64), dtype=np.uint64)


# -- chunks

_CHUNK_SCHEMA = "chunk long, ids array<long>, trained array<boolean>, sizes array<int>, words binary, tokens binary, n_train long, n_docs long"


def chunks(docs: DataFrame, id_col: str, text_col: str, train_col: str) -> DataFrame:
    """One row per chunk: documents, distinct word hashes (ascending) and the tokens as places among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, trained, parts, sizes, total = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            words = np.concatenate(parts)
            size, train = np.concatenate(sizes), np.array(trained, bool)
            distinct, place = np.unique(words, return_inverse=True)
            return pa.RecordBatch.from_pylist([{
                "chunk": number, "ids": ids, "trained": trained, "sizes": size.tolist(), "words": dump_words(distinct), "tokens": dump(place),
                "n_train": int(size[train].sum()), "n_docs": int(train.sum())}], schema=schema)

        schema = pa.schema([
            ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("trained", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
            ("words", pa.binary()), ("tokens", pa.binary()), ("n_train", pa.int64()), ("n_docs", pa.int64())])
        for batch in batches:
            buf, offsets = text_buffers(batch.column(1))
            low = 0
            while low < batch.num_rows:  # a few megabytes of text at a time
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (4 << 20), "right")) - 1)
                high = min(high, batch.num_rows)
                words, first = word_hashes(buf[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                parts.append(np.insert(words, first[1:], np.uint64(END)))
                sizes.append(np.diff(first) + 1)
                ids += batch.column(0)[low:high].to_pylist()
                trained += [bool(x) for x in batch.column(2)[low:high].to_pylist()]
                total += len(parts[-1])
                low = high
                if total >= CHUNK:
                    yield flush()
                    number, ids, trained, parts, sizes, total = number + 1, [], [], [], [], 0
        if ids:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(train_col).alias("train"))
    return materialise(picked.mapInArrow(run, _CHUNK_SCHEMA), "lm-chunks")


@dataclass
class Setting:
    """What all tasks know of a model: totals, and the frequent words (ascending ids), each with its first shard and number of shards."""

    n_train: int
    n_docs: int
    vocabulary: int
    shards: int
    hot: np.ndarray
    hot_first: np.ndarray
    hot_parts: np.ndarray

    @classmethod
    def of(cls, n_train: int, n_docs: int, vocabulary: int, shards: int, often: dict[int, int]) -> Setting:
        """``often``: words with a shard's worth of training tokens or more; so at most n_train / SHARD of them."""
        hot = np.array(sorted(often), np.int64)
        parts = np.array([1 + often[int(w)] // SHARD for w in hot], np.int64)
        return cls(n_train, n_docs, vocabulary, shards, hot, shards + np.cumsum(parts) - parts, parts)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Each word's place among the frequent ones, or -1."""
        if not len(self.hot):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
        return np.where(self.hot[at] == ids, at, -1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.n_train + self.vocabulary + 1)


class Ngrams:
    """The distinct n-grams of a chunk, ascending: (v, w), (v, u) and, by places among those, the trigrams."""

    def __init__(self, row: pd.Series, setting: Setting):
        words = load_words(row["words"])
        tokens = load(row["tokens"])[0].astype(np.int32)
        size = np.asarray(row["sizes"], np.int64)
        self.setting, self.ends = setting, np.cumsum(size)
        self.words = np.append(words, np.uint64(START))  # the start mark comes last, whatever its hash
        known, rank = (np.concatenate(x).astype(np.int64) for x in zip(*(load(p) for p in row["counts"])))
        self.known = np.append(known, setting.n_docs)
        self.ids = np.append(word_ids(_shard(words, setting.shards), rank), START_ID)
        start = len(words)
        v = np.empty_like(tokens)
        v[1:] = tokens[:-1]
        firsts = self.ends - size
        v[firsts] = start
        self.n = n = start + 1
        self.vw, vw = _distinct(v * np.int64(n) + tokens)
        key = v * np.int64(n)
        key[1:] += v[:-1]
        key[firsts] = v[firsts] * np.int64(n) + start
        del v
        vu_keys, vu = _distinct(key)
        del key
        tri, self.place = _distinct(vu * np.int64(len(self.vw)) + vw)
        del vu, vw
        train = np.repeat(np.asarray(row["trained"], bool), size)
        self.count = np.bincount(self.place[train], minlength=len(tri))
        self.v_of_vw, self.w = _halves(self.vw, n)
        self.v_of_vu, self.u = _halves(vu_keys, n)
        self.tri_vu, self.tri_vw = _halves(tri, max(1, len(self.vw)))
        self.tokens = tokens
        self.often = setting.place(self.ids)

    def blocks(self) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """(shard, places in v, vw, vu, tri) of each block; a frequent word's n-grams go to its own shards by successor."""
        setting = self.setting
        v_with = np.unique(self.v_of_vw)
        for i in v_with[self.often[v_with] >= 0]:
            at = self.often[i]
            low, high = np.searchsorted(self.v_of_vw, [i, i + 1])
            part = (mix(self.ids[self.w[low:high]].astype(np.uint64)) % np.uint64(setting.hot_parts[at])).astype(np.int64)
            first, last = np.searchsorted(self.tri_vu, np.searchsorted(self.v_of_vu, [i, i + 1]))
            tri_part = part[self.tri_vw[first:last] - low]
            vw, tri = np.argsort(part, kind="stable"), np.argsort(tri_part, kind="stable")
            ks = np.unique(part)
            vw_ends, tri_ends = np.searchsorted(part[vw], ks, "right"), np.searchsorted(tri_part[tri], ks, "right")
            for k, a, b, c, d in zip(ks, [0, *vw_ends[:-1]], vw_ends, [0, *tri_ends[:-1]], tri_ends):
                mine = first + tri[c:d]
                yield int(setting.hot_first[at] + k), (np.array([i]), low + vw[a:b], np.unique(self.tri_vu[mine]), mine)
        vs = v_with[self.often[v_with] < 0]
        shard = _shard(self.words[vs], setting.shards)
        order = np.argsort(shard, kind="stable")  # the start mark's hash is out of order
        vs, shard = vs[order], shard[order]
        for group in np.split(np.arange(len(vs)), np.flatnonzero(np.diff(shard)) + 1):
            if len(group):
                mine = np.sort(vs[group])
                yield int(shard[group[0]]), (mine, *self._below(mine))

    def _below(self, vs: np.ndarray) -> tuple[np.ndarray, ...]:
        vw = _ranges(np.searchsorted(self.v_of_vw, vs), np.searchsorted(self.v_of_vw, vs, "right"))
        vu_first, vu_last = np.searchsorted(self.v_of_vu, vs), np.searchsorted(self.v_of_vu, vs, "right")
        vu = _ranges(vu_first, vu_last)
        return vw, vu, _ranges(np.searchsorted(self.tri_vu, vu_first), np.searchsorted(self.tri_vu, vu_last))

    def payload(self, block: tuple[np.ndarray, ...]) -> bytes:
        """The block's distinct words with their counts; contexts, successors and longer contexts by places among these words,
        and the trigrams by their places among the block's successors and contexts."""
        v, vw, vu, tri = block
        place = np.concatenate([v, self.w[vw], self.u[vu]])
        ids, first, at = np.unique(self.ids[place], return_index=True, return_inverse=True)
        at_v, at_w, at_u = np.split(at, [len(v), len(v) + len(vw)])
        n_vw, n_vu = (np.diff(np.append(np.searchsorted(of, v), len(of))) for of in (self.v_of_vw[vw], self.v_of_vu[vu]))
        return dump(
            np.diff(ids, prepend=0), self.known[place[first]], at_v, n_vw, n_vu, steps(at_w, n_vw), steps(at_u, n_vu),
            np.diff(np.append(np.searchsorted(self.tri_vu[tri], vu), len(tri))),
            np.searchsorted(vw, self.tri_vw[tri]) - np.searchsorted(self.v_of_vw[vw], self.v_of_vu[self.tri_vu[tri]]),
            self.count[tri])


def word_ids(shard: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ids of words by their shard and their rank among its known words (from 1); words that the model doesn't know share id 0."""
    return np.where(rank > 0, (shard << 32) + rank + START_ID, 0)


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.int64) * shards >> 32


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and each key's 32-bit place among them."""
    order = np.argsort(keys)
    new = np.empty(len(keys), bool)
    new[:1] = True
    ascending = keys[order]
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ascending[new], place


def _halves(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    high = keys // n
    return high.astype(np.int32), (keys - high * n).astype(np.int32)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0]-1, first[1]..last[1]-1, ..."""
    n = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else first, n) + np.arange(n.sum())


# -- the trie of a shard

def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-_STEPS * np.log10(p)), 0, _NONE - 1).astype(np.uint8)


def restored(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code.astype(float) / -_STEPS)


class Trie:
    """Levels in one memory-mapped file: words, contexts v, (v, w), (v, u), trigrams, and where each context's successors begin;
    quantised smoothed probabilities of pairs and trigrams, pairs' counts and longer contexts' totals."""

    def __init__(self, arrays: list[np.ndarray]):
        file = tempfile.TemporaryFile()  # has no name, and goes with its last mapping
        places = []
        for a in arrays:
            file.seek(-(-file.tell() // 8) * 8)
            places.append((file.tell(), a.dtype, len(a)))
            file.write(a.tobytes())
        file.write(bytes(8))
        file.flush()
        data = np.memmap(file, np.uint8, "r")
        file.close()
        self.arrays = a = [np.frombuffer(data, kind, n, at) for at, kind, n in places]
        self.words, self.v, self.vw, self.vu, self.tri, self.first = (EliasFano.of(a[k:k + 4]) for k in range(0, 24, 4))
        self.p2, self.p3, self.c_vw, self.c_vu, span = a[24:]
        self.n_words, self.n_ranks = (int(x) for x in span)

    @classmethod
    def build(cls, words: np.ndarray, known: np.ndarray, v: np.ndarray, vw: np.ndarray, vu: np.ndarray,
              tri_vu: np.ndarray, tri_vw: np.ndarray, count: np.ndarray, setting: Setting) -> Trie:
        """words: ids, ascending, known: their training counts; v: contexts, as places in words; vw, vu: place in v * len(words)
        + place in words; the trigrams by places in vu and vw. Zero counts are left out."""
        n, seen = max(1, len(words)), count > 0
        tri_vu, tri_vw, count = tri_vu[seen], tri_vw[seen], count[seen]
        c_vw, c_vu = np.bincount(tri_vw, count, len(vw)), np.bincount(tri_vu, count, len(vu))
        keep_vw, keep_vu = c_vw > 0, c_vu > 0
        new_vw, new_vu = np.cumsum(keep_vw) - 1, np.cumsum(keep_vu) - 1
        tri_vw, tri_vu, vw, vu, c_vw, c_vu = new_vw[tri_vw], new_vu[tri_vu], vw[keep_vw], vu[keep_vu], c_vw[keep_vw], c_vu[keep_vu]
        of_vw = vw // n
        first = np.searchsorted(of_vw, np.arange(len(v) + 1))
        rank = tri_vw - first[of_vw[tri_vw]]  # w as its rank among the successors of v
        ranks = int(rank.max(initial=0)) + 1
        # every occurrence of a word but the end is that of a context, so its count is the context's total
        p2 = (c_vw + M2 * setting.unigram(known[vw - of_vw * n])) / (known[v[of_vw]] + M2)
        p3 = (count + M3 * p2[tri_vw]) / (c_vu[tri_vu] + M3)
        order = np.argsort(tri_vu * ranks + rank)
        levels = (words, v, vw, vu, (tri_vu * ranks + rank)[order], first)
        small = lambda a: a.astype(np.uint32 if a.max(initial=0) < 1 << 32 else np.uint64)
        return cls([*(p for level in levels for p in EliasFano.build(level).parts()),
                    quantise(p2), quantise(p3)[order], small(c_vw), small(c_vu), np.array([n, ranks])])

    def dump(self) -> bytes:
        return dump(*self.arrays)

    @classmethod
    def load(cls, data: bytes) -> Trie:
        return cls(load(data))

    def answer(self, words: np.ndarray, v: np.ndarray, v_of_vw: np.ndarray, w: np.ndarray, v_of_vu: np.ndarray, u: np.ndarray,
               tri_vu: np.ndarray, tri_vw: np.ndarray) -> tuple[np.ndarray, ...]:
        """Totals of the contexts (v, u), codes and counts of the pairs, codes of the trigrams; 0 and 255 where unseen.

        v, w and u are places in ``words`` (ids, ascending), v_of_vw and v_of_vu places in v, the trigrams places of
        their contexts and pairs."""
        own = self.words.find(words)
        context = _below(self.v, np.zeros(len(v), np.int64), own[v], 0)
        begin = self.first.at(np.maximum(context, 0))
        at_w = _below(self.vw, context[v_of_vw], own[w], self.n_words)
        at_u = _below(self.vu, context[v_of_vu], own[u], self.n_words)
        rank = np.where(at_w >= 0, at_w - begin[v_of_vw], -1)[tri_vw]
        at_t = _below(self.tri, at_u[tri_vu], rank, self.n_ranks)
        return _at(self.c_vu, at_u, 0), _at(self.p2, at_w, _NONE), _at(self.c_vw, at_w, 0), _at(self.p3, at_t, _NONE)


def _below(level: EliasFano, context: np.ndarray, key: np.ndarray, span: int) -> np.ndarray:
    """Index of each key within its context, or -1 (also where either is)."""
    out = np.full(len(context), -1, np.int64)
    inside = np.flatnonzero((context >= 0) & (key >= 0))
    out[inside] = level.find(context[inside] * span + key[inside])
    return out


def _at(values: np.ndarray, place: np.ndarray, missing: int) -> np.ndarray:
    if not len(values):
        return np.full(len(place), missing)
    return np.where(place >= 0, values[np.maximum(place, 0)], missing)


def serve_shard(payloads: list[bytes], setting: Setting, trie: Trie | None = None) -> tuple[list[bytes], Trie]:
    """Add up the blocks' counts and build the shard's trie (unless there is one), then answer each block from it."""
    blocks = [load(p) for p in payloads]
    every = [np.cumsum(b[0].astype(np.int64)) for b in blocks]
    words, word_place = np.unique(np.concatenate(every), return_inverse=True)
    known = np.zeros(len(words), np.int64)
    known[word_place] = np.concatenate([b[1] for b in blocks])
    is_hot = setting.place(words) >= 0
    n = max(1, len(words))
    ends = np.cumsum([0, *map(len, every)])
    v, v_place = np.unique(np.concatenate([word_place[e + b[2].astype(np.int64)] for e, b in zip(ends, blocks)]), return_inverse=True)
    vw_keys, vu_keys, tri_vu, tri_vw, counts = [], [], [], [], []
    at_v = at_vw = at_vu = 0
    sizes = []
    for i, e in enumerate(ends[:-1]):
        b, blocks[i] = blocks[i], None  # what is read of a block goes before the next one
        n_v = len(b[2])
        n_vw, n_vu, n_tri, rel, count = b[3].astype(np.int64), b[4].astype(np.int64), b[7], b[8].astype(np.int32), b[9]
        w, u = (word_place[e + from_steps(d, m).astype(np.int64)] for d, m in ((b[5], n_vw), (b[6], n_vu)))
        mine = v_place[at_v:at_v + n_v]
        each = np.arange(n_v, dtype=np.int32)
        of_vw, of_vu = np.repeat(each, n_vw), np.repeat(each, n_vu)
        first = (np.cumsum(n_vw) - n_vw).astype(np.int32)
        own_vu = np.repeat(np.arange(len(u), dtype=np.int32), n_tri)
        own_vw = first[of_vu[own_vu]] + rel
        sizes.append((len(u), len(w), len(w), len(rel)))
        vw_keys.append(mine[of_vw] * n + w)
        vu_keys.append(mine[of_vu] * n + u)
        tri_vu.append(own_vu + at_vu)
        tri_vw.append(own_vw + at_vw)
        counts.append(count.astype(np.int64))
        at_v, at_vw, at_vu = at_v + n_v, at_vw + len(w), at_vu + len(u)
    del blocks, every, word_place, v_place, w, u, of_vw, of_vu, own_vu, own_vw, rel, count, b
    vw, vw_place = _distinct(np.concatenate(vw_keys))
    vu, vu_place = _distinct(np.concatenate(vu_keys))
    del vw_keys, vu_keys
    tri, tri_place = _distinct(vu_place[np.concatenate(tri_vu)] * np.int64(max(1, len(vw))) + vw_place[np.concatenate(tri_vw)])
    del tri_vu, tri_vw
    tri_vu, tri_vw = (x.astype(np.int64) for x in _halves(tri, max(1, len(vw))))
    if trie is None:
        count = np.bincount(tri_place, np.concatenate(counts), len(tri)).astype(np.int64)
        del tri, counts
        trie = Trie.build(words, known, v, vw, vu, tri_vu, tri_vw, count, setting)
        del count
    # each distinct n-gram that the blocks ask for is looked up once
    found = trie.answer(words, v, vw // n, vw % n, vu // n, vu % n, tri_vu, tri_vw)
    hot_w = is_hot[vw % n]
    places, at, out = (vu_place, vw_place, vw_place, tri_place), [0, 0, 0, 0], []
    for size in sizes:
        own = [p[a:a + m] for p, a, m in zip(places, at, size)]
        # counts of pairs are asked for where the second word is frequent: they are totals of its longer contexts
        out.append(dump(found[0][own[0]], found[1][own[1]], found[2][own[2][hot_w[own[2]]]], found[3][own[3]]))
        at = [a + m for a, m in zip(at, size)]
    return out, trie


# -- scoring

_ANSWER = "chunk long, shard long, payload binary"
_SCORES = "id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: ``chunk`` of a model's own rows among the answers.
_MODEL = -1


def _send_words(parts: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                words, place = load_words(row["words"]), load(row["tokens"])[0]
                own = np.bincount(place[np.repeat(np.asarray(row["trained"], bool), np.asarray(row["sizes"]))], minlength=len(words))
                shard = _shard(words, shards)
                cuts = np.flatnonzero(np.diff(shard)) + 1
                yield pd.DataFrame({"chunk": row["chunk"], "shard": shard[[0, *cuts]], "payload": [
                    dump(np.diff(w, prepend=np.uint64(0)), n) for w, n in zip(np.split(words, cuts), np.split(own, cuts))]})

    return parts.select("chunk", "trained", "sizes", "words", "tokens").mapInPandas(run, _ANSWER)


def _words(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps_, count = load(payload)
    return np.cumsum(steps_.astype(np.uint64), dtype=np.uint64), count.astype(np.int64)


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Training counts and ranks of every chunk's words, and a row for the model: the shard's words and counts, their number, the frequent ones."""
    blocks = [_words(p) for p in pdf["payload"]]
    words, place = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    count = np.bincount(place, np.concatenate([b[1] for b in blocks]), len(words)).astype(np.int64)
    seen = count > 0
    rank = np.where(seen, np.cumsum(seen), 0)
    answers, at = [], 0
    for b in blocks:
        mine = place[at:at + len(b[0])]
        answers.append(dump(count[mine], rank[mine]))
        at += len(b[0])
    hot = np.flatnonzero((count >= SHARD) & (words != END))  # nothing follows an end
    more = len(pdf) * [None]
    return pd.DataFrame({
        "chunk": [*pdf["chunk"], _MODEL], "shard": [*pdf["shard"], pdf["shard"].iloc[0]],
        "payload": [*answers, dump(np.diff(words[seen], prepend=np.uint64(0)), count[seen])],
        "known": pd.array([*more, int(seen.sum())], "Int64"), "hot": [*more, dump(word_ids(np.int64(pdf["shard"].iloc[0]), rank[hot]), count[hot]) if len(hot) else None]})


def _look_up_words(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    words, count = _words(model["payload"].iloc[0]) if len(model) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = []
    for payload in asked["payload"]:
        mine = _words(payload)[0]
        at = np.searchsorted(words, mine)
        known = np.append(words, np.uint64(0))[at] == mine
        known &= at < len(words)
        out.append(dump(np.where(known, np.append(count, 0)[at], 0), np.where(known, at + 1, 0)))
    return pd.DataFrame({"chunk": asked["chunk"], "shard": asked["shard"], "payload": out})


def _with_counts(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunks with the counts and ranks of their words (packed lists, in the words' order); ``parts`` is no longer needed."""
    of = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "payload"))).alias("found"))  # at most one per word of a chunk
    return materialise(parts.join(of, "chunk").withColumn("counts", F.expr("transform(found, x -> x.payload)")).drop("found"), "lm-counted")


def _send_ngrams(counted: DataFrame, sent: Broadcast) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                grams = Ngrams(row, sent.value)
                for s, block in grams.blocks():
                    yield pd.DataFrame({"chunk": [row["chunk"]], "shard": [s], "payload": [grams.payload(block)]})
                del grams
                release()

    return counted.select("chunk", "trained", "sizes", "words", "tokens", "counts").mapInPandas(run, _ANSWER)


def _finish(counted: DataFrame, found: DataFrame, sent: Broadcast, id_col: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        setting = sent.value
        row = pdf[pdf["payload"].isna()].iloc[0]
        grams = Ngrams(row, setting)
        answers = dict(zip(*pdf[pdf["payload"].notna()][["shard", "payload"]].to_numpy().T))
        code2, code3 = np.full(len(grams.vw), _NONE), np.full(len(grams.tri_vw), _NONE)
        pairs, total, part = np.zeros(len(grams.vw)), np.zeros(len(grams.u)), np.zeros(len(grams.tri_vw))
        often_w = grams.often[grams.w] >= 0
        for s, (v, vw, vu, tri) in grams.blocks():
            total[vu], code2[vw], counts, code3[tri] = load(answers[s])
            pairs[vw[often_w[vw]]] = counts
            part[tri] = total[grams.tri_vu[tri]]
        # a frequent word's longer context (u, v) is split over shards: its total is the count of the pair u, v
        split = np.flatnonzero(grams.often[grams.v_of_vu] >= 0)
        begins = grams.v_of_vu[split] == grams.n - 1
        pair = np.searchsorted(grams.vw, grams.u[split].astype(np.int64) * grams.n + grams.v_of_vu[split])
        total[split] = np.where(begins, setting.n_docs, pairs[np.minimum(pair, len(pairs) - 1)])
        p1 = setting.unigram(grams.known)
        p2 = np.where(code2 == _NONE, M2 * p1[grams.w] / (grams.known[grams.v_of_vw] + M2), restored(code2))
        rest = total[grams.tri_vu] + M3
        # what is stored of a split context is relative to its part's total
        p3 = np.where(code3 == _NONE, M3 * p2[grams.tri_vw] / rest, restored(code3) * (part + M3) / rest)
        first = grams.ends - np.asarray(row["sizes"], np.int64)
        sums = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({
            "id": pd.array(row["ids"], "Int64"), "trained": np.asarray(row["trained"], bool), "n_tokens": np.asarray(row["sizes"], np.int64),
            "n_known": sums((grams.known[grams.tokens] > 0).astype(np.int64)), "train_tokens": setting.n_train,
            "base_score": sums(np.log10(p1)[grams.tokens]), "score": sums(np.log10(p3)[grams.place])})

    rows = counted.select("chunk", "ids", "trained", "sizes", "words", "tokens", "counts")
    rows = rows.unionByName(found.where(F.col("chunk") != _MODEL), allowMissingColumns=True)
    return rows.groupBy("chunk").applyInPandas(run, _SCORES).withColumnRenamed("id", id_col)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", keep: str | None = None) -> DataFrame:
    """``(id, trained, n_tokens, n_known, train_tokens, base_score, score)`` per row; learns from rows where ``train_col`` is true.

    ``keep``: a folder to store the model in, for ``score_with``."""
    spark = docs.sparkSession
    parts = chunks(docs, id_col, text_col, train_col)
    n_train, n_docs, size = (x or 0 for x in parts.agg(
        F.sum("n_train"), F.sum("n_docs"), F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first())
    shards = max(1, -(-size // SHARD))
    counts = materialise(_send_words(parts, shards).groupBy("shard").applyInPandas(_count_words, f"{_ANSWER}, known long, hot binary"), "lm-words")
    own = counts.where(F.col("chunk") == _MODEL)
    often = {START_ID: n_docs} if n_docs >= SHARD else {}
    for r in own.where("hot is not null").select("hot").toLocalIterator():  # at most n_train / SHARD words in all
        often.update(zip(*(x.tolist() for x in load(r.hot))))
    setting = Setting.of(n_train, n_docs, own.agg(F.sum("known")).first()[0] or 0, shards, often)
    sent = spark.sparkContext.broadcast(setting)
    counted = _with_counts(parts, counts.where(F.col("chunk") != _MODEL).select("chunk", "shard", "payload"))
    discard(parts)

    def serve(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        answers, trie = serve_shard(pdf["payload"].tolist(), sent.value)
        out = pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "payload": answers})
        if keep is None:
            return out
        return pd.concat([out, pd.DataFrame({"chunk": [_MODEL], "shard": [pdf["shard"].iloc[0]], "payload": [trie.dump()]})], ignore_index=True)

    found = materialise(_send_ngrams(counted, sent).groupBy("shard").applyInPandas(serve, _ANSWER), "lm-answers")
    if keep is not None:
        found.where(F.col("chunk") == _MODEL).select("shard", "payload").write.parquet(f"{keep}/tries")
        own.select("shard", "payload").write.parquet(f"{keep}/words")
        spark.createDataFrame(
            [(n_train, n_docs, setting.vocabulary, shards, setting.hot.tolist(), setting.hot_first.tolist(), setting.hot_parts.tolist())],
            "n_train long, n_docs long, vocabulary long, shards long, hot array<long>, hot_first array<long>, hot_parts array<long>").write.parquet(f"{keep}/setting")
    return _finish(counted, found, sent, id_col)


def score_with(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns from a stored model; no row is learnt from."""
    spark = docs.sparkSession
    r = spark.read.parquet(f"{model}/setting").first()
    setting = Setting(r.n_train, r.n_docs, r.vocabulary, r.shards, np.array(r.hot, np.int64),
                      np.array(r.hot_first, np.int64), np.array(r.hot_parts, np.int64))
    sent = spark.sparkContext.broadcast(setting)
    train = fresh(docs, "_train")
    parts = chunks(docs.withColumn(train, F.lit(False)), id_col, text_col, train)
    counts = _send_words(parts, setting.shards).groupBy("shard").cogroup(
        spark.read.parquet(f"{model}/words").groupBy("shard")).applyInPandas(_look_up_words, _ANSWER)
    counted = _with_counts(parts, counts)
    discard(parts)

    def serve(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return asked[["chunk", "shard", "payload"]]
        trie = Trie.load(stored["payload"].iloc[0]) if len(stored) else None  # no trie: nobody learnt there, and these rows are not learnt from
        return pd.DataFrame({"chunk": asked["chunk"], "shard": asked["shard"], "payload": serve_shard(asked["payload"].tolist(), sent.value, trie)[0]})

    tries = spark.read.parquet(f"{model}/tries")
    found = materialise(_send_ngrams(counted, sent).groupBy("shard").cogroup(tries.groupBy("shard")).applyInPandas(serve, _ANSWER), "lm-answers")
    return _finish(counted, found, sent, id_col)
