"""Prefix trie of conversations from sorted sequences, their LCPs and sparse-table range minima.

A conversation is the sequence of its turns' digests. Sequences are sorted
by Spark and cut into blocks of bounded size. In a block, LCP[i] is the
number of leading turns that row i shares with the row before it (a block's
first row: with the last row of the block before, which comes along).
Every prefix that first appears at a row is a candidate, and each one finds
its members independently: over a sparse table of range minima it
binary-searches how far left and right the LCPs stay at least its depth.
No stack, and no candidate depends on another. The smallest member comes
from a second sparse table, the other figures from prefix sums:

* children: candidates one turn deeper whose parent, found by a left search, it is;
* leaves: 1 + rows of the interval but the first with LCP[i] < length[i-1];
* saved: sum over the rows but the first of (weight of the shared turns
  - weight of the turns above the node).

All of these are sums or minima, so a node whose interval reaches a
block's edge is put together from its blocks by a grouped aggregate of
few rows: those on the path of a block's first and last row.

Sequences are handled in segments of at most ``SEGMENT`` turns, so no row
holds a whole long conversation: conversations that share a whole segment
are a class, sorted among themselves by the next segment in a further
round; the tail of a conversation that is alone in its class needs no sort.
Turns are numbered after a range partition by (conversation, turn), so a
conversation with very many turns is spread over tasks.

Defined cases: turns come by number, null first, those with one number by
digest; repeated rows are turns of their own; null role and text are empty;
rows with a null conversation id take no part; an empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialise

SEGMENT = 256
#: Rows and turns of a block at most (a row of more turns is a block of its own).
BLOCK_ROWS, BLOCK_TURNS = 16_384, 262_144
#: Ids of a stretch of text that is hashed as one when a node's ends lie in several blocks.
CHUNK_IDS = 256
#: Base conversations are the multiples of this; a conversation takes over at most HEAD turns from its base.
FAMILY, HEAD = 100, 5
_WIDTH = 32  # characters of a turn's digest: 128 bits
_NO_ENDS = sha256(b"").hexdigest()


# ---------------------------------------------------------------- sequences

def turn_digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, chars)``: a row per turn, its role and text as a digest, its text's code points."""
    rows = turns.where("conv_id is not null").selectExpr(
        "cast(conv_id as long) as conv_id", "turn", "coalesce(cast(role as string), '') as role", "coalesce(cast(text as string), '') as text")
    return rows.selectExpr("conv_id", "turn", f"left(sha2(concat(length(role), ':', role, text), 256), {_WIDTH}) as digest",
                           "cast(length(text) as long) as chars")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of sorted turns within their conversation, counted from the partition's first."""
    last, seen, part = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        first = np.r_[True, ids[1:] != ids[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        pos = np.arange(1, len(ids) + 1) - start
        if ids[0] == last:
            pos[:int(np.argmax(first[1:]) + 1) if first[1:].any() else len(ids)] += seen
        last, seen = ids[-1], int(pos[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(pos), batch.column("digest"), batch.column("chars"), pa.array(np.full(len(ids), part, np.int32))],
            ["conv_id", "pos", "digest", "chars", "part"])


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, chars)`` with places from 1, whatever the number of a conversation's turns."""
    spark = turns.sparkSession
    rows = materialise(turn_digests(turns), "turns")
    order = ["conv_id", "turn", "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.mapInArrow(_number, "conv_id long, pos long, digest string, chars long, part int"), "numbered")
    # conversations that span partitions: at most one for each border
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).orderBy("part").collect()
    over = sorted({x.b for x, y in zip(ends, ends[1:]) if x.b == y.a})
    if not over:
        return rows.select("conv_id", "pos", "digest", "chars")
    some = spark.createDataFrame([(i,) for i in over], "conv_id long")
    sizes = rows.join(F.broadcast(some), "conv_id").groupBy("conv_id", "part").agg(F.max("pos").alias("n")).collect()
    before, offsets = {}, []
    for conv, part, n in sorted(map(tuple, sizes)):
        offsets.append((conv, part, before.get(conv, 0)))
        before[conv] = before.get(conv, 0) + n
    moved = spark.createDataFrame(offsets, "conv_id long, part int, before long")
    return rows.join(F.broadcast(moved), ["conv_id", "part"], "left") \
        .selectExpr("conv_id", "pos + coalesce(before, 0) as pos", "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, digest, chars)`` of every conversation: the first h turns of its base (the multiple of
    FAMILY at or before it), then its own turns after its first h; h is crc32 of its id modulo HEAD + 1.
    A row of depth 0 stands for the conversation itself."""
    rows = numbered(turns).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1))
    heads = rows.where(f"conv_id % {FAMILY} = 0 and pos <= {HEAD}").groupBy(F.col("conv_id").alias("base")) \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    convs = rows.groupBy("conv_id").agg(F.first("h").alias("h")).withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}")) \
        .join(heads, "base", "left") \
        .selectExpr("conv_id", "if(h > 0 and head is not null, slice(head, 1, cast(h as int)), cast(array() as array<struct<pos:bigint,digest:string,chars:bigint>>)) as head")
    own = rows.where("pos > h").join(convs.selectExpr("conv_id", "cast(size(head) as long) as taken"), "conv_id") \
        .selectExpr("conv_id", "pos - h + taken as depth", "digest", "chars")
    taken = convs.selectExpr("conv_id", "explode(concat(array(struct(0L as pos, '' as digest, 0L as chars)), head)) as t") \
        .selectExpr("conv_id", "t.pos as depth", "t.digest as digest", "t.chars as chars")
    return own.union(taken)


def segments(turns: DataFrame, size: int) -> DataFrame:
    """``(conv_id, seg, key, chars)``: the digests of up to ``size`` turns in one text, and their weights."""
    rows = turns.withColumn("seg", F.expr(f"cast(greatest(depth - 1, 0) div {size} as int)"))
    # depth 0 sorts first; its digest is empty and its weight is cut off
    some = rows.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "chars"))).alias("t"))
    return some.selectExpr("conv_id", "seg", "array_join(transform(t, x -> x.digest), '') as key",
                           "transform(filter(t, x -> x.depth > 0), x -> x.chars) as chars")


# ------------------------------------------------------------------- blocks

_COLUMNS = "cls string, conv_id long, key string, chars array<long>, least long, more_children long, more_leaves long, more_saved long, going boolean"
_BLOCK_SCHEMA = f"block long, kind int, {_COLUMNS}"
_NODE_SCHEMA = ("kind int, block long, id string, parent string, cls string, depth int, conv_id long, parent_conv_id long, "
                "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, least long, chunk int")
_MORE = ("more_children", "more_leaves", "more_saved")
OWN, HALO, LAST = 0, 1, 2
CLOSED, UNDER_OPEN, OPEN, ENDS = 0, 1, 2, 3


def _cut(rows: int, turns: int):
    """Sorted rows into blocks; a block begins with a copy of the row before it, the partition's last row comes once more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, n, weight, last = TaskContext.get().partitionId(), 0, 0, 0, None

        def out(batch: pa.RecordBatch, blocks, kind: int) -> pa.RecordBatch:
            head = [pa.array(np.int64(part << 32) + np.broadcast_to(np.asarray(blocks, np.int64), batch.num_rows)),
                    pa.array(np.full(batch.num_rows, kind, np.int32))]
            return pa.RecordBatch.from_arrays([*head, *batch.columns], ["block", "kind", *batch.schema.names])

        for batch in batches:
            sizes = np.diff(batch.column("chars").offsets.to_numpy())
            at = 0
            while at < len(sizes):
                end = min(len(sizes), at + rows - n)
                over = np.flatnonzero(weight + np.cumsum(sizes[at:end]) > turns)
                if len(over):
                    end = at + int(over[0])
                if end == at and n == 0:
                    end = at + 1
                if end > at:
                    yield out(batch.slice(at, end - at), block, OWN)
                    n, weight, last = n + end - at, weight + int(sizes[at:end].sum()), batch.slice(end - 1, 1)
                    at = end
                if at < len(sizes) or n >= rows:
                    block, n, weight = block + 1, 0, 0
                    if last is not None:
                        yield out(last, block, HALO)
        if last is not None:
            yield out(last, block, LAST)

    return run


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """A sparse table: row k holds the minima of 2 ** k values from each place on."""
    table, k = [values], 1
    while 2 * k <= len(values):
        table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        k *= 2
    return table


def _range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty(len(left), table[0].dtype)
    level = np.frexp((right - left + 1).astype(float))[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][left[at]], table[k][right[at] - (1 << k) + 1])
    return out


def _extent(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray, step: int) -> np.ndarray:
    """How far from row ``at`` to the right (step 1) or left (-1) the LCPs in between are all at least ``depth``."""
    n, out = len(table[0]), at.copy()
    for k in range(len(table) - 1, -1, -1):
        size = 1 << k
        fits = out + size < n if step > 0 else out - size >= 0
        from_ = out[fits] + 1 if step > 0 else out[fits] - size + 1
        good = np.flatnonzero(fits)[table[k][from_] >= depth[fits]]
        out[good] += step * size
    return out


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _lcps(digests: np.ndarray, start: np.ndarray, size: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Leading turns that each row shares with the row before it; -1 for the first row and between classes."""
    n = len(size)
    out = np.full(n, -1, np.int64)
    if n < 2:
        return out
    m = np.where(cls[1:] == cls[:-1], np.minimum(size[1:], size[:-1]), 0)
    pair = np.repeat(np.arange(n - 1), m)
    t = np.arange(len(pair)) - np.repeat(_starts(m), m)
    differ = np.flatnonzero((digests[start[:-1][pair] + t] != digests[start[1:][pair] + t]).any(axis=1))
    shared = m.copy()
    np.minimum.at(shared, pair[differ], t[differ])
    out[1:] = np.where(cls[1:] == cls[:-1], shared, -1)
    return out


def block_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one block: whole ones, and the block's share of those that reach its edges."""
    table = table.combine_chunks().sort_by([("kind", "descending"), ("cls", "ascending"), ("key", "ascending"), ("conv_id", "ascending")])
    halo = int((table.column("kind").to_numpy() == HALO).sum())
    block = int(table.column("block")[0].as_py())
    n_all = table.num_rows
    if halo == n_all:
        return _nodes([[]] * 15)
    cls_text = table.column("cls").to_pylist()
    keys = table.column("key").to_pylist()
    conv = table.column("conv_id").to_numpy()
    size = np.fromiter((len(k) // _WIDTH for k in keys), np.int64, n_all)
    start = _starts(size)
    digests = np.frombuffer("".join(keys).encode(), np.uint64).reshape(-1, _WIDTH // 8)
    cls = np.unique(np.array(cls_text), return_inverse=True)[1]
    weights = np.r_[0, np.cumsum(table.column("chars").combine_chunks().flatten().to_numpy())] if size.sum() else np.zeros(1, np.int64)

    def weight(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points of the first ``depth`` turns of each row."""
        return weights[start[row] + depth] - weights[start[row]]

    lcp = _lcps(digests, start, size, cls)[halo:]
    before = np.r_[size[0] if halo else 0, size[halo:-1]] if n_all > halo else size[:0]
    rows = np.arange(halo, n_all)  # in the table
    size_own, conv_own, n = size[halo:], conv[halo:], n_all - halo
    table_l, table_c = _minima(lcp), _minima(conv_own)

    # candidates: the prefixes that first appear at each row; at the first row those that go on from the block before too
    lowest = np.maximum(lcp + 1, 0)
    lowest[0] = 0
    count = size_own - lowest + 1
    base = _starts(count)
    at = np.repeat(np.arange(n), count)
    depth = np.arange(len(at)) - base[at] + lowest[at]
    goes_on = (at == 0) & (depth <= lcp[0])
    left, right = _extent(table_l, at, depth, -1), _extent(table_l, at, depth, 1)

    def node_of(row: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """The candidate of that depth whose interval holds the row."""
        first = _extent(table_l, row, deep, -1)
        return base[first] + deep - lowest[first]

    parent = np.full(len(at), -1)
    below = np.flatnonzero(depth > 0)
    parent[below] = node_of(at[below], depth[below] - 1)

    def over(values: np.ndarray, also_first: np.ndarray) -> np.ndarray:
        """Sums over each interval, without its first row unless told so."""
        sums = np.r_[0, np.cumsum(values)]
        return sums[right + 1] - sums[np.where(also_first, left, left + 1)]

    everywhere = np.ones(len(at), bool)
    leaves = over((lcp < before).astype(np.int64), goes_on)
    shared = np.where(lcp > 0, weight(rows, np.maximum(lcp, 0)), 0)
    above = weight(rows[at], np.maximum(depth - 1, 0))
    saved = over(shared, goes_on) - above * (right - left + goes_on)
    children = np.bincount(parent[below][~goes_on[below]], minlength=len(at))
    extra = {c: over(table.column(c).to_numpy()[halo:], everywhere) for c in ("more_leaves", "more_saved")}
    leaves, saved = leaves + extra["more_leaves"], saved + extra["more_saved"]
    end = node_of(np.arange(n), size_own)
    np.add.at(children, end, table.column("more_children").to_numpy()[halo:])  # those of a whole segment's node

    open_ = goes_on | (right == n - 1)
    # members that end at a node: they come first in its interval, by id
    stops = np.flatnonzero(~table.column("going").to_numpy(zero_copy_only=False)[halo:])
    end = end[stops]
    begin = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else stops
    ends = {int(end[a]): conv_own[stops[a:b]] for a, b in zip(begin, np.r_[begin[1:], len(end)])}
    digest_of = [_NO_ENDS] * len(at)
    for node, ids in ends.items():
        if not open_[node]:
            digest_of[node] = sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()

    least = _range_min(table_c, left, right)
    parent_conv = [None if p < 0 or open_[p] else int(least[p]) for p in parent.tolist()]
    kind = np.where(open_, OPEN, np.where((parent >= 0) & open_[parent], UNDER_OPEN, CLOSED)).astype(np.int32)
    names: list[str | None] = [None] * len(at)
    for i in np.flatnonzero(open_).tolist():
        row = halo + int(at[i])
        names[i] = sha256((cls_text[row] + ":" + keys[row][:_WIDTH * int(depth[i])]).encode()).hexdigest()[:_WIDTH]
    above_names = [names[p] if p >= 0 else None for p in parent.tolist()]
    taken = pa.array(rows[at])
    row_cls, row_least = table.column("cls").take(taken), table.column("least").take(taken)
    columns = [kind, np.full(len(at), block), names, above_names, row_cls, depth.astype(np.int32), least, parent_conv, right - left + 1, children,
               np.where(open_, leaves, leaves + 1), saved, digest_of, row_least, np.zeros(len(at), np.int32)]
    out = [_nodes(columns)]
    pieces = [(names[node], k, ",".join(map(str, ids[a:a + CHUNK_IDS].tolist())))
              for node, ids in ends.items() if open_[node] for k, a in enumerate(range(0, len(ids), CHUNK_IDS))]
    if pieces:
        none = [None] * len(pieces)
        out.append(_nodes([[ENDS] * len(pieces), [block] * len(pieces), [p[0] for p in pieces], *[none] * 9, [p[2] for p in pieces], none, [p[1] for p in pieces]]))
    return pa.concat_tables(out)


def _nodes(columns: list) -> pa.Table:
    fields = [f.split() for f in _NODE_SCHEMA.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, types[t]) for name, t in fields])
    return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per id over its sorted stretches of text, as they stream by."""
    now, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for name, text in zip(batch.column("id").to_pylist(), batch.column("ends_sha256").to_pylist()):
            if name != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = name, sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["id", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["id", "ends"])


# -------------------------------------------------------------------- rounds

_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def level_nodes(members: DataFrame, above: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below depth ``above`` of one round's classes (and the root, at ``above`` 0), and the figures of
    each class's own node ``(cls, n_children, n_leaves, saved_tokens)``."""
    spark = members.sparkSession
    order = ["cls", "key", "conv_id"]
    cut = members.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = materialise(cut.mapInArrow(_cut(BLOCK_ROWS, BLOCK_TURNS), _BLOCK_SCHEMA), "blocks")
    parts = sorted(r.part for r in blocks.where(f"kind = {LAST}").selectExpr("shiftright(block, 32) as part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:])), "part long, following long")  # a row per partition
    borders = blocks.where(f"kind = {LAST}").withColumn("part", F.expr("shiftright(block, 32)")).join(F.broadcast(after), "part") \
        .selectExpr("shiftleft(following, 32) as block", f"{HALO} as kind", *blocks.columns[2:])
    grouped = blocks.where(f"kind <> {LAST}").union(borders)
    nodes = materialise(grouped.groupBy("block").applyInArrow(block_nodes, _NODE_SCHEMA), "nodes")

    shares = nodes.where(f"kind = {OPEN}")
    chunks = nodes.where(f"kind = {ENDS}").select("id", "block", "chunk", "ends_sha256")
    digests = chunks.repartition("id").sortWithinPartitions("id", "block", "chunk").select("id", "ends_sha256") \
        .mapInArrow(_hash_chunks, "id string, ends string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "saved_tokens")]
    whole = shares.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("cls").alias("cls"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("least").alias("least"), (F.sum("n_leaves") + 1).alias("n_leaves"), *sums)
    whole = materialise(whole.join(digests, "id", "left").withColumn("ends_sha256", F.expr(f"coalesce(ends, '{_NO_ENDS}')")).drop("ends"), "open-nodes")

    names = whole.selectExpr("id as parent", "conv_id as _above")
    # a hot node's name is looked up within each block, where it has one row
    near = shares.selectExpr("block", "id as parent").join(names, "parent")
    under = nodes.where(f"kind = {UNDER_OPEN}").join(near, ["block", "parent"]).withColumn("parent_conv_id", F.col("_above"))
    joined = whole.join(names, "parent", "left").withColumn("parent_conv_id", F.col("_above"))
    wanted = ["cls", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "least"]
    found = nodes.where(f"kind = {CLOSED}").select(wanted).union(under.select(wanted)).union(joined.select(wanted))
    roots = found.where("depth = 0").select("cls", "n_children", "n_leaves", "saved_tokens")
    if above:  # the class's own node belongs to the round before; it may have members that end there
        found = found.where("depth > 0").withColumn("parent_conv_id", F.expr("if(depth = 1, least, parent_conv_id)"))
    found = found.withColumn("depth", F.expr(f"cast(depth + {above} as long)"))
    return found.select(*_RESULT), roots


def prefix_trie(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    seqs = materialise(segments(rebuilt(turns), segment), "sequences")
    rounds = (seqs.agg(F.max("seg")).first()[0] or 0) + 1
    members = seqs.where("seg = 0").selectExpr("'' as cls", "conv_id", "key", "chars", "cast(null as long) as least")
    levels, classes, out = [members], [], []
    for r in range(1, rounds):
        # classes: conversations with one whole segment; ``least`` counts those that end there too
        full = levels[-1].where(f"size(chars) = {segment}").selectExpr("conv_id", f"left(sha2(concat(cls, ':', key), 256), {_WIDTH}) as cls")
        next_ = full.join(seqs.where(f"seg = {r}").select("conv_id", "key", "chars"), "conv_id", "left")
        groups = materialise(next_.groupBy("cls").agg(
            F.min("conv_id").alias("least"), F.count("key").alias("going"), F.expr("min(conv_id) filter (where key is not null)").alias("first"))
            .where("going > 0"), "classes")
        if groups.isEmpty():
            break
        classes.append(groups)
        tails = groups.where("going = 1").selectExpr("first as conv_id", "least")
        out.append(_tails(seqs.where(f"seg >= {r}").join(tails, "conv_id"), r * segment, segment))
        some = next_.where("key is not null").join(groups.where("going > 1").select("cls", "least"), "cls")
        levels.append(materialise(some.select("cls", "conv_id", "key", "chars", "least"), "members"))
    roots = None
    for r in range(len(levels) - 1, -1, -1):
        going = seqs.where(f"seg = {r + 1}").selectExpr("conv_id", "true as going")
        if r < len(classes):
            figures = classes[r].where("going = 1").selectExpr("first as conv_id", "1L as more_children", "0L as more_leaves", "0L as more_saved")
            if roots is not None:
                figures = figures.union(classes[r].where("going > 1").join(roots, "cls").selectExpr(
                    "first as conv_id", "n_children as more_children", "n_leaves - 1 as more_leaves", "saved_tokens as more_saved"))
            rows = levels[r].join(going.join(figures, "conv_id", "left"), "conv_id", "left")
        else:
            rows = levels[r].selectExpr("*", *[f"cast(null as long) as {c}" for c in _MORE], "false as going")
        rows = rows.selectExpr("cls", "conv_id", "key", "chars", "least", *[f"coalesce({c}, 0L) as {c}" for c in _MORE], "coalesce(going, false) as going")
        nodes, roots = level_nodes(rows, r * segment)
        roots = materialise(roots, "roots") if r else None
        out.append(nodes)
    result = out[0]
    for nodes in out[1:]:
        result = result.union(nodes)
    return result


def _tails(seqs: DataFrame, above: int, segment: int) -> DataFrame:
    """Nodes of conversations that are alone below depth ``above``: a chain, a row per turn."""
    last = seqs.groupBy("conv_id").agg(F.max(F.expr(f"cast(seg as long) * {segment} + size(chars)")).alias("size"))
    rows = seqs.join(last, "conv_id").selectExpr("conv_id", "least", "size", "cast(seg as long) as seg", "explode(sequence(1, size(chars))) as at") \
        .withColumn("depth", F.expr(f"at + seg * {segment}"))
    return rows.selectExpr(
        "conv_id", "depth", f"if(depth = {above + 1}, least, conv_id) as parent_conv_id", "1L as n_convs", "if(depth = size, 0L, 1L) as n_children",
        "1L as n_leaves", "0L as saved_tokens", f"if(depth = size, sha2(cast(conv_id as string), 256), '{_NO_ENDS}') as ends_sha256")
