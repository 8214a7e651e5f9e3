"""Line deduplication over overlapping three-line windows.

Every run of ``width`` consecutive lines is a window (a text with fewer
lines is one window of all its lines). Windows are hashed, repeated ones
are found over all texts by one grouped minimum, and every occurrence but
the first (smallest document, then position) covers its lines. Overlapping
covered windows merge, and covered lines are removed; the rest is joined
again by line feeds.

Lines are compared as they stand, but for a trailing carriage return.
Windows without a letter or digit never count as repeats. Null and empty texts stay as they
are. Rows with the same id and text are one document and get one result
each; documents with the same id and different texts come in the order of
their hashes. Ids may be null (they come first). Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import fresh

WIDTH = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(id, th, pos, size, h1, h2)``: a row per window of each distinct document."""
    lines = docs.where(F.length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
        F.split(F.col(text_col), "\r?\n").alias("lines"))
    hashed = lines.select(
        "id", "th",
        F.expr("transform(lines, x -> struct(xxhash64(x) as a, xxhash64(x, 1) as b, x rlike '[\\\\p{L}\\\\p{N}]' as word))").alias("hs"))
    spans = hashed.selectExpr(
        "id", "th", "least(size(hs), %d) as size" % width,
        "posexplode(transform(sequence(0, greatest(size(hs) - %d, 0)), i -> slice(hs, i + 1, %d))) as (pos, w)" % (width, width))
    return spans.where("exists(w, x -> x.word)").selectExpr(
        "id", "th", "pos", "size", "xxhash64(size, w.a) as h1", "xxhash64(size, w.b) as h2")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(id, th, spans)``: the merged 0-based line spans [start, end) that repeat earlier lines."""
    found = windows(docs, id_col, text_col, width)
    # identical rows are one document: their windows fall together here
    first = found.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "th", "pos")).alias("first"), F.max(F.struct("id", "th", "pos")).alias("last"))
    first = first.where("not (first <=> last)").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where("not (struct(id, th, pos) <=> first)")
    spans = later.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "size"))).alias("s"))
    merged = F.expr("""aggregate(s, cast(array() as array<struct<start: int, stop: int>>), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).stop >= x.pos,
           concat(slice(acc, 1, size(acc) - 1),
                  array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, x.pos + x.size)))),
           concat(acc, array(named_struct('start', x.pos, 'stop', x.pos + x.size)))))""")
    return spans.select("id", "th", merged.alias("spans"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, removed_col: str | None = None) -> DataFrame:
    """``docs`` without the lines that repeat an earlier window; ``removed_col``: also the number of removed lines."""
    key, th, spans = (fresh(docs, x) for x in ("_line_id", "_line_th", "_line_spans"))
    covered = covered_lines(docs, id_col, text_col, width).toDF(key, th, spans)
    joined = docs.join(covered, docs[id_col].eqNullSafe(covered[key]) & (F.xxhash64(docs[text_col]) == covered[th]), "left")
    kept = F.expr(
        f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> not exists(`{spans}`, s -> i >= s.start and i < s.stop)), '\\n')")
    out = {text_col: F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(kept)}
    names = list(docs.columns)
    if removed_col:
        names.append(removed_col)
        out[removed_col] = F.expr(f"cast(coalesce(aggregate(`{spans}`, 0, (n, s) -> n + s.stop - s.start), 0) as int)")
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in names])
