"""WARC archives: write captures, read records back, assemble transactions.

Each page is a capture of three records: request, response (or revisit, if
an earlier page has the same payload of at least ``MIN_REVISIT`` bytes) and
metadata; request and metadata name the response in WARC-Concurrent-To.
Spark's own text writer writes the archives (``.txt.gz``, about
``CAPTURES`` captures each) with its committer, so lost tasks leave nothing
behind and any store will do. Reading parses records by their
Content-Length, whatever the payload holds, and assembly joins the records
of a transaction by their identifiers alone, wherever they lie, into one
nested row per capture.

Null html is an empty payload; a null url has no target. Control characters
and spaces in a url are written as %20. Every row is a capture of its own:
of rows that are alike in all columns the first stands for the others, which
revisit it (below ``MIN_REVISIT`` bytes all are responses). The response of
equal payloads is the one with the smallest page_id (null ids last). Records without their response (orphans) make no row.
Extra columns of the pages play no part. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import materialise

MIN_REVISIT = 100
CAPTURES = 2000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits up to which their table is broadcast; beyond it the pages are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Shares that the revisits of one response are dealt to in a shuffled join.
SHARES = 32
_RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
           "payload_bytes long, payload_digest string, intact boolean, fields map<string,string>, payload binary")


def _uuid(kind: str) -> str:
    h = f"md5(concat('{kind}|', key))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat('<urn:uuid:', " + ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in cuts) + ", '>')"


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, html, digest, size, rid, first_rid)``: first_rid names the response that a revisit refers to."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col), "[\\x00-\\x20\\x7f]", "%20").alias("url"),
        F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    rows = rows.withColumn("key", F.expr("concat(coalesce(cast(page_id as string), '-'), '|', coalesce(url, '-'), '|', digest)"))
    rows = rows.withColumn("rid", F.expr(_uuid("response")))
    slim = materialise(rows.select("page_id", "digest", "size", "rid"), "captures")
    names = slim.where(f"size >= {MIN_REVISIT}").select("digest", F.struct(F.col("page_id").isNull().alias("no"), "page_id", "rid").alias("p"))
    first = names.groupBy("digest").agg(F.min("p").alias("first"), F.max("p").alias("last")).where("first != last").select(F.col("digest").alias("d"), "first")
    again = names.join(first, F.col("digest") == F.col("d")).where("p.rid != first.rid").select(F.col("p.rid").alias("again"), F.col("first.rid").alias("first_rid")).distinct()
    repeated = materialise(slim.groupBy("rid").agg(F.count("*").alias("rows")).where("rows > 1").withColumnRenamed("rid", "repeated"), "repeated")
    n, rows = repeated.count(), rows.join(_sent(again, again.count()), F.col("rid") == F.col("again"), "left").drop("again")
    if not n:
        return rows
    # of a repeated row one is written whole; its copies are records without payload, or with a short one
    marked = rows.join(_sent(repeated, n), F.col("rid") == F.col("repeated"), "left").drop("repeated")
    whole = marked.where("rows is not null").dropDuplicates(["rid"])
    copies = whole.withColumn("html", F.expr(f"if(size >= {MIN_REVISIT}, null, html)")).withColumn("copy", F.expr("explode(sequence(2L, rows))")).hint("rebalance")
    copies = copies.withColumn("first_rid", F.expr(f"if(size >= {MIN_REVISIT}, coalesce(first_rid, rid), null)")) \
        .withColumn("key", F.expr("concat(key, '|', copy)")).withColumn("rid", F.expr(_uuid("response"))).drop("copy")
    return marked.where("rows is null").unionByName(whole).unionByName(copies).drop("rows")


def _sent(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def write(pages: DataFrame, path: str, date: str = DATE, **names: str) -> None:
    """Write the pages' captures as gzipped WARC files below ``path``."""
    rows = captures(pages, **names)
    http = ("concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', size, '\\r\\n\\r\\n')")
    host = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), '-')"
    target = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), ''), '/')"
    request = f"concat('GET ', {target}, ' HTTP/1.1\\r\\nHost: ', {host}, '\\r\\n\\r\\n')"
    about = "concat('page_id: ', coalesce(cast(page_id as string), ''), '\\r\\n')"
    uri = "if(url is null, '', concat('WARC-Target-URI: ', url, '\\r\\n'))"
    head = f"'\\r\\nWARC-Date: {date}\\r\\n', {uri}"
    digest = "'WARC-Payload-Digest: sha256:', digest, '\\r\\n'"

    def record(kind: str, rid: str, block: str, media: str, *more: str) -> str:
        fields = ", ".join((f"'WARC/1.1\\r\\nWARC-Type: ', {kind}, '\\r\\nWARC-Record-ID: ', {rid}", head, *more))
        return f"concat({fields}, 'Content-Type: {media}\\r\\nContent-Length: ', octet_length({block}), '\\r\\n\\r\\n', {block})"

    with_ = "'WARC-Concurrent-To: ', rid, '\\r\\n'"
    revisit = f"if(first_rid is null, '', concat('WARC-Refers-To: ', first_rid, '\\r\\nWARC-Profile: {PROFILE}\\r\\n'))"
    answer = record("if(first_rid is null, 'response', 'revisit')", "rid", f"concat({http}, if(first_rid is null, html, ''))", "application/http;msgtype=response", digest, revisit)
    text = "concat_ws('\\r\\n\\r\\n', {}, {}, {})".format(
        record("'request'", _uuid("request"), request, "application/http;msgtype=request", with_), answer,
        record("'metadata'", _uuid("metadata"), about, "application/warc-fields", with_))
    rows.select(F.expr(text).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", CAPTURES).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield fields, block


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; without ``payloads`` only their sizes and digests."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _RECORD.split(", ")]
        for pdf in batches:
            for content in pdf["content"]:
                with gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content) as stream:
                    rows, size = [], 0
                    for fields, block in parse(stream):
                        rows.append(_row(fields, block, payloads))
                        size += len(block) if payloads else 500
                        if size > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, _RECORD)


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, payload, extra = fields["warc-type"], block, {}
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.decode("latin-1").partition(":")
            extra[name.strip().lower()] = value.strip()
    elif fields.get("content-type") == "application/warc-fields":
        for line in block.decode("utf-8", "replace").splitlines():
            name, _, value = line.partition(":")
            extra[name.strip().lower()] = value.strip()
    told = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":  # its payload is the referred record's
        size, digest, intact = int(extra["content-length"]) if "content-length" in extra else None, told, None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        intact = None if told is None else told == digest
    return (fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"),
            fields.get("warc-date"), size, digest, intact, extra, payload if payloads and kind == "response" else None)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, target_uri, date, request, response, metadata, refers_to_metadata``."""
    fields = ("record_id", "type", "refers_to", "payload_bytes", "payload_digest", "intact", "fields", "payload")
    one = lambda kinds: F.first(F.when(F.col("type").isin(*kinds), F.struct(*fields)), ignorenulls=True)
    answers = ("response", "revisit")
    keyed = found.withColumn("capture_id", F.when(F.col("type").isin(*answers), F.col("record_id")).otherwise(F.col("concurrent_to")))
    rows = keyed.where("capture_id is not null").groupBy("capture_id").agg(
        F.first(F.when(F.col("type").isin(*answers), F.col("target_uri")), ignorenulls=True).alias("target_uri"), F.max("date").alias("date"),
        one(["request"]).alias("request"), one(answers).alias("response"), one(["metadata"]).alias("metadata"))
    return rows.where("response is not null")


def page_table(found: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, intact)`` per capture; refers_to is the response's page."""
    rows = materialise(assemble(found).select(
        "capture_id", F.expr("try_cast(metadata.fields['page_id'] as long)").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"), "response.intact"), "page-records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    again = rows.where("target is not null")
    wanted = materialise(again.select("target").distinct(), "referred")
    n = wanted.count()
    shares = 1 if n <= BROADCAST_ROWS else SHARES  # the revisits of one response may be most rows
    named = rows.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to")) \
        .join(_sent(wanted, n), "target", "left_semi").withColumn("share", F.expr(f"explode(sequence(0, {shares - 1}))"))
    again = again.withColumn("share", F.expr(f"cast(pmod(xxhash64(capture_id), {shares}) as int)"))
    others = rows.where("target is null").withColumn("refers_to", F.lit(None).cast("long"))
    return others.select(columns).union(again.join(_sent(named, n), ["target", "share"], "left").select(columns))
