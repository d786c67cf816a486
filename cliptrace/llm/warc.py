"""WARC archives: write, read, and assemble transactions.

``write`` stores a request, a response (or revisit) and a metadata record per
page through Spark's own text writer, so that files land in any store that
Spark writes to and a lost task is simply run again.  ``read`` parses whole
records by their content lengths.  ``assemble`` joins the records of a capture
through their ``WARC-Concurrent-To`` identifiers into one nested row.

A file is one gzip member, as Spark's writer makes it; files of one member per
record are read as well.  Reading inflates a file piece by piece and holds one
record.  A torn record or member is an error.

A null payload is an empty one.  Repeated pages are separate captures; of equal
payloads the smallest key, then the smallest url, is the response.  Payloads of
any length are written whole.  A null key is stored as an empty one and read as
null.  An empty table gives archives without records.
Control characters of a url are percent-encoded in headers.  Columns other than
key, url and payload are not stored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Pages of up to ``SMALL_BYTES`` that a file holds at most; of pages up to twice
#: as long, half as many, and so on.
PAGES_PER_FILE, SMALL_BYTES = 4_000, 128 << 10
#: Payloads below this many bytes are never written as revisits.
REVISIT_BYTES = 100
_CRLF = "\r\n"
_DATE = "2024-01-01T00:00:00Z"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("concurrent_to", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def _urn(*parts: Column) -> Column:
    """A record id made from ``parts``, the same whenever it is computed."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cutting = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cutting]), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without its very last line feed; a null header is left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(_CRLF))) if isinstance(v, Column) else F.lit(f"{k}: {v}{_CRLF}") for k, v in headers]
    return F.concat(F.lit("WARC/1.1" + _CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF * 2)), block, F.lit(_CRLF + "\r"))


def _copies(pages: DataFrame, key: str, url: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """The rows to write (key, url, body, bytes, digest, copy), and the first
    page (digest, first_key, first_url, shared) of each payload that is shared.

    Nothing depends on how rows are dealt out, so that a task that is run again
    decides alike.  Rows that are the same in all columns are told apart by
    ``copy``; only copy 0 of a long payload keeps its body.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body"), "digest": F.unhex(F.sha2("body", 256))})
    groups = cut(rows.groupBy("digest", "key", "url", "bytes").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", F.col("url").isNull().alias("bare"), "url")).alias("first")
    shared = groups.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(first, F.sum("n").alias("shared")).filter("shared > 1")
    shared = cut(shared.select("digest", F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url"), "shared"))
    repeated = groups.filter("n > 1")
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0)), shared
    repeated = cut(repeated)
    r = repeated.select(F.col("digest").alias("_d"), F.col("key").alias("_k"), F.col("url").alias("_u"))
    alike = (F.col("digest") == F.col("_d")) & F.col("key").eqNullSafe(F.col("_k")) & F.col("url").eqNullSafe(F.col("_u"))
    once = rows.join(r, alike, "left_anti").withColumn("copy", F.lit(0))
    bodies = rows.join(r, alike, "left_semi").groupBy("digest", "key", "url", "bytes").agg(F.first("body").alias("body"), F.count("*").alias("n"))
    long = F.col("bytes") >= REVISIT_BYTES
    firsts = bodies.select("key", "url", "body", "bytes", "digest", F.explode(F.when(long, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).alias("copy"))
    others = repeated.filter(long).select("key", "url", F.lit("").alias("body"), "bytes", "digest", F.explode(F.sequence(F.lit(1), (F.col("n") - 1).cast("int"))).alias("copy"))
    return once.unionByName(firsts).unionByName(others), shared


def escaped(url: Column) -> Column:
    """A url with its control characters percent-encoded: it fits on a line."""
    encoded = lambda c: F.when(c.rlike(r"\p{Cntrl}"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(r"\p{Cntrl}"), F.array_join(F.transform(F.split(url, ""), encoded), "")).otherwise(url)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write ``pages`` as gzipped WARC files below ``path``.

    Of the pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one
    with the smallest key is a response; the others are revisits that refer to
    it and repeat no payload.
    """
    rows, first_of = _copies(pages, key, url, payload)
    rows = rows.join(first_of, "digest", "left")
    is_first = F.col("key").eqNullSafe(F.col("first_key")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 0)
    again = F.col("shared").isNotNull() & ~is_first
    mine = lambda kind: _urn(F.lit(kind), F.col("key"), F.col("url"), hexed, F.col("copy"))
    hexed = F.lower(F.hex("digest"))
    me = mine("response")
    target = escaped(F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    common = lambda kind, rid: [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", _DATE), ("WARC-Target-URI", target)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), hexed))
    with_me = ("WARC-Concurrent-To", me)
    request = _record([*common("request", mine("request")), with_me, ("Content-Type", "application/http; msgtype=request")],
                      F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{_CRLF * 2}")))
    http_type = ("Content-Type", "application/http; msgtype=response")
    response = _record([*common("response", me), digest, http_type], F.concat(http, F.col("body")))
    revisit = _record([*common("revisit", me), digest, http_type, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", _urn(F.lit("response"), F.col("first_key"), F.col("first_url"), hexed, F.lit(0)))], http)
    metadata = _record([*common("metadata", mine("metadata")), with_me, ("Content-Type", "application/warc-fields")],
                       F.concat(F.lit("key: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(_CRLF)))
    line = F.concat(request, F.lit("\n"), F.when(again, revisit).otherwise(response), F.lit("\n"), metadata)
    # Pages of like size share files, longer ones fewer to a file, so that the
    # bytes of a file are bounded.
    longest = rows.agg(F.max("bytes")).first()[0] or 0
    level = 0
    while True:
        low, high = (SMALL_BYTES << (level - 1)) if level else -1, SMALL_BYTES << level
        some = rows.filter((F.col("bytes") > low) & (F.col("bytes") <= high)) if level or longest > high else rows
        # Each row closes with the writer's own line end, the last byte of its last record.
        out = some.select(line.alias("value")).write.option("lineSep", "\n").option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, PAGES_PER_FILE >> level)).text(f"{path}/level={level}")
        if longest <= high:
            return
        level += 1


def inflate(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of all gzip members, or of ``content`` if it is not gzipped, a
    piece at a time."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[a : a + size] for a in range(0, len(content), size))
        return
    rest = memoryview(content)
    while len(rest):
        member = zlib.decompressobj(31)
        todo: bytes | memoryview = rest
        while not member.eof:
            piece = member.decompress(todo, size)
            if not piece and not member.unconsumed_tail and not member.eof:
                raise ValueError("truncated gzip member")
            if piece:
                yield piece
            todo = member.unconsumed_tail
        at = len(content) - len(member.unused_data)
        while at < len(content) and content[at] == 0:  # members may be padded
            at += 1
        rest = rest[len(rest) - (len(content) - at) :]


def unpack(content: bytes) -> bytes:
    """All bytes that ``inflate`` gives."""
    return b"".join(inflate(content))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    return records((data,))


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file that
    comes in pieces; no more than a record and a piece are held."""
    source, held, at = iter(pieces), bytearray(), 0  # at: bytes of the file before what is held

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        end, seen = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError(f"truncated header of the WARC record at byte {at}")
        head = held[:end].decode("utf-8", "replace").split(_CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        n = int(fields["content-length"])
        if not fill(end + 4 + n):
            raise ValueError(f"truncated block of the WARC record at byte {at}")
        yield fields, bytes(held[end + 4 : end + 4 + n])
        fill(end + 4 + n + 4)
        at += min(len(held), end + 4 + n + 4)
        del held[: end + 4 + n + 4]


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, payload, size, digest = fields.get("warc-type"), block, len(block), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    extra = {}
    if kind in ("response", "revisit", "request"):
        head, _, payload = block.partition(b"\r\n\r\n")
        extra = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(_CRLF)[1:])}
        if kind == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        elif kind == "revisit":
            size = int(extra.get("content-length", 0))
        else:
            size = len(payload)
    elif kind == "metadata":
        extra = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(_CRLF) if x)}
    return (fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"),
            extra, size, digest, payload if with_payload and kind == "response" else None)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all files below ``path``.

    ``payload_bytes`` and ``payload_digest`` are computed from the payload of a
    response; a revisit has those of the payload it stands for.  Without
    ``payloads`` the payload itself is not returned.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                held, out = 0, []
                for fields, block in records(inflate(content)):
                    out.append(_row(fields, block, payloads))
                    held += len(block)
                    if held > 16 << 20 or len(out) >= 6_000:
                        yield pd.DataFrame(out, columns=RECORD.names)
                        held, out = 0, []
                if out:
                    yield pd.DataFrame(out, columns=RECORD.names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: a response or revisit with its requests and
    metadata, joined through ``concurrent_to``.  Records that belong to no
    response are left out; a capture without request or metadata has nulls."""
    beside = records.filter("record_type IN ('request', 'metadata') AND concurrent_to IS NOT NULL")
    one = F.struct("record_id", "target_uri", "date", "fields")
    beside = beside.groupBy(F.col("concurrent_to").alias("_of")).agg(
        F.collect_list(F.when(F.col("record_type") == "request", one)).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", one)).alias("metadata"),
    )
    main = records.filter("record_type IN ('response', 'revisit')").drop("concurrent_to")
    return main.join(beside, F.col("record_id") == F.col("_of"), "left").drop("_of")


def captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The captures below ``path`` with the key that ``write`` stored; null if
    that was null or empty."""
    key = F.element_at(F.get("metadata", F.lit(0))["fields"], "key")
    return assemble(read(spark, path, payloads)).withColumn("key", F.when(key != "", key))


def resolve(found: DataFrame) -> DataFrame:
    """Captures with ``refers_to_key``, the key of the response that a revisit
    refers to.  A third of all captures may refer to one response: both sides
    of the join are plain exchanges that adaptive execution can split."""
    slim = cut(found.drop("payload", "requests", "metadata", "fields"))
    named = slim.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("key").alias("refers_to_key"))
    return slim.join(named, (F.col("refers_to") == F.col("_id")) & (F.col("record_type") == "revisit"), "left").drop("_id")
