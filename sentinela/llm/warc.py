"""WARC archives: written as transactions, read back and assembled (operator 1).

``write_archives`` writes three records per page: request, response (or revisit, if an earlier
page has the same payload) and metadata, tied by WARC-Concurrent-To. ``read_records``
parses archives of any origin as a stream, in memory one record at a time. ``assemble`` joins the
records of a capture through their concurrent-to identifiers into one nested row.

Archives are gzip files of whole records, written and read through Spark, so they can lie in any
store that Spark reaches. Gzip files are not split, so a record never spans two tasks.

Edge cases: a null payload is empty; a page without an id (null) counts as the largest one; of
pages equal in id and payload all are responses; captures without a response are not
assembled; a missing request or metadata record is null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Records carry a fixed date: the pages have none, and a repeated task must write the same.
DATE = "2020-01-01T00:00:00Z"
DIGITS_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = ("record_id string, type string, concurrent_to array<string>, target_uri string, "
          "refers_to_uri string, payload_digest string, digest_holds boolean, "
          "payload_bytes long, headers map<string,string>, block binary")


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32, without a prefix: four digits for every five hexadecimal ones."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS_32, BASE_32)


def _record(kind: str | Column, record_id: Column, fields: list[tuple[str, Column]],
            block: Column) -> Column:
    """A record up to its last line end, which the text writer adds."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind),
             F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    # Fields with a null value are left out.
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def _urn() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))


def transactions(pages: DataFrame, *, id_column: str, url_column: str, payload_column: str,
                 least_revisit: int = 0) -> DataFrame:
    """One row per record of the pages' captures: column ``record``.

    A page whose payload has ``least_revisit`` bytes or more is a revisit if a page of
    smaller id has the same one. Payloads are compared by digest and length.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    own = pages.select(F.col(id_column).cast("long").alias("page"),
                       F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": payload_digest(F.col("payload").cast("binary")),
                           "size": F.octet_length("payload")})
    # The count is combined in each task, so a payload on very many pages is one row per task;
    # only payloads that occur on several pages take part in the join.
    firsts = own.where(F.col("size") >= least_revisit).groupBy("digest", "size").agg(
        F.min_by(F.struct("page", F.col("url").alias("first_url")), F.coalesce("page", F.lit(2**63 - 1)))
        .alias("first"), F.count("*").alias("pages"))
    firsts = firsts.where("pages > 1").select("digest", "size", F.col("first.page").alias("first_page"),
                                              "first.first_url", F.lit(True).alias("again"))
    marked = own.join(firsts, ["digest", "size"], "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page").eqNullSafe(F.col("first_page"))
    # Identifiers are drawn once per capture and live only in the archives.
    marked = marked.withColumns({"revisit": revisit, "rid": _urn()})
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    uri = ("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " "))
    host = F.coalesce(F.regexp_extract("url", r"^\w+://([^/?#\s]+)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^\w+://[^/?#]+([^#\r\n]*)", 1), F.lit(""))
    together = ("WARC-Concurrent-To", F.col("rid"))
    request = _record("request", _urn(), [
        uri, together, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.lit("/")),
                 F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    response = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("rid"), [
        uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        ("WARC-Refers-To-Target-URI",
         F.when(F.col("revisit"), F.regexp_replace("first_url", "[\r\n]", " "))),
        ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(head, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))))
    metadata = _record("metadata", _urn(), [
        uri, together, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\r\n")))
    return marked.select(F.explode(F.array(request, response, metadata)).alias("record"))


def write_archives(pages: DataFrame, path: str, *, id_column: str = "page_id",
                   url_column: str = "url", payload_column: str = "html",
                   least_revisit: int = 0) -> None:
    """Write the pages' captures as gzip archives, one per task, into a new folder."""
    transactions(pages, id_column=id_column, url_column=url_column, payload_column=payload_column,
                 least_revisit=least_revisit).write.option("compression", "gzip").option(
        "lineSep", "\n").text(path)


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header fields; a line that begins with white space goes on with the field before."""
    fields: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            fields.append((name.strip().lower(), value.strip()))
    return fields


def parse_record(head: bytes, block: bytes) -> dict:
    """A record's row from its header lines and block."""
    fields = _fields(head.split(b"\r\n")[1:])
    named = dict(reversed(fields))          # of a repeated field the first
    kind = named.get("warc-type", "").lower()
    stated = named.get("warc-payload-digest")
    stated = stated.split(":", 1)[-1] if stated else None
    size = digest = None
    if kind in ("response", "revisit"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found or not http.startswith(b"HTTP/"):
            http, payload = b"", block
        if kind == "response":
            size = len(payload)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            # A revisit has the response's head; its payload is the earlier one.
            length = dict(_fields(http.split(b"\r\n")[1:])).get("content-length", "")
            size = int(length) if length.isdigit() else None
    return {"record_id": named.get("warc-record-id"), "type": kind,
            "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"],
            "target_uri": named.get("warc-target-uri"),
            "refers_to_uri": named.get("warc-refers-to-target-uri"),
            "payload_digest": digest or stated,
            "digest_holds": None if not (digest and stated) else digest == stated.upper(),
            "payload_bytes": size, "headers": list(named.items()), "block": block}


def parse_stream(lines: Iterator[list[bytes]]) -> Iterator[dict]:
    """Records of a stream of lines (without their ends). A stream that breaks off is an error."""
    head: list[bytes] | None = None
    parts: list[bytes] = []
    have = need = 0
    for chunk in lines:
        for line in chunk:
            if head is not None and need:           # inside a block
                parts += [line, b"\n"]
                have += len(line) + 1
                if have < need:
                    continue
                block = b"".join(parts)
                if block[need:] != b"\r\n":
                    if len(block) - need < 2:       # its closing line ends are still to come
                        continue
                    raise ValueError("a block is longer than its Content-Length")
                yield parse_record(b"\r\n".join(head), block[:need])
                head, parts, have, need = None, [], 0, 0
            elif line.rstrip(b"\r"):
                if head is None:
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"not a WARC record: {line[:40]!r}")
                    head = []
                head.append(line.rstrip(b"\r"))
            elif head is not None:                  # the line after the header
                length = dict(_fields(head[1:])).get("content-length", "")
                if not length.isdigit():
                    raise ValueError("a record has no Content-Length")
                need = int(length)
                if not need:
                    yield parse_record(b"\r\n".join(head), b"")
                    head = None
    if head is not None:
        raise ValueError("an archive breaks off inside a record")


def read_records(spark: SparkSession, path: str, block_types: tuple[str, ...] | None = None
                 ) -> DataFrame:
    """One row per record of all archives in a folder.

    ``block_types`` limits the column ``block`` to records of some types, for callers that need
    no more than sizes and digests of the others.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in parse_stream(b.column("line").to_pylist() for b in batches):
            if block_types is not None and row["type"] not in block_types:
                row["block"] = None
            rows.append(row)
            size += len(row["block"] or b"")
            if size > 4 << 20 or len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([
        ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
        ("target_uri", pa.string()), ("refers_to_uri", pa.string()), ("payload_digest", pa.string()),
        ("digest_holds", pa.bool_()), ("payload_bytes", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("line")).mapInArrow(parsed, RECORD)


def capture_ids(records: DataFrame) -> DataFrame:
    """(record_id, capture): the response or revisit that each record belongs to.

    A request or metadata record may name the response, be named by it, or name a request that
    belongs to one. Of several captures a record takes the one of smallest identifier.
    """
    links = records.select("record_id", "type", F.explode("concurrent_to").alias("other"))
    answers = records.where("type in ('response', 'revisit')").select(
        F.col("record_id").alias("capture")).distinct()
    answers_ = answers.select("capture", F.col("capture").alias("other"))
    named = links.join(answers_, "other").select("record_id", "capture")
    naming = links.where("type in ('response', 'revisit')").select(
        F.col("other").alias("record_id"), F.col("record_id").alias("capture"))
    direct = named.union(naming).groupBy("record_id").agg(F.min("capture").alias("capture"))
    through = (links.where("type = 'metadata'")
               .join(direct.withColumnRenamed("record_id", "other"), "other")
               .select("record_id", "capture"))
    own = answers.select(F.col("capture").alias("record_id"), "capture", F.lit(0).alias("rank"))
    return (own.union(direct.select("*", F.lit(1))).union(through.select("*", F.lit(2)))
            .groupBy("record_id").agg(F.min_by("capture", F.struct("rank", "capture")).alias("capture")))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture, response, request, metadata``.

    ``response`` may be a revisit. Of several records of a kind the one of smallest
    identifier is taken.
    """
    columns = records.columns
    whole = records.join(capture_ids(records), "record_id").withColumn("record", F.struct(*columns))

    def one(condition: str) -> Column:
        return F.min_by("record", F.when(F.expr(condition), F.col("record_id")))

    return whole.groupBy("capture").agg(
        one("type in ('response', 'revisit')").alias("response"),
        one("type = 'request'").alias("request"), one("type = 'metadata'").alias("metadata")
    ).where("response is not null")


def page_id(block: Column) -> Column:
    """The page-id field of a metadata record written by ``write_archives``."""
    found = F.regexp_extract(block.cast("string"), r"(?m)^page-id: (-?\d+)", 1)
    return F.when(found != "", found.cast("long"))

