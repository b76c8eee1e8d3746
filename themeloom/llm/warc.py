"""WARC archives: written with Spark's text sink, read back as a stream of
bytes, and assembled into one nested row per capture."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.plans.scratch import Scratch

CRLF = "\r\n"
# Fixed value: two line breaks end a record; the text sink puts them after each.
RECORD_END = "\r\n\r\n"
# Fixed value of the standard: profile of a revisit with the same payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payloads below this size are always stored in full.
LEAST_BYTES = 100
# Columns of a record as it is read.
RECORD = (
    "type string, record_id string, concurrent_to string, target_uri string, page_id bigint, "
    "refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, fields string"
)
# Bytes of parsed payloads handed on at a time.
BATCH_BYTES = 4 << 20


def fields(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a field whose value is null is left out."""
    lines = [
        F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))
        for name, value in pairs
    ]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def record(kind: Column | str, header: Column, content_type: str, block: Column) -> Column:
    """One record without the two line breaks that end it."""
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        fields(("WARC-Type", kind)),
        header,
        fields(
            ("Content-Type", content_type),
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit(CRLF),
        block,
    )


def one_line(text: Column) -> Column:
    """Header values must not break their line."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def first_copies(pages: DataFrame) -> DataFrame:
    """(payload_digest, first_page, copies) of payloads that occur more than once
    and are long enough to be stored by reference."""
    return (
        pages.filter(F.col("payload_bytes") >= LEAST_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def write_archives(
    pages: DataFrame, path: str, scratch: Scratch, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Writes a request, a response or revisit, and a metadata record per page.

    ``pages`` has (page_id, url, html); other columns are ignored. Null html
    counts as empty, a null url or page_id is left out of the headers. Of equal
    payloads of at least 100 bytes the row with the smallest page_id is the
    response, and the others are revisits that hold no payload; rows that
    repeat that page_id are responses as well, and so are rows without
    page_id. An empty table writes an archive without records.

    Every task writes one gzip file below ``path``.
    """
    text = F.coalesce("html", F.lit("")).alias("html")
    told = pages.select("page_id", "url", text).select(
        "*",
        F.sha2("html", 256).alias("payload_digest"),
        F.octet_length("html").cast("bigint").alias("payload_bytes"),
    )
    first = scratch.keep(first_copies(told), f"firsts-{uuid.uuid4().hex}")
    _write_records(with_first_page(told, first), path, date)


def with_first_page(pages: DataFrame, first: DataFrame) -> DataFrame:
    """Adds ``first_page``, null where the payload is alone or short.

    Pages in any number may share a payload. A digest with more than one
    partition's share of the copies is looked up in a broadcast list, of fewer
    digests than partitions, and its pages are dealt out by page.
    """
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = first.agg(F.coalesce(F.sum("copies"), F.lit(0)) / partitions).first()[0]
    frequent = first.filter(F.col("copies") > share).select(
        F.col("payload_digest").alias("digest"), F.col("first_page").alias("frequent_page")
    )
    others = first.filter(F.col("copies") <= share).select(
        F.col("payload_digest").alias("dealt_by"), F.col("first_page").alias("other_page")
    )
    dealt = F.when(F.col("frequent_page").isNull(), F.col("payload_digest")).otherwise(
        F.concat_ws("-", F.col("payload_digest"), F.xxhash64("page_id", "url").cast("string"))
    )
    near = pages.join(F.broadcast(frequent), F.col("payload_digest") == F.col("digest"), "left")
    return near.withColumn("dealt_by", dealt).join(others, "dealt_by", "left").select(
        *pages.columns, F.coalesce("frequent_page", "other_page").alias("first_page")
    )


def _write_records(pages: DataFrame, path: str, date: str) -> None:
    # Repeated rows are told apart by a number that all records of a row share.
    row = F.monotonically_increasing_id().cast("string")
    rows = pages.withColumn("capture", F.concat_ws("-", F.col("page_id").cast("string"), row))
    revisit = F.coalesce(F.col("page_id") != F.col("first_page"), F.lit(False))
    page = F.col("page_id").cast("string")

    def name(kind: str) -> Column:
        return F.concat(F.lit("<urn:capture:"), F.col("capture"), F.lit(f":{kind}>"))

    uri = one_line(F.col("url"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"),
        fields(
            ("Content-Type", "text/html; charset=utf-8"),
            ("Content-Length", F.col("payload_bytes").cast("string")),
        ),
        F.lit(CRLF),
    )
    request = record(
        "request",
        fields(
            ("WARC-Record-ID", name("request")),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", name("response")),
        ),
        "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    response = record(
        F.when(revisit, "revisit").otherwise("response"),
        fields(
            ("WARC-Record-ID", name("response")),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Profile", F.when(revisit, SAME_PAYLOAD)),
            ("WARC-Refers-To-Page", F.when(revisit, F.col("first_page").cast("string"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ),
        "application/http; msgtype=response",
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    metadata = record(
        "metadata",
        fields(
            ("WARC-Record-ID", name("metadata")),
            ("WARC-Date", date),
            ("WARC-Concurrent-To", name("response")),
        ),
        "application/warc-fields",
        fields(("page-id", page), ("fetched-with", "themeloom")),
    )
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write.mode(
        "overwrite"
    ).option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the gzip archives below ``path``, with the columns of RECORD.

    An archive is read as a stream of chunks between double line breaks and cut
    by Content-Length, so a task holds one record and not a file. A gzip file
    is never split, so each begins with a record. The digest of a response is
    taken from its bytes, that of a revisit from its header; ``payloads=False``
    leaves the bytes out. An archive that ends inside a record raises.
    """
    chunks = (
        spark.read.option("lineSep", RECORD_END)
        .text(path)
        .select(F.col("value").cast("binary").alias("chunk"), F.input_file_name().alias("file"))
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for header, block in split_records(stream(batches)):
            found = parsed(header, block, payloads)
            rows.append(found)
            size += len(block)
            if size > BATCH_BYTES or len(rows) >= 10_000:
                yield to_batch(rows)
                rows, size = [], 0
        if rows:
            yield to_batch(rows)

    return chunks.mapInArrow(parse, RECORD)


ARROW = pa.schema(
    [
        ("type", pa.string()),
        ("record_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("target_uri", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("fields", pa.string()),
    ]
)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for file, chunk in zip(batch.column(1), batch.column(0), strict=True):
            yield file.as_py(), chunk.as_py()


def split_records(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks; what was cut at double line breaks is put together again."""
    end = RECORD_END.encode()
    file, chunk = next(chunks, ("", None))
    while chunk is not None:
        # A block that ends in a line break shifts the cuts by it, so the next
        # header comes after line breaks, or in the same chunk as the block's end.
        lines = chunk.lstrip(b"\r\n").decode("utf-8").split(CRLF)
        if lines == [""]:
            file, chunk = next(chunks, ("", None))
            continue
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{file}: no record begins at {lines[0][:40]!r}")
        header = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        length = int(header["content-length"])
        parts: list[bytes] = []
        held = -len(end)
        while held < length:
            source, part = next(chunks, ("", None))
            if part is None or source != file:
                if parts and not part and held + len(end) >= length:
                    break
                raise ValueError(f"{file}: the archive ends inside a record")
            parts.append(part)
            held += len(end) + len(part)
        block = end.join(parts) + end
        yield header, block[:length]
        if rest := block[length:].strip(b"\r\n"):
            chunk = rest
        else:
            file, chunk = next(chunks, ("", None))


def parsed(header: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = header.get("warc-type")
    digest = size = payload = page = told = None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(RECORD_END.encode())
        if kind == "response":
            payload, digest, size = body, hashlib.sha256(body).hexdigest(), len(body)
        else:
            digest = header.get("warc-payload-digest", "").removeprefix("sha256:") or None
            sizes = [x for x in head.decode().split(CRLF) if x.lower().startswith("content-length:")]
            size = int(sizes[0].partition(":")[2]) if sizes else None
    elif kind == "metadata":
        told = block.decode("utf-8")
        pages = [x for x in told.split(CRLF) if x.startswith("page-id: ")]
        page = int(pages[0].partition(": ")[2]) if pages else None
    refers = header.get("warc-refers-to-page")
    return (
        kind,
        header.get("warc-record-id"),
        header.get("warc-concurrent-to"),
        header.get("warc-target-uri"),
        page,
        int(refers) if refers else None,
        digest,
        size,
        payload if payloads else None,
        told,
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id and the structs request, response
    and metadata (null where there is none).

    Requests and metadata name the response or revisit they are concurrent to.
    The three meet in one shuffle on that name, which only a capture's own
    records share; of records that repeat a name and type the smallest
    record_id counts. Records of other types and without any name are left out.
    """
    kinds = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    whole = F.struct(*records.columns)
    anchored = records.filter(F.col("type").isin([k for group in kinds.values() for k in group])).select(
        F.when(F.col("type").isin(kinds["response"]), F.col("record_id"))
        .otherwise(F.coalesce("concurrent_to", "record_id"))
        .alias("capture_id"),
        "type",
        whole.alias("record"),
    )
    return (
        anchored.filter("capture_id IS NOT NULL")
        .groupBy("capture_id")
        .agg(
            *[
                F.min_by(F.when(F.col("type").isin(types), F.col("record")),
                         F.when(F.col("type").isin(types), F.col("record.record_id"))).alias(name)
                for name, types in kinds.items()
            ]
        )
    )
