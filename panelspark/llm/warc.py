"""WARC: write archives of captures, read archives, and assemble their records into transactions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

END = "\r\n\r\n"
#: An archive holds FILE_BYTES of records on average, and RECORDS_PER_FILE records at most.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 3000
#: The time of capture in records of pages that have none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Hops from a record over others to its capture.
HOPS = 16
RECORD = "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, block_bytes long, payload_bytes long, payload_digest string, declared_digest string, fields map<string,string>, payload binary"


def _line(name: str, value) -> F.Column:
    """A header line; absent where the value is null. Control characters, which would end it, become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def _uri(url: F.Column) -> F.Column:
    """url with white space and control characters, which a header line can't hold, as percent codes."""
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(url)


def capture_records(pages: DataFrame, revisit_bytes: int = 100, date: str = NO_DATE) -> DataFrame:
    """Rows (page_id, url, html) to WARC records in a column value: request, response or revisit, and metadata.

    Of captures with equal payloads (SHA-256) of at least revisit_bytes, that with the smallest page_id is a response
    and the others revisit it, with their headers alone. Payload: html in UTF-8, null as empty. A null page_id is
    named by its place alone, never referred to, and never a revisit; of repeated rows of the smallest page_id all are
    responses. A null url gives no WARC-Target-URI; in others, white space and control characters are percent-encoded.
    date: the records' WARC-Date. Other columns are left out.
    """
    page = pages.select("page_id", _uri(F.col("url").cast("string")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    repeated = page.where(f"n >= {revisit_bytes}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null").drop("copies")
    page = page.join(broadcast_if_small(materialize(repeated, "repeated"), 200_000), "digest", "left")
    revisit = F.coalesce((F.col("n") >= revisit_bytes) & (F.col("page_id") != F.col("first")), F.lit(False))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null-"), F.monotonically_increasing_id())))
    ident = lambda kind, of=name: F.concat(F.lit("<"), of, F.lit(f":{kind}>"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    head = lambda what, uid, *lines: F.concat(F.lit("WARC/1.1\r\n"), _line("WARC-Type", what), _line("WARC-Record-ID", uid), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")), *lines)
    ends = lambda block, kind: F.concat(_line("Content-Type", F.lit(kind)), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)
    asked = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1)
    asked = F.when(asked.startswith("/"), asked).otherwise(F.concat(F.lit("/"), F.coalesce(asked, F.lit(""))))
    request = F.concat(F.lit("GET "), asked, F.lit(" HTTP/1.1\r\n"), _line("Host", F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)), F.lit("\r\n"))
    about = F.concat(_line("pageId", F.col("page_id")), _line("payloadBytes", F.col("n")))
    response = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    of_response = _line("WARC-Concurrent-To", ident("capture"))
    records = F.array(
        F.concat(head(F.lit("request"), ident("request"), of_response), ends(request, "application/http;msgtype=request")),
        F.concat(
            head(kind, ident("capture"), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))),
            F.when(revisit, F.concat(_line("WARC-Refers-To", ident("capture", F.concat(F.lit("urn:page:"), F.col("first").cast("string")))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
            ends(response, "application/http;msgtype=response"),
        ),
        F.concat(head(F.lit("metadata"), ident("metadata"), of_response), ends(about, "application/warc-fields")),
    )
    return page.select(F.explode(records).alias("value"))


def write_warc(records: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """Writes .gz archives with Spark's text sink, whose line end is that of a record.

    records_per_file: by default as many as FILE_BYTES hold on average, for an archive is read by one task.
    """
    if records_per_file is None:
        mean = records.agg(F.avg(F.octet_length("value"))).first()[0] or 1
        records_per_file = max(3, min(RECORDS_PER_FILE, int(FILE_BYTES // mean)))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Source:
    """Bytes of a gzip file (any number of members), decompressed as far as they are asked for."""

    def __init__(self, content: bytes) -> None:
        self.rest, self.z, self.have = content, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while self.rest:
            out = self.z.decompress(self.rest, 1 << 20)
            self.rest = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if out:
                self.have += out
                return True
        out = self.z.flush()
        self.have += out
        return bool(out)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """Header fields (names in lower case), all values of WARC-Concurrent-To, and block of each record.

    A file that ends inside a record is an error.
    """
    src = _Source(content)
    at = 0
    while True:
        while (end := src.have.find(b"\r\n\r\n", at)) < 0:
            if not src.more():
                if src.have[at:].strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        version, *lines = src.have[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        fields = dict(pairs)
        start = end + 4
        stop = start + int(fields["content-length"])
        while len(src.have) < stop + 4 and src.more():
            pass
        if len(src.have) < stop:
            raise ValueError("the archive ends inside a record's block")
        yield fields, [v for k, v in pairs if k == "warc-concurrent-to"], src.have[start:stop]
        at = stop + 4
        if at > 1 << 20:
            src.have, at = src.have[at:], 0


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORD, one for each record of the .gz archives below path; payload is null unless asked for.

    An http response's payload is its block past the http header; any other record's is its block. An archive is
    read by one task, so archives are to be written with bounded numbers of records.
    """
    import hashlib

    schema = spark.createDataFrame([], RECORD).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for content in batch.column(0):
                for f, linked, block in parse_records(content.as_py()):
                    kind, body = f.get("warc-type"), block
                    if f.get("content-type", "").startswith("application/http"):
                        body = block.partition(b"\r\n\r\n")[2]
                    more = {}
                    if kind == "metadata":
                        more = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
                    rows.append({
                        "record_id": f.get("warc-record-id"), "record_type": kind, "concurrent_to": linked, "refers_to": f.get("warc-refers-to"), "target_uri": f.get("warc-target-uri"),
                        "block_bytes": len(block), "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "declared_digest": (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                        "fields": list(more.items()), "payload": body if payloads else None,
                    })
                    held += len(body) * payloads + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, schema)


def _captures_of(records: DataFrame) -> DataFrame:
    """(record_id, capture_id): the captures that each request, metadata or other record belongs to.

    Links through concurrent-to are followed from record to record until they meet a capture, and a capture's own links
    backwards; a record may belong to several captures. A chain of more than HOPS records is an error.
    """
    heads = materialize(records.select("record_id", "record_type", "concurrent_to").where("record_id is not null"), "heads")
    is_capture = F.col("record_type").isin("response", "revisit")
    captures = heads.where(is_capture).select(F.col("record_id").alias("target")).distinct()
    links = heads.select("record_id", is_capture.alias("capture"), F.explode("concurrent_to").alias("target"))
    forward = links.where("not capture").select("record_id", "target")
    links = materialize(forward.unionByName(links.where("capture").select(F.col("target").alias("record_id"), F.col("record_id").alias("target"))).distinct(), "links")
    found = links.join(captures, "target", "left_semi")
    pending = materialize(links.join(captures, "target", "left_anti"), "pending")
    seen = pending
    for _ in range(HOPS):
        if not pending.limit(1).count():
            return found.select("record_id", F.col("target").alias("capture_id")).distinct()
        onward = pending.join(links.select(F.col("record_id").alias("target"), F.col("target").alias("next")), "target").select("record_id", F.col("next").alias("target")).distinct()
        onward = materialize(onward.where("record_id <> target"), "onward")
        found = found.unionByName(onward.join(captures, "target", "left_semi"))
        pending = materialize(onward.join(captures, "target", "left_anti").join(seen, ["record_id", "target"], "left_anti"), "pending")
        seen = seen.unionByName(pending)
    raise ValueError(f"concurrent records are linked over more than {HOPS} records")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture struct, requests array, metadata array, others array.

    Request, metadata and other records join the response or revisit that their concurrent-to leads to, directly or over
    other records. Captures without any have empty arrays; records that lead to no capture, and those without an id, are
    left out. A record that was written twice under one id counts once among its capture's, but a capture twice.
    """
    captures = F.col("record_type").isin("response", "revisit")
    part = F.struct("record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "declared_digest", "fields", "payload", "record_type")
    named = records.where("record_id is not null")
    own = named.where(captures).select(F.col("record_id").alias("capture_id"), part.alias("part"))
    joined = named.where(~captures).join(_captures_of(records), "record_id").select("capture_id", part.alias("part"))

    def of(kind: F.Column) -> F.Column:
        all_ = F.collect_list(F.when(kind, F.col("part")))
        return F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y["record_id"]), x["record_id"]) == i + 1)

    kind = F.col("part.record_type")
    grouped = own.unionByName(joined).groupBy("capture_id").agg(
        F.collect_list(F.when(kind.isin("response", "revisit"), F.col("part"))).alias("captures"), of(kind == "request").alias("requests"),
        of(kind == "metadata").alias("metadata"), of(~kind.isin("response", "revisit", "request", "metadata")).alias("others"),
    )
    return grouped.select("capture_id", F.explode("captures").alias("capture"), "requests", "metadata", "others")
