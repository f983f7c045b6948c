"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: tasks append one gzip member per record to their own archive and return an index row per record
(archive, offset, length, URL, digest). The name of an archive holds the task attempt, and only
archives of attempts whose index rows were kept are ever read, so a retried task does no harm.

Reading: the index comes first. Selected records are sorted by place and joined into ranges (small
gaps are read along), and each range is one seek and one read.

Of records with the same payload the one with the smallest id is a response, the others are revisits
that refer to it by id and have no payload; with ``min_bytes`` over 0 smaller payloads are all responses.

Defined results: a null payload is empty. Rows that share the smallest id and the payload are all
responses. A null id counts as larger than all others. Line breaks in a URL are percent-coded; a null URL leaves the header out. An
empty table writes no archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.llm.common import query, table
from textguard.session import durable, filesystem, scratch_folder

INDEX = "archive string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string"
RANGE_BYTES = 8 << 20
RANGE_GAP = 64 << 10
RECORD_DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with an empty block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        headers.append(f"Page-ID: {page_id}")
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        headers.append(f"WARC-Target-URI: {clean}")
    if revisit:
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        headers.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        headers.append(f"Refers-To-Page-ID: {refers_to}")
        headers.append(f"Payload-Length: {len(payload)}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def digests(pages: DataFrame) -> DataFrame:
    """Add ``digest`` (SHA-1, base 32) and ``payload_bytes``; the payload itself stays in the JVM."""
    payload = F.coalesce("html", F.lit("")).cast("binary")

    @F.pandas_udf("string")
    def base32(hexes: pd.Series) -> pd.Series:
        return hexes.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode()).astype(object)

    return pages.withColumns({"digest": base32(F.sha1(payload)), "payload_bytes": F.octet_length(payload).cast("bigint")})


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the revisits: pages with the payload of a page of smaller id."""
    light = digests(pages.select("page_id", "html")).select("page_id", "digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        light.join(first.drop("n"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages (page_id, url, html)`` as archives below ``folder`` (a URI); returns the index."""
    pages = pages.select("page_id", "url", "html")
    revisits = decide(pages, min_bytes).withColumnRenamed("page_id", "_id").withColumnRenamed("digest", "_digest")
    keyed = digests(pages).drop("payload_bytes")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    records = keyed.join(revisits, same, "left").select("page_id", "url", "html", "digest", "refers_to")

    def append(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in batch.itertuples(index=False, name=None):
                page_id = None if pd.isna(page_id) else int(page_id)
                refers_to = None if pd.isna(refers_to) else int(refers_to)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record_bytes(page_id, url, (html or "").encode(), digest, refers_to)) + pack.flush()
                if out is None:
                    files, path = filesystem(uri)
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                out.write(data)
                rows.append((uri, offset, len(data), page_id, url, digest, "response" if refers_to is None else "revisit"))
                offset += len(data)
            frame = pd.DataFrame(rows, columns=["archive", "offset", "length", "page_id", "url", "digest", "record_type"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return durable(records.mapInPandas(append, INDEX))


def ranges(index: DataFrame, range_bytes: int = RANGE_BYTES, gap: int = RANGE_GAP) -> DataFrame:
    """Selected index rows as ``archive, start, stop, records``: sorted, and joined where a gap is small.

    A range ends at each multiple of ``range_bytes``, so it is bounded also in a very large archive.
    """
    cell = (F.col("offset") / range_bytes).cast("bigint")
    placed = index.select("archive", cell.alias("cell"), "offset", "length")
    in_cell = Window.partitionBy("archive", "cell").orderBy("offset")
    far = F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(in_cell) + gap
    runs = placed.withColumn("run", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(in_cell.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("archive", "cell", "run").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    )


READ = (
    "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, block binary"
)


def read(index: DataFrame, with_block: bool = True) -> DataFrame:
    """Records of the selected index rows, from the archives' bytes; a digest that does not fit is an error."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, start, stop, records in zip(batch["archive"], batch["start"], batch["stop"], batch["records"], strict=True):
                files, path = filesystem(archive)
                with files.open_input_file(path) as source:
                    source.seek(start)
                    data = source.read(stop - start)
                rows = []
                for record in records:
                    at = record["offset"] - start
                    headers, block = parse_record(zlib.decompress(data[at : at + record["length"]], 31))
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and payload_digest(block) != digest:
                        raise ValueError(f"damaged record at {archive}:{record['offset']}")
                    size = len(block) if kind == "response" else int(headers["Payload-Length"])
                    page, target = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
                    rows.append((page and int(page), headers.get("WARC-Target-URI"), kind, digest, size, target and int(target), block if with_block else None))
                columns = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "block"]
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    wanted = ranges(index)
    return wanted.select("archive", "start", "stop", "records").mapInPandas(fetch, READ)


@query("op6_warc_index")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    index = write(table(spark, folder, "pages", "page_id", "url", "html"), scratch_folder(spark, "warc"))
    return read(index, with_block=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
