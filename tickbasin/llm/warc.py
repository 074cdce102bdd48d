"""WARC archives with revisit resolution.

Each record is a gzip member of its own, as readers of such archives expect.
Tasks compress the records of the rows that they read, so payloads are not
moved, and Spark's text writer stores the members: the last byte of a member is
the high byte of its length, 0 below 16 MiB, and is written as the separator of
"lines".  So any file system that Spark reaches will do.  Records of similar
size go to files together, so many to a file that it stays below FILE_BYTES.
A record's block is an HTTP response whose payload is the page.  Reading parses
members one after the other by Content-Length, so payloads may hold anything.

Deduplication groups headers only: by payload digest and length, the smallest
page of each group is the original, and the other records are joined to it and
written as revisits with fresh headers and no payload.  While the originals that
have copies are few enough to broadcast, payloads stay where they were read;
beyond that this join shuffles them, and AQE splits its skewed partitions.

What a reader learns of a payload is recomputed from the stored bytes, and of a
revisit from its response's.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fewest_partitions, join_sized, kept, shared_path, workspace, written

#: Payload bytes from which equal payloads become revisits.
LEAST_BYTES = 100
#: Bytes of an archive file before compression, at most, unless it holds one record.
FILE_BYTES = 64 << 20
#: Payload bytes below which records share files with others down to the bound before.
SIZES = (4 << 10, 64 << 10, 1 << 20, 16 << 20)
#: Bytes of a record for its headers, about; bytes of a gzip member before compression; copies of a row written by one task.
HEADERS, MEMBER, COPIES = 1 << 10, 15 << 20, 10_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line ends in the value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def record(rows: DataFrame) -> DataFrame:
    """The text of a record of each row: page_id, url, html, digest, payload_bytes, record, refers_to, refers_url, refers_record, is_revisit."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    revisit = F.col("is_revisit")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record", F.lit(">"))),
        header("Page-ID", F.col("page_id").cast("string")),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("WARC-Profile", F.when(revisit, PROFILE)),
        header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), "refers_record", F.lit(">")))),
        header("Refers-To-Page-ID", F.when(revisit, F.col("refers_to").cast("string"))),
        header("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_url"))),
        header("WARC-Refers-To-Date", F.when(revisit, DATE)),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return rows.select(F.encode(F.concat(head, block, F.lit(END + END)), "UTF-8").alias("value"))


def record_id(archive_id: str, page_id: Column, digest: Column, rank: Column) -> Column:
    """The name of a record: of one archive no two are equal, and of two archives neither."""
    of = F.md5(F.concat_ws("|", F.lit(archive_id), page_id.cast("string"), digest, rank.cast("string")))
    return F.regexp_replace(of, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member (several, if it is longer than MEMBER) without its last byte, which is 0."""
    for batch in batches:
        out = []
        for value in batch["value"]:
            data = value.as_py()
            members = b"".join(gzip.compress(data[at : at + MEMBER], 6, mtime=0) for at in range(0, len(data), MEMBER))
            out.append(members[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def size_class(payload_bytes: Column) -> Column:
    """Place in SIZES of the first bound above a payload."""
    return sum(((payload_bytes >= bound).cast("int") for bound in SIZES), F.lit(0))


def write_archives(rows: DataFrame, path: str, classes: list[int]) -> None:
    """Writes records into files of at most FILE_BYTES, before compression; a job for each class of sizes."""
    for k in classes or [0]:
        per_file = max(1, FILE_BYTES // (SIZES[k] + HEADERS)) if k < len(SIZES) else 1
        members = record(rows.where(size_class(F.col("payload_bytes")) == k)).mapInArrow(compressed, "value binary")
        raw = members.select(F.col("value").cast("string").alias("value"))
        raw.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(f"{path}/size-{k}")


def parse(buffer: bytearray, whole: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Takes headers and block of every complete record out of the buffer; what is left is an error if it should be whole."""
    while buffer:
        end = buffer.find(b"\r\n\r\n")
        if buffer[:5] != b"WARC/"[: len(buffer)]:
            raise ValueError("no record where one should begin")
        if end < 0:
            break
        heads = dict(line.split(": ", 1) for line in buffer[:end].decode("utf-8", "surrogatepass").split(END)[1:])
        start = end + 4
        stop = start + int(heads["Content-Length"])
        if len(buffer) < stop + 4:
            break
        if buffer[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record has no end")
        yield heads, bytes(buffer[start:stop])
        del buffer[: stop + 4]
    if whole and buffer:
        raise ValueError("a record is cut off")


def records(content: bytes, block: int = 1 << 14) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive file, inflated one member after the other."""
    view, at, buffer = memoryview(content), 0, bytearray()
    while at < len(view):
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            buffer += inflate.decompress(view[at : at + block])
            at += block
        at = min(at, len(view)) - len(inflate.unused_data)
        yield from parse(buffer, whole=False)
    yield from parse(buffer)


def read_archives(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "long") -> DataFrame:
    """Every record of the archives: page_id, url, record_type, record_id, refers_record, digest, payload_bytes, refers_to, stored_bytes, ok and, if asked, html.

    Digest and length are those of the stored payload, of revisits, which store
    none, those that their headers claim.  ok: a stored payload agrees with its
    headers.  A task holds one file, of FILE_BYTES at most, and a few records
    of it.
    """

    def row(heads: dict[str, str], content: bytes) -> tuple:
        http, _, payload = content.partition(b"\r\n\r\n")
        said, kind = heads["WARC-Payload-Digest"].removeprefix("sha256:"), heads["WARC-Type"]
        length = int(http.rsplit(b"Content-Length: ", 1)[1])
        digest, n = (said, length) if kind == "revisit" else (hashlib.sha256(payload).hexdigest(), len(payload))
        names = [heads.get(h, "").removeprefix("<urn:uuid:").removesuffix(">") or None for h in ("WARC-Record-ID", "WARC-Refers-To")]
        return (heads.get("Page-ID"), heads.get("WARC-Target-URI"), kind, *names, digest, n, heads.get("Refers-To-Page-ID"), len(payload), (said, length) == (digest, n), *[payload.decode("utf-8", "replace")] * payloads)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "record_type", "record_id", "refers_record", "digest", "payload_bytes", "refers_to", "stored_bytes", "ok", *["html"] * payloads]
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for heads, block in records(content):
                    out.append(row(heads, block))
                    held += len(block) * payloads + 1000
                    if held > 16 << 20:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
                yield pd.DataFrame(out, columns=columns)

    schema = "page_id string, url string, record_type string, record_id string, refers_record string, digest string, payload_bytes long, refers_to string, stored_bytes long, ok boolean" + ", html string" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(rows, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolved_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Every record, with digest and length of the payload that is stored for it: a revisit has those of its response.

    A payload that disagrees with its headers, a revisit without its response
    and one whose headers claim another payload raise when the rows are read.
    Headers only are kept and joined; a response that most records revisit is
    looked up once for all of them.
    """
    heads = kept(read_archives(spark, path, id_type=id_type).drop("stored_bytes"), "records")
    wanted = heads.where("record_type = 'revisit'").select(F.col("refers_record").alias("named")).distinct()
    stored = heads.where("record_type = 'response'").select(F.col("record_id").alias("named"), F.col("digest").alias("stored_digest"), F.col("payload_bytes").alias("stored_length"))
    found = kept(stored.join(wanted, "named"), "responses")
    rows = join_sized(heads.withColumnRenamed("refers_record", "named"), found, "named", "left")
    revisit = F.col("record_type") == "revisit"
    kept_whole = F.col("ok") & (~revisit | F.coalesce((F.col("stored_digest") == F.col("digest")) & (F.col("stored_length") == F.col("payload_bytes")), F.lit(False)))
    broken = F.raise_error(F.concat(F.lit("the archive's record "), F.coalesce("record_id", F.lit("without a name")), F.lit(" does not hold or find its payload"))).cast("string")
    digest = F.when(~kept_whole, broken).when(revisit, F.col("stored_digest")).otherwise(F.col("digest"))
    return rows.select("page_id", "url", "record_type", digest.alias("digest"), F.when(revisit, F.col("stored_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "refers_to")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Writes deduplicated archives of the pages to path.

    Of records with equal payloads of at least least_bytes bytes, the one with
    the smallest page id is the response and the others revisit it; smaller
    payloads, and pages with a null id, are responses.  Null html is an empty
    payload, a null url has no target header; repeated ids with equal payloads
    are one response, of the first url, and revisits of it; very long payloads
    are a file of their own; ids may be of any type; other columns are not
    read; an empty table gives an archive of no records.
    """
    spark, name = pages.sparkSession, uuid.uuid4().hex
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    full = base.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "payload_bytes": F.octet_length("html").cast("long")})
    with workspace(spark):
        # headers only: no payload is shuffled here
        heads, _ = written(full.select("page_id", "url", "digest", "payload_bytes"), "headers")
        classes = sorted(r.k for r in heads.select(size_class(F.col("payload_bytes")).alias("k")).distinct().collect())
        many = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "payload_bytes")
        groups = many.agg(F.min(F.struct("page_id", "url")).alias("original"), F.count("*").alias("copies")).where("copies > 1")
        groups, _ = written(groups.select("digest", "original"), "originals")
        resolved = join_sized(full, groups, "digest", "left").withColumn("rank", F.lit(1).cast("long"))
        twins, _ = written(heads.groupBy("page_id", "digest").count().where("count > 1").select("page_id", "digest", F.lit(True).alias("twin")), "repeated-pages")
        if twins.limit(1).count():
            # repeated pages are counted before they are shuffled, and their copies dealt to tasks again
            twins = twins.withColumnsRenamed({"page_id": "twin_id", "digest": "twin_digest"})
            met = join_sized(resolved, twins, F.col("page_id").eqNullSafe(F.col("twin_id")) & (F.col("digest") == F.col("twin_digest")), "left")
            few = met.where("twin").groupBy("page_id", "url", "digest", "payload_bytes", "original").agg(F.count("*").alias("n"), F.first("html").alias("html"))
            before = F.sum("n").over(Window.partitionBy("page_id", "digest").orderBy("url").rowsBetween(Window.unboundedPreceding, -1))
            few = few.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(COPIES).cast("long"))))
            few, _ = written(few, "repeated-rows")
            few = few.repartition(fewest_partitions(few.count(), 10))
            few = few.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (COPIES - 1), F.col("n"))))).withColumn("rank", F.col("before") + F.col("k"))
            resolved = met.where("twin is null").select(resolved.columns).unionByName(few.select(resolved.columns))
        first = F.col("original.page_id")
        revisit = first.isNotNull() & F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~((F.col("page_id") == first) & (F.col("rank") == 1))
        rows = resolved.select(
            "page_id", "url", "html", "digest", "payload_bytes", record_id(name, F.col("page_id"), F.col("digest"), F.col("rank")).alias("record"), first.alias("refers_to"),
            F.col("original.url").alias("refers_url"), record_id(name, first, F.col("digest"), F.lit(1)).alias("refers_record"), F.coalesce(revisit, F.lit(False)).alias("is_revisit"),
        )
        write_archives(rows, path, classes)


def round_trip(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Archives the pages in the shared folder, reads the records back and checks their payloads.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and
    url, one row per page; see archive() for the cases.
    """
    path = shared_path(pages.sparkSession, "warc")
    archive(pages, path, id_col, **columns)
    back = resolved_records(pages.sparkSession, path, pages.schema[id_col].dataType.simpleString())
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url")
