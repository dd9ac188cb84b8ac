"""Content-addressed WARC archive.

Two tables make an archive: ``headers`` has each record's header, byte for byte, and the digest of its payload;
``payloads`` has each payload once, filed by its SHA-256. Reading joins them, computes each payload's digest again, and
fails on a payload that doesn't have the digest it is filed under, so equal digests stand for equal bytes. A record is its
header, an empty line, its block (the payload, or nothing for a revisit) and two line ends.

``export`` writes such records as .warc files, packed by gzip, and ``read_warc`` reads them back, record by record, by the
lengths in their headers. ``report`` does all of it: archive, records by the join, files, and what the parsed headers and
blocks say. Records are exported by classes of size, so that no file has more than ``FILE_BYTES`` unless one record has.

Among records with equal payloads of ``MIN_BYTES`` or more, the one with the smallest page_id is a response, and the
others revisit it. Both tables are dealt by digest; only ids and digests move before that, so a payload that many
pages share is written once by each task that meets it at most. Records of short payloads, which may all be equal, meet
them in ``SALTS`` parts; revisits need no payload.

Defined cases: a null html is an empty payload; rows with the smallest page_id are all responses; a null page_id counts as larger
than any other, and equal payloads with null ids only are all responses; a null url is an empty target; an empty table
gives an empty archive; other columns are dropped.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.storage import fresh_path, stored

MIN_BYTES = 100
SALTS = 16
FILE_BYTES = 256 << 20
#: Upper ends of the classes of payload sizes; larger payloads have a file each.
SIZES = (64 << 10, 1 << 20, 32 << 20)
BATCH_BYTES = 16 << 20
EOL = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: Column) -> Column:
    """A UUID of the free version 8 that holds the page's id in its first 16 free digits; null has another last digit."""
    h = F.lower(F.lpad(F.hex(F.coalesce(page_id.cast("long"), F.lit(0))), 16, "0"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 13, 3)), F.concat(F.lit("8"), F.substring(h, 16, 1), F.lit("00"))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts, F.when(page_id.isNull(), "000000000001").otherwise("000000000000")), F.lit(">"))


def page_of(record: Column) -> Column:
    """The id in a ``record_id``; null for that of a null, and for an empty text."""
    digits = F.regexp_extract(record, "<urn:uuid:([0-9a-f-]*)0>", 1)
    h = F.concat(F.substring(digits, 1, 8), F.substring(digits, 10, 4), F.substring(digits, 16, 3), F.substring(digits, 21, 1))
    return F.when(digits != "", F.conv(h, 16, -10).cast("long"))


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, bytes, digest, response): what each page's record will be; response is null where it is its own."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    first = rows.where(F.col("bytes") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    joined = rows.join(first.select("digest", "first"), "digest", "left")
    return joined.select("page_id", "url", "bytes", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("response"))


def header() -> Column:
    """The header of a planned record."""
    revisit = F.col("response").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("response")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat_ws(EOL, *lines)


def write(pages: DataFrame) -> str:
    """Write an archive of ``pages`` (page_id, url, html) and return its place."""
    path = fresh_path(pages.sparkSession, "archive")
    planned(pages).select("page_id", "response", "bytes", "digest", header().alias("header")).write.parquet(f"{path}/headers")
    payload = F.coalesce(F.col("html"), F.lit(""))
    filed = pages.select(F.sha2(payload.cast("binary"), 256).alias("digest"), payload.alias("payload"))
    once = filed.groupBy("digest").agg(F.any_value("payload").alias("payload"))
    once.withColumn("bytes", F.octet_length("payload").cast("long")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def checked(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, bytes): the archive's payloads, each with the digest that it has."""
    payloads = spark.read.parquet(f"{path}/payloads")
    true_digest = F.sha2(F.col("payload").cast("binary"), 256)
    wrong = F.raise_error(F.concat(F.lit("payload isn't what it is filed under: "), F.col("digest")))
    return payloads.withColumn("digest", F.when(true_digest == F.col("digest"), true_digest).otherwise(wrong))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, digest, refers_to, payload): the archived records, with the full payload also where they revisit another."""
    headers = spark.read.parquet(f"{path}/headers").drop("bytes")
    return headers.join(checked(spark, path), "digest").select("page_id", "header", "digest", F.col("response").alias("refers_to"), "payload")


def records(spark: SparkSession, path: str, above: int = -1, up_to: int = 2**62) -> DataFrame:
    """(header, payload): the archived records whose payloads have more than ``above`` bytes, but no more than ``up_to``; revisits without it."""
    within = (F.col("bytes") > above) & (F.col("bytes") <= up_to)
    headers = spark.read.parquet(f"{path}/headers").where(within)
    short = F.col("bytes") < MIN_BYTES
    own = headers.where("response IS NULL").select("digest", "header", F.when(short, F.pmod(F.xxhash64("header"), F.lit(SALTS))).otherwise(0).alias("salt"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.when(short, SALTS - 1).otherwise(0).cast("long")))
    payloads = checked(spark, path).where(within).select("digest", "payload", salts.alias("salt"))
    responses = own.join(payloads.hint("merge"), ["digest", "salt"]).select("header", "payload")
    return responses.unionByName(headers.where("response IS NOT NULL").select("header", F.lit("").alias("payload")))


def field(name: str) -> Column:
    """A field of a header, whose lines end with CR and LF only: other characters that end lines elsewhere are parts of a value. (Without d, $ and . know them too.)"""
    return F.regexp_extract("header", rf"(?md)^{name}: (.*?)\r?$", 1)


def export(records: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """Write archived records (header, payload) as WARC text in .gz files; the writer's line separator is the end of a record."""
    block = F.when(field("WARC-Type") == "revisit", "").otherwise(F.col("payload"))
    lines = records.select(F.concat(F.col("header"), F.lit(EOL + EOL), block).alias("value"))
    lines.write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def export_archive(spark: SparkSession, archive: str, path: str) -> list[str]:
    """Write all records of an archive into folders below ``path``, and return these: one for each class of sizes that occurs."""
    most = spark.read.parquet(f"{archive}/headers").agg(F.max("bytes")).first()[0]
    folders, above = [], -1
    for size in (*SIZES, 2**62):
        if most is None or most <= above:
            break
        folders.append(f"{path}/{above + 1}")
        export(records(spark, archive, above, size), folders[-1], max(1, FILE_BYTES // (size + 4096)))
        above = size
    return folders


def report(pages: DataFrame) -> DataFrame:
    """One row per page, from the records in the archive's files."""
    spark = pages.sparkSession
    archive = write(pages)
    folders = export_archive(spark, archive, f"{archive}/warc")
    none = spark.createDataFrame([], "header string, block binary")
    blocks = read_warc(spark, *folders) if folders else none
    said = F.substring_index(field("WARC-Payload-Digest"), ":", -1)
    true = F.when(F.sha2("block", 256) == said, said).otherwise(F.raise_error(F.concat(F.lit("block without its digest: "), F.col("header"))))
    revisit = field("WARC-Type") == "revisit"
    parsed = blocks.select(
        page_of(field("WARC-Record-ID")).alias("page_id"),
        F.octet_length("block").cast("long").alias("bytes"),
        F.when(revisit, said).otherwise(true).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(revisit, page_of(field("WARC-Refers-To"))).alias("refers_to"),
    )
    parsed = stored(parsed, "parsed")
    # a revisit's payload is that of the record it refers to, and has to have the same digest
    wanted = parsed.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count("*").alias("n"))
    full = parsed.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("full_digest"), F.col("bytes").alias("full_bytes")).distinct()
    full = full.join(wanted.hint("merge"), "refers_to", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = salted.where("record_type = 'revisit'").join(
        full.withColumnRenamed("full_digest", "payload_digest").hint("merge"), ["refers_to", "payload_digest", "salt"], "left"
    )
    missing = F.raise_error(F.concat(F.lit("nothing to revisit for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = revisits.withColumn("payload_bytes", F.coalesce("full_bytes", missing.cast("long")))
    return found.select(*columns).unionByName(parsed.where("record_type = 'response'").withColumnRenamed("bytes", "payload_bytes").select(*columns))


def read_warc(spark: SparkSession, *paths: str) -> DataFrame:
    """(header, block) of every record of the .warc.gz files in ``paths``, cut by their lengths; a batch has about ``BATCH_BYTES``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                headers, blocks, size = [], [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as data:
                    while head := b"".join(iter(lambda: line if (line := data.readline()) != b"\r\n" else b"", b"")):
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        headers.append(head[:-2].decode())
                        blocks.append(data.read(length))
                        data.read(4)
                        size += length
                        if size > BATCH_BYTES:
                            yield record_batch(headers, blocks)
                            headers, blocks, size = [], [], 0
                yield record_batch(headers, blocks)

    def record_batch(headers: list[str], blocks: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(blocks, pa.binary())], ["header", "block"])

    files = spark.read.format("binaryFile").load(list(paths)).select("content")
    return files.mapInArrow(parse, "header string, block binary")
