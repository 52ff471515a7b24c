"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

Reading cuts files at the magic of a record, so that Spark can split them anywhere. Every piece after a magic is a
candidate: its header gives the offset of its successor. Pointer jumping from offset 0 of each file keeps the candidates
that a chain of successors reaches; a magic inside a payload starts none, however much it looks like a record. Payloads that
hold a magic are put together again from their pieces. A record that ends beyond its file ends the chain.

Writing: a null html is an empty payload. Of equal payloads of at least `LEAST` bytes the one with the smallest page_id is a
response and the others revisit it; rows that repeat that page_id are responses too, and a null page_id is never the smallest
(alone among null ids, all are responses). A null url has no header; control characters in one are percent-encoded. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oeuvre.llm.shared import lookup, mapped, new_folder, staged

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n"
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"

LEAST = 100


def header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK)), F.lit(""))


def page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def safe(url: Column) -> Column:
    """A url without control characters and blanks."""
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def planned(pages: DataFrame) -> DataFrame:
    """The pages with html, n, digest and first: the page_id that they revisit, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html, 256).alias("digest"))
    sizes = staged(pages.select("page_id", "n", "digest"), "digests")
    equal = sizes.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n_key"))
    equal = staged(equal.where("n_key > 1"), "equal")
    return lookup(pages, equal, "digest", F.xxhash64("page_id", "digest"), sizes.count()).withColumn("first", F.when(F.coalesce(F.col("first") != F.col("page_id"), F.col("page_id").isNull()), F.col("first")))


def write(pages: DataFrame, folder: str) -> None:
    """Archives of the pages, one file a task."""
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(MAGIC),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", page_uri(F.col("page_id"))),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", safe(F.col("url"))),
        header("WARC-Refers-To", page_uri(F.col("first"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("X-Payload-Length", F.col("n")),
        header("Content-Type", F.lit("text/html")),
        header("Content-Length", F.octet_length(block)),
        F.lit(BREAK),
        block,
    )
    planned(pages).select(record.alias("value")).write.option("lineSep", END).option("compression", "none").text(folder)


def pieces_of(spark: SparkSession, folder: str) -> DataFrame:
    meta = F.col("_metadata")
    return (
        spark.read.option("lineSep", MAGIC)
        .text(folder)
        .select(
            meta["file_path"].alias("path"),
            meta["file_size"].alias("whole"),
            meta["file_block_start"].alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
    )


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The batches, with the place of each piece among the bytes that its split read."""
    at, key = 0, None
    for batch in batches:
        places = []
        for path, block, value in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
            if key != (path, block):
                key, at = (path, block), 0
            places.append(at)
            at += len(value.as_buffer()) + len(MAGIC)
        yield batch, places


def fields(head: bytes) -> dict[str, str]:
    """The header lines by lower-case name; the first of a name counts."""
    found = {}
    for line in head.decode("utf-8", "replace").split(BREAK):
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


CANDIDATE = "path string, whole long, block long, place long, size long, kind string, id string, refers string, said string, full long, head long, n long, digest string"


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece its place and size and, if it begins like a record, what its header says. `digest`: of the payload, if
    the piece holds all of it."""
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in CANDIDATE.split(", ")])
    for batch, places in placed(batches):
        rows = []
        for path, whole, block, place, raw in zip(batch.column("path").to_pylist(), batch.column("whole").to_pylist(), batch.column("block").to_pylist(), places, batch.column("value"), strict=True):
            value = raw.as_buffer()
            text = memoryview(value)
            end = re.search(END.encode(), text)
            head = end.start() if end else -1
            row = [path, whole, block, place, len(value) + len(MAGIC), None, None, None, None, None, None, None, None]
            if head >= 0:
                own = fields(bytes(text[:head]))
                size = own.get("content-length", "")
                if re.fullmatch(r"[0-9]{1,18}", size):
                    start, n = head + len(END), int(size)
                    digest = hashlib.sha256(text[start : start + n]).hexdigest() if len(value) >= start + n else None
                    full = own.get("x-payload-length", "")
                    row[5:] = [own.get("warc-type"), own.get("warc-record-id"), own.get("warc-refers-to"), own.get("warc-payload-digest"), int(full) if full.isdigit() else None, start, n, digest]
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], f.type) for f in schema], names)


def with_offsets(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds `file` and `off`, the offset of the magic before each piece."""
    out = pieces.join(blocks, ["path", "block"])
    return out.withColumn("file", F.xxhash64("path")).withColumn("off", F.col("before") + F.col("place") - len(MAGIC)).drop("before")


def reachable(links: DataFrame) -> DataFrame:
    """(file, off) of the records that successors lead to from offset 0 of their file; links (file, off, succ).

    Pointer jumping: after k rounds the records within 2 ** k steps are known, and each link spans 2 ** k records.
    """
    jumps = staged(links, "jumps")
    most = jumps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    found = staged(jumps.where("off = 0").select("file", "off"), "reached")
    for _ in range(int(most).bit_length()):
        found = found.union(found.join(jumps, ["file", "off"]).select("file", F.col("succ").alias("off"))).distinct()
        found = staged(found, "reached")
        ahead = jumps.select("file", F.col("off").alias("succ"), F.col("succ").alias("next"))
        jumps = staged(jumps.join(ahead, ["file", "succ"]).select("file", "off", F.col("next").alias("succ")), "jumps")
    return found


def whole_payloads(parts: DataFrame, payload: bool) -> DataFrame:
    """(file, off, digest, payload) of records in several pieces: parts (file, owner, off, value, head, n)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = MAGIC.encode().join(p["value"] for p in row["parts"])[row["head"] : row["head"] + row["n"]]
                out.append((row["file"], row["owner"], hashlib.sha256(text).hexdigest(), text if payload else None))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())], ["file", "off", "whole_digest", "whole_payload"])

    grouped = parts.groupBy("file", "owner").agg(F.max("head").alias("head"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"))
    return mapped(grouped, task, "file long, off long, whole_digest string, whole_payload binary")


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of the archives in a folder: path, off, kind, id, refers, said (the digest in the header), full, n, digest
    (of the payload read), payload (null unless asked for)."""
    found = staged(mapped(pieces_of(spark, folder), candidates, CANDIDATE), "candidates")
    sums = found.groupBy("path", "block").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = staged(sums.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "blocks")
    placed_rows = with_offsets(found, blocks).withColumn("succ", F.col("off") + len(MAGIC) + F.col("head") + F.col("n") + len(END))
    links = placed_rows.where("off >= 0 AND succ <= whole").select("file", "off", "succ")
    kept = reachable(links)
    records = placed_rows.join(kept, ["file", "off"])
    parted = F.col("n").isNotNull() & F.col("digest").isNull()
    split = staged(records.where(parted).select("file", F.col("off").alias("owner"), "succ", "head", "n"), "split")
    if not split.isEmpty() or payload:
        others = placed_rows.where("off >= 0").join(kept, ["file", "off"], "left_anti").select("file", "off")
        marks = others.unionByName(records.where("off >= 0").select("file", "off", F.col("off").alias("own")), allowMissingColumns=True)
        last = F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("off"))
        parts = marks.select("file", "off", last.alias("owner")).join(split, ["file", "owner"]) if not payload else marks.select("file", "off", last.alias("owner")).join(
            records.select("file", F.col("off").alias("owner"), "succ", "head", "n"), ["file", "owner"]
        )

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, places in placed(batches):
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(places, pa.int64()), batch.column("value")], ["path", "block", "place", "value"])

        texts = with_offsets(mapped(pieces_of(spark, folder), again, "path string, block long, place long, value binary"), blocks)
        parts = texts.select("file", "off", "value").join(parts.where("off < succ"), ["file", "off"])
        more = staged(whole_payloads(parts, payload), "payloads")
        records = records.join(more, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "whole_digest")).withColumnRenamed("whole_payload", "payload")
    else:
        records = records.withColumn("payload", F.lit(None).cast("binary"))
    return records.select("path", "off", "kind", "id", "refers", "said", "full", "n", "digest", "payload")


def number(uri: Column, kind: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({uri}, '^<urn:page:(.*)>$', 1) AS {kind})")


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema["page_id"].dataType.simpleString()
    write(pages, folder)
    records = read(pages.sparkSession, folder)
    revisit = F.col("kind") == "revisit"
    return records.select(
        number("id", kind).alias("page_id"),
        F.when(revisit, F.col("full")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("said", ":", -1)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, number("refers", kind)).alias("refers_to"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
