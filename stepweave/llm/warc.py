"""WARC archives whose records are compressed one by one with a common Zstandard dictionary.

A dictionary is built from a bounded sample of the records to be archived. Each archive begins with a
skippable frame that holds it; every record is then a frame of its own, so single records can be
read at their offsets. Archives are rows of a table in the shared folder (``archive``, ``content``): the
table's committer makes each of them whole or absent when executors are lost, on any store. ``export`` puts
them into files. A record whose payload equals an earlier one's becomes a revisit record without payload.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import urllib.parse
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, each, load, text_or_empty, written

#: Records of the sample that the dictionary is built from, the largest record in it, the dictionary's size, and the bytes of an archive.
SAMPLE, SAMPLE_BYTES, DICTIONARY, ARCHIVE = 1000, 32 << 10, 64 << 10, 8 << 20
#: Payloads from this size on are compared.
REVISIT_BYTES = 100
#: Repeated rows of one page that a task makes at a time.
COPIES = 4096
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """Empty if the samples are too few to build one from."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def _id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def record_bytes(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes, date: str) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id, digest) if kind == 'response' else _id(page_id, digest + 'r')}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=';/?:@&=+$,-_.!~*()#%[]')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to, digest)}", f"Page-Refers-To: {refers_to}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if kind == "response" else b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write_batches(dictionary: bytes, archive_bytes: int, date: str):
    def run(batches):
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True, write_checksum=True)
        part, nth = TaskContext.get().partitionId(), 0
        content = bytearray(leading_frame(dictionary))
        empty = len(content)

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{nth:05d}.warc.zst"]), pa.array([bytes(content)], pa.binary())], ["archive", "content"])

        for b in batches:
            for r in zip(*[each(b.column(k)) for k in range(7)], strict=True):
                page, url, kind, refers, size, digest, payload = r
                content += packer.compress(record_bytes(page, url, kind, refers, digest, size, payload or b"", date))
                if len(content) >= archive_bytes:
                    yield archive()
                    content, nth = bytearray(leading_frame(dictionary)), nth + 1
        if len(content) > empty:
            yield archive()

    return run


def frames(content: bytes):
    """The dictionary of an archive, then each frame's record, one at a time."""
    magic, size = struct.unpack_from("<II", content, 0)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    dictionary, at = content[8 : 8 + size], 8 + size
    yield dictionary
    view = memoryview(content)
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    while at < len(content):
        d = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
        out = [d.decompress(view[at : at + (1 << 16)])]
        end = min(len(content), at + (1 << 16))
        while not d.eof and end < len(content):
            out.append(d.decompress(view[end : end + (1 << 20)]))
            end = min(len(content), end + (1 << 20))
        if not d.eof:
            raise ValueError("the archive ends within a record")
        at = end - len(d.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError(f"not a WARC record: {version[:40]}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than its header says")
    return fields, rest[:n]


def _read_batches(batches):
    for b in batches:
        for content in each(b.column(b.schema.get_field_index("content"))):
            out, held = [], 0
            records = frames(content)
            next(records)
            for record in records:
                head, block = parse_record(record)
                payload = block.partition(b"\r\n\r\n")[2]
                kind, page, refers = head["warc-type"], head.get("page-id"), head.get("page-refers-to")
                said = head["warc-payload-digest"].partition(":")[2]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
                    raise ValueError(f"page {page}: the payload is not what its digest says")
                size = len(payload) if kind == "response" else None
                out.append((page and int(page), head.get("warc-target-uri"), kind, int(refers) if refers not in (None, "None") else None, size, said, payload if kind == "response" else None))
                held += len(payload)
                if held > 16 << 20:
                    yield _records(out)
                    out, held = [], 0
            if out:
                yield _records(out)


def _records(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])


def mark_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """RECORD rows of pages(page_id, url, html): of equal payloads of at least revisit_bytes the smallest page_id's is the response.

    Only digests and ids are grouped. Of rows that repeat that page_id too, one is the response. Null page_ids sort last.
    """
    text = text_or_empty("html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.cast("binary").alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha2(text.cast("binary"), 256).alias("payload_digest"))
    own = own.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63)).cast("long")))
    light = own.select("key", "page_id", "url", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= revisit_bytes)
    keys = light.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    firsts = written(light.groupBy("key", "payload_digest").agg(F.count("*").alias("rows")).join(keys.drop("n"), "payload_digest"), "firsts")
    # payloads move once, by page, so that a payload of many pages is not gathered anywhere
    joined = own.join(firsts, ["key", "payload_digest"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    alone = joined.where(again | F.col("first").isNull() | (F.col("rows") == 1))
    columns = lambda df, revisit: df.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~revisit, F.col("payload")).alias("payload"))
    # rows that repeat the first page of a group: summed up before they move, then one is the response and as many as there were more are revisits
    twice = firsts.where("first = key and rows > 1").select("key", "payload_digest", "first")
    whole = own.join(twice, ["key", "payload_digest"]).groupBy("page_id", "payload_digest", "payload_bytes", "first").agg(F.min(F.coalesce("url", F.lit(""))).alias("url"), F.min("payload").alias("payload"))
    copies = light.join(twice, ["key", "payload_digest"]).groupBy("page_id", "payload_digest", "payload_bytes", "first", F.coalesce("url", F.lit("")).alias("url")).agg(F.count("*").alias("n"))
    rest = copies.join(whole.select("page_id", "payload_digest", F.col("url").alias("chosen")), ["page_id", "payload_digest"]).withColumn("n", F.col("n") - (F.col("url") == F.col("chosen")).cast("long")).where("n > 0")
    rest = rest.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)"))).repartition("payload_digest", "url", "at").withColumn("i", F.explode(F.expr(f"sequence(at, least(at + {COPIES}, n) - 1)")))
    rest = columns(rest.withColumn("payload", F.lit(None).cast("binary")), F.lit(True))
    return columns(alone, again).unionByName(columns(whole, F.lit(False))).unionByName(rest)


def write_warc(pages: DataFrame, dictionary_bytes: int = DICTIONARY, archive_bytes: int = ARCHIVE, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The written archives (archive, content) of pages(page_id, url, html)."""
    # the share of all rows that gives twice the sample: what partitions send doesn't grow with their number
    share = min(1.0, 2 * SAMPLE / max(1, pages.count()))
    key = F.xxhash64("page_id", "url")
    small = pages.where(key <= int(share * ((1 << 64) - 1)) - (1 << 63)) if share < 1 else pages
    small = small.select(key.alias("key"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")).where(F.octet_length("html") <= SAMPLE_BYTES)
    picked = small.orderBy("key", "html").limit(SAMPLE)
    sampled = [(r["page_id"], r["url"], r["html"].encode()) for r in picked.collect()]
    samples = [record_bytes(page, url, "response", None, hashlib.sha256(html).hexdigest(), len(html), html, date) for page, url, html in sampled if html]
    dictionary = build_dictionary(samples, dictionary_bytes)
    return written(arrow_map(mark_revisits(pages), _write_batches(dictionary, archive_bytes, date), "archive string, content binary"), "warc")


def read_warc(archives: DataFrame) -> DataFrame:
    """RECORD rows of archives(content); payload_bytes and payload are null for revisits, which have none."""
    return arrow_map(archives, _read_batches, RECORD)


def export(archives: DataFrame, folder: str) -> int:
    """Archives as .warc.zst files of a folder that is mounted on all nodes, written by the tasks that hold them, each whole or absent; how many."""

    def run(batches):
        for b in batches:
            for name, content in zip(each(b.column(0)), each(b.column(1)), strict=True):
                temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(temp, "wb") as f:
                    f.write(content)
                os.replace(temp, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return arrow_map(archives.select("archive", "content"), run, "n long").agg(F.sum("n")).first()[0] or 0


def op4_dictionary_warc(spark, sf_dir: str) -> DataFrame:
    """Every page archived and read back; a revisit's payload is that of the response it refers to."""
    back = read_warc(write_warc(load(spark, sf_dir, "pages")))
    light = written(back.drop("payload", "url"), "records")
    whole = light.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("whole_bytes")).distinct()
    revisits = light.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return light.where("record_type = 'response'").select(*columns).unionByName(revisits.select("page_id", F.col("whole_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha256(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS m FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.m IS NOT NULL AND f.m <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.m IS NOT NULL AND f.m <> d.page_id THEN f.m END AS refers_to
FROM d LEFT JOIN f ON f.h = d.h
"""
